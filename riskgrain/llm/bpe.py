"""BPE encoding and decoding over a table of distinct words.

Texts are split into words inside blocks of rows. A block keeps its distinct words once and each text as positions in
that list. The words of all blocks meet by word hash, where every distinct word is encoded once and its ids joined to
their pieces; the encoded words return to their blocks and are joined back by position.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgrain.llm.common import mix, small_batches, spans_hash, stored_by, text_pieces

#: Bytes of text in one block.
BLOCK_BYTES = 4 << 20
#: Below this code point texts are in composed form, lower-case letter by letter, and classes agree between libraries.
_PLAIN = 0x180
#: Marks a special token in a list of words; no word mixes it with letters.
_SPECIAL = "\0"


def _plain_pattern() -> re.Pattern[str]:
    """The word pattern for lower-cased texts of plain code points, with the classes spelled out."""
    import unicodedata

    of = lambda kinds: "".join(re.escape(chr(c)) for c in range(_PLAIN) if unicodedata.category(chr(c))[0] in kinds)
    letters, numbers, space = of("L"), of("N"), "".join(map(re.escape, "\t\n\x0b\x0c\r \x85\xa0"))
    # a lower-cased dotted capital I brings one combining dot
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+")


class Splitter:
    """Splits whole texts into the words that the tokenizer encodes one by one."""

    def __init__(self, spec: str, added: list[str]) -> None:
        self.spec, self._tokenizer = spec, None
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.marks = {t[:2] for t in added}
        self.plain, self.beyond = _plain_pattern(), re.compile(f"[^\0-{re.escape(chr(_PLAIN - 1))}]")
        self.bytes_back = {v: k for k, v in _byte_letters().items()}

    @property
    def tokenizer(self):
        """Only texts beyond the plain code points need it."""
        if self._tokenizer is None:
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_str(self.spec)
        return self._tokenizer

    def _segment(self, text: str) -> list[str]:
        if not self.beyond.search(text):
            return self.plain.findall(text.lower())
        words = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))
        return [bytes(self.bytes_back[c] for c in w).decode("utf-8", "surrogatepass") for w, _ in words]

    def words(self, text: str) -> list[str]:
        if self.special is None or not any(m in text for m in self.marks):
            return self._segment(text)
        out = []
        for k, part in enumerate(self.special.split(text)):
            out += [_SPECIAL + part] if k % 2 else self._segment(part)
        return out


def _byte_letters() -> dict[int, str]:
    """The byte alphabet of byte-level BPE: printable bytes stand for themselves, the others for letters from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def added_tokens(spec: str) -> dict[str, int]:
    return {t["content"]: t["id"] for t in json.loads(spec)["added_tokens"]}


def word_tokenizer_json(spec: str) -> str:
    """The tokenizer for single words: they are normalised and split already, and cannot hold a special token."""
    parts = json.loads(spec)
    return json.dumps(parts | {"normalizer": None, "added_tokens": [], "post_processor": None, "truncation": None, "padding": None})


def encode_words(words: list[str], tokenizer, added: dict[str, int]) -> list[list[int]]:
    """The ids of each word, by a tokenizer for single words."""
    own = [w for w in words if w[:1] != _SPECIAL or w[1:] not in added]
    ids = iter(tokenizer.encode_batch_fast(own, add_special_tokens=False))
    return [[added[w[1:]]] if w[:1] == _SPECIAL and w[1:] in added else next(ids).ids for w in words]


def piece_table(spec: str) -> list[tuple[int, str]]:
    """(id, piece) of the whole vocabulary, special tokens included."""
    parts = json.loads(spec)
    return sorted({v: k for k, v in parts["model"]["vocab"].items()}.items() | {(t["id"], t["content"]) for t in parts["added_tokens"]})


def _pack(words: list[str]) -> bytes:
    return zlib.compress("\n".join(words).encode("utf-8", "surrogatepass"), 1)


def _unpack(data: bytes) -> list[str]:
    return zlib.decompress(data).decode("utf-8", "surrogatepass").split("\n")


def _packed_numbers(x: np.ndarray) -> bytes:
    """Numbers below 2**32, in two bytes each where they fit."""
    if not len(x):
        return b""
    kind = np.uint16 if int(x.max()) < 1 << 16 else np.uint32
    return bytes([kind(0).itemsize]) + zlib.compress(x.astype(kind).tobytes(), 1)


def _unpacked_numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), np.uint16 if data[0] == 2 else np.uint32) if data else np.zeros(0, np.uint32)


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Small batches put together to about ``size`` bytes."""
    waiting, held = [], 0
    for b in batches:
        waiting.append(b)
        held += b.nbytes
        if held >= size:
            yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            waiting, held = [], 0
    if held:
        yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()[:1]


def _block_name(data: np.ndarray, offsets: np.ndarray, place: int) -> np.int64:
    """A hash of a block's bytes, row boundaries and place."""
    bounds = np.ascontiguousarray(offsets - offsets[0], np.int64).view(np.uint8)
    h = np.array([place], np.uint64)
    for part in (data, bounds):
        h = mix(mix(h) ^ spans_hash(part, np.array([0]), np.array([len(part)])))
    return h.view(np.int64)[0]


def _split_blocks(df: DataFrame, key: str, text: str, spec, added: dict[str, int], buckets: int, block_bytes: int) -> DataFrame:
    """(block, bucket, payload, keys, codes): the distinct words of a block by hash bucket, and its texts as positions.

    Rows with a bucket hold packed words of that bucket; rows without hold texts. A position counts the block's words
    bucket by bucket. Blocks are named by their place (partition and order in it) together with their content, so a
    repeated task gives the same rows and equal blocks stay apart.
    """
    kind = T.StructType.fromDDL("block bigint, bucket int, payload binary")
    schema = T.StructType([*kind.fields, T.StructField("key", df.schema[key].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, ordinal = Splitter(spec.value, list(added)), 0
        for b in _gathered(batches, block_bytes):
            keys, texts = b.column(0), b.column(1)
            place = b.column(2)[0].as_py() << 32
            for x, y, data, offsets in text_pieces(texts, block_bytes):
                name = _block_name(data, offsets, place + ordinal)
                ordinal += 1
                seen: dict[str, int] = {}
                codes = []
                for t in texts[x:y]:
                    words = splitter.words(t.as_py() or "")
                    codes.append(np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint32, len(words)))
                words = list(seen)
                bucket = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % buckets for w in words), np.int64, len(words))
                order = np.argsort(bucket, kind="stable")
                spot = np.empty(len(words), np.uint32)
                spot[order] = np.arange(len(words), dtype=np.uint32)
                used, begin = np.unique(bucket[order], return_index=True)
                packed = [_pack([words[k] for k in part]) for part in np.split(order, begin[1:])] if len(words) else []
                none = pa.nulls(len(used), keys.type)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), name)), pa.array(used, pa.int32()), pa.array(packed, pa.binary()), none], names=schema.names)
                shown = [_packed_numbers(spot[c]) for c in codes]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(y - x, name)), pa.nulls(y - x, pa.int32()), pa.array(shown, pa.binary()), keys.slice(x, y - x)], names=schema.names)

    # as a column: a task of the union below would count its partitions otherwise
    return df.select(key, text, F.spark_partition_id()).mapInArrow(run, schema)


def encode_decode(df: DataFrame, tokenizer_json: str, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, ids, decoded): every whole text's token ids and what decoding these ids gives; one row per row of ``df``.

    ``tokenizer_json`` is the text of a tokenizers file with byte-level BPE, without a decoder: pieces are joined by one
    space. Special tokens in a text are recognised, none are added. Null counts as empty and gives no ids. Blocks are
    bounded by ``block_bytes`` (one longer text is a block), buckets of distinct words hold about a block's words each,
    and every block is a group of its own however many equal ones there are, so no key, copy or common word piles up.
    Texts are split once: the blocks are written as a table bucketed by block in the shared folder, from which words go
    out by hash bucket and to which their ids come back, while the texts' positions stay where they are. The result
    reads that table, which is left to the cluster's policy for the folder.
    """
    small_batches(df.sparkSession)
    sc = df.sparkSession.sparkContext
    spec = sc.broadcast(tokenizer_json)
    pieces = sc.broadcast(dict(piece_table(tokenizer_json)))  # bounded by the vocabulary
    size = df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    buckets = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // block_bytes))
    added = added_tokens(tokenizer_json)
    words_spec = sc.broadcast(word_tokenizer_json(tokenizer_json))
    split = stored_by(_split_blocks(df, key, text, spec, added, buckets, block_bytes), "block")
    held: dict = {}  # a task's tokenizer, built once for all its buckets

    def encode(rows):
        lists = [_unpack(p.as_py()) for p in rows.column("payload")]
        distinct = sorted(set().union(*lists))
        number = {w: k for k, w in enumerate(distinct)}
        if not held:
            import os

            from tokenizers import Tokenizer

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            held["words"] = Tokenizer.from_str(words_spec.value)
        ids = encode_words(distinct, held["words"], added)
        flat = np.fromiter((i for x in ids for i in x), np.uint32)
        lengths = np.array([len(x) for x in ids], np.int64)
        begin = np.cumsum(lengths) - lengths
        out = []
        for words in lists:
            at = np.array([number[w] for w in words])
            n = lengths[at]
            take = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[at], n)
            out.append(_packed_numbers(np.concatenate(([len(n)], n, flat[take]))))
        return pa.table({"block": rows.column("block"), "bucket": rows.column("bucket"), "payload": pa.array(out, pa.binary())})

    encoded = split.where("bucket is not null").groupBy("bucket").applyInArrow(encode, "block bigint, bucket int, payload binary")
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *T.StructType.fromDDL("ids array<int>, decoded string").fields])

    def assemble(rows, words):
        pa.default_memory_pool().release_unused()  # what the block before took
        lists = {k: _unpacked_numbers(p.as_py()) for k, p in zip(words.column("bucket").to_pylist(), words.column("payload"), strict=True)}
        n = np.concatenate([np.zeros(0, np.uint32), *(lists[k][1 : 1 + int(lists[k][0])] for k in sorted(lists))]).astype(np.int64)
        flat = np.concatenate([np.zeros(0, np.uint32), *(lists[k][1 + int(lists[k][0]) :] for k in sorted(lists))])
        begin = np.cumsum(n) - n
        piece = pieces.value
        shown = [" ".join([piece[i] for i in flat[x : x + m].tolist()]) for x, m in zip(begin.tolist(), n.tolist(), strict=True)]
        ids, counts, decoded = [np.zeros(0, np.int32)], [], []
        for payload in rows.column("payload"):
            raw = payload.as_py()
            words = _unpacked_numbers(raw)
            if len(words) and int(words.max()) >= len(n):
                raise RuntimeError("a block's words are incomplete")
            m = n[words]
            take = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + np.repeat(begin[words], m)
            ids.append(flat[take].astype(np.int32))
            counts.append(len(take))
            decoded.append(" ".join([shown[w] for w in words.tolist()]))
        bounds = np.concatenate(([0], np.cumsum(counts, dtype=np.int64))).astype(np.int32)
        keys = rows.column("key").combine_chunks()
        lists_of = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(ids)))
        return pa.Table.from_arrays([keys if isinstance(keys, pa.Array) else pa.array([], keys.type), lists_of, pa.array(decoded, pa.string())], names=schema.names)

    texts = split.where("bucket is null").select("block", "payload", "key")
    return texts.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(assemble, schema)


def decode(df: DataFrame, tokenizer_json: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of an array of token ids: pieces joined by one space. ``out`` must be a free name.

    The vocabulary, whose size is fixed, is joined as a broadcast lookup by position. Null ids give null; ids outside
    the vocabulary and null elements give nothing.
    """
    pieces = df.sparkSession.sparkContext.broadcast(dict(piece_table(tokenizer_json)))

    @F.pandas_udf("string")
    def join(lists):
        known = pieces.value
        return lists.map(lambda x: None if x is None else " ".join([known[i] for i in x if i in known]))

    return df.withColumn(out, join(F.col(ids)))


def digest_of_ids(ids: str) -> Column:
    """SHA-256 of the decimal ids joined by one space."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), " "), 256)
