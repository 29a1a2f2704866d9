"""URL filter: allow and block rules in a trie over reversed host labels and path segments, longest match first."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgrain.llm.common import free_name

#: Characters of rules sent to the executors at once; a larger rule set passes in several such blocks.
BLOCK_CHARS = 8 << 20
DEFAULT_VERDICT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: str) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


class RuleTrie:
    """Rules under their host labels from the top domain down, then under path segments.

    A path rule is a plain prefix: its last segment may end inside a segment of the url, so a node also keeps the
    beginnings of segments at which rules end, longest first.
    """

    def __init__(self, rules: list[tuple[str, str, str]]) -> None:
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault("/", {})  # no host label is a slash
            *segments, last = path.split("/")
            for s in segments:
                node = node.setdefault(s + "/", {})
            kept = node.setdefault("", {})
            # of two rules for the same place the blocking one counts
            if kept.get(last, ("", "allow"))[1] != "block":
                kept[last] = (host + path, verdict)
        self._order(self.root)

    def _order(self, top: dict) -> None:
        todo = [top]
        while todo:
            node = todo.pop()
            for key, child in node.items():
                if key == "":
                    node[key] = sorted(child.items(), key=lambda x: -len(x[0]))
                else:
                    todo.append(child)

    def find(self, host: str, path: str) -> tuple[int, int, str, str] | None:
        """(host labels, path characters, rule, verdict) of the longest fitting rule."""
        best, node = None, self.root
        for depth, label in enumerate(reversed(host.split(".")), 1):
            node = node.get(label)
            if node is None:
                break
            if "/" in node:
                found = self._path(node["/"], path)
                if found is not None:  # a longer host beats any path under a shorter one
                    best = (depth, *found)
        return best

    @staticmethod
    def _path(node: dict, path: str) -> tuple[int, str, str] | None:
        best, at = None, 0
        segments = path.split("/")
        for k, s in enumerate(segments):
            for start, (rule, verdict) in node.get("", ()):
                if s.startswith(start):
                    best = (at + len(start), rule, verdict)
                    break
            at += len(s) + 1
            node = node.get(s + "/") if k + 1 < len(segments) else None
            if node is None:
                break
        return best


def filter_urls(df: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, url: str = "url", default: str = DEFAULT_VERDICT, host: str = "host", path: str = "path", rule: str = "rule", verdict: str = "verdict", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``df`` with the host, path, fitting rule and verdict of each url.

    ``rules`` are rows of (verdict, host, path). A rule fits its host and all subdomains if the path starts with the
    rule's; a rule with a null part fits nothing. The rule with more host labels wins, then the longer path; a block entry beats an equal allow entry. Urls
    that no rule fits have a null rule and the ``default`` verdict; null and urls without ``://`` have an empty host and
    path. Rules go through in blocks of bounded size; each row keeps its best rule so far, so no rule table is too
    large. The four new names must be free.
    """
    spark = df.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(rules or [("", "", "")], "verdict string, host string, path string").where("host <> ''")
    best = free_name(df, "best_rule")
    kind = T.StructType.fromDDL(f"`{best}` struct<depth:int,length:int,rule:string,verdict:string>")
    out = df.withColumns({host: host_of(url), path: path_of(url), best: F.lit(None).cast(kind[best].dataType)})
    spec = pa.struct([("depth", pa.int32()), ("length", pa.int32()), ("rule", pa.string()), ("verdict", pa.string())])

    def matcher(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trie = RuleTrie(sent.value)
            for b in batches:
                names = b.schema.names
                at = names.index(best)
                found = []
                for h, p, old in zip(b.column(names.index(host)).to_pylist(), b.column(names.index(path)).to_pylist(), b.column(at).to_pylist(), strict=True):
                    new = trie.find(h, p)
                    better = new is not None and (old is None or (new[0], new[1], new[3] == "block") > (old["depth"], old["length"], old["verdict"] == "block"))
                    found.append(dict(zip(("depth", "length", "rule", "verdict"), new, strict=True)) if better else old)
                columns = list(b.columns)
                columns[at] = pa.array(found, spec)
                yield pa.RecordBatch.from_arrays(columns, names=names)

        return run

    for block in _blocks(rules, block_chars):
        out = out.mapInArrow(matcher(spark.sparkContext.broadcast(block)), out.schema)
    return out.withColumns({rule: F.col(best)["rule"], verdict: F.coalesce(F.col(best)["verdict"], F.lit(default))}).drop(best)


def _blocks(rules: DataFrame, block_chars: int) -> Iterator[list[tuple[str, str, str]]]:
    block, size = [], 0
    whole = rules.where("verdict is not null and host is not null and path is not null")
    for r in whole.select("verdict", F.translate("host", _UPPER, _LOWER).alias("host"), "path").toLocalIterator():
        if block and size + len(r["host"]) + len(r["path"]) > block_chars:
            yield block
            block, size = [], 0
        block.append((r["verdict"], r["host"], r["path"]))
        size += len(r["host"]) + len(r["path"])
    if block:
        yield block
