"""Fingerprints, ranked search and spelling variants against brute force, and the awkward inputs of each."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgrain.llm import fingerprint, ranked_search, spelling
from riskgrain.llm.common import table
from riskgrain.llm.queries import op11_fingerprint, op12_ranked_search, op13_spelling


def documents(spark, rows, parts=3, **extra):
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *(T.StructField(n, T.StringType()) for n in extra)]
    return spark.createDataFrame(spark.sparkContext.parallelize([(*r, *extra.values()) for r in rows], parts), T.StructType(fields))


def some_texts(n, seed=0, words=60, most=80):
    rng = random.Random(seed)
    known = ["".join(rng.choice("abcdeéxyz") for _ in range(rng.randint(1, 8))) for _ in range(words)]
    return [" ".join(rng.choice(known) for _ in range(rng.randint(0, most))) for _ in range(n)]


# fingerprints


def sketch(text, scale=fingerprint.SCALE, size=fingerprint.SIZE):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [w[i : i + size] for i in range(max(len(w) - size + 1, min(len(w), 1)))]
    hashes = {sum(fingerprint.word_hash(x.encode()) * fingerprint.MULTIPLIER**i for i, x in enumerate(g)) % 2**60 for g in grams}
    low = {h for h in hashes if h < 2**60 // scale}
    return sorted(low or ({min(hashes)} if hashes else set()))


def test_sketches_equal_brute_force(spark):
    texts = [*some_texts(60), None, "", "  \n", "One", "two words", "A b c d e", "a B c D e", "word " * 40_000, "😀 é x ĳ 中文 y z"]
    df = documents(spark, list(enumerate(texts)), SKETCH="clash").withColumn("other", F.reverse("text"))
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(df, {"text": "s", "other": "o"}).collect()}
    for k, t in enumerate(texts):
        assert list(got[k]["s"]) == sketch(t) and list(got[k]["o"]) == sketch(t and t[::-1])
    assert got[len(texts) - 3]["s"] == got[len(texts) - 4]["s"] and got[0]["SKETCH"] == "clash"
    with pytest.raises(ValueError, match="sketch"):
        fingerprint.fingerprints(df, {"text": "sketch"})
    assert fingerprint.fingerprints(documents(spark, []), {"text": "s"}).count() == 0


def test_likeness_and_merging(spark):
    texts = some_texts(40, seed=1, most=120)
    df = documents(spark, [(k % 4 if k % 5 else None, t) for k, t in enumerate(texts)] + [(9, ""), (9, None)])
    marked = fingerprint.fingerprints(df, {"text": "s"}, scale=4)
    for r in fingerprint.merged(marked, "doc_id", "s", scale=4).collect():
        own = [t for k, t in enumerate(texts) if (k % 4 if k % 5 else None) == r["doc_id"]] if r["doc_id"] != 9 else [""]
        everything = set()
        for t in own:
            everything |= set(sketch(t, scale=1))
        low = sorted(h for h in everything if h < 2**58)
        assert list(r["s"]) == (low or sorted(everything)[:1])
    pairs = spark.createDataFrame([([], []), ([], [1]), ([1, 2, 3], [2, 3, 4, 5]), ([7], [7])], "a array<bigint>, b array<bigint>")
    got = [tuple(r) for r in pairs.select(fingerprint.jaccard("a", "b"), fingerprint.containment("a", "b")).collect()]
    assert got == [(1.0, 1.0), (0.0, 1.0), (0.4, 2 / 3), (1.0, 1.0)]


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_next_rows_over_repeated_and_null_keys(spark, kind):
    rng = random.Random(3)
    rows = [(rng.choice([None, 5, 5, 5, *range(40)]), rng.choice([None, "", "a", "bb", "c" * 5000])) for _ in range(300)]
    df = documents(spark, rows).withColumn("doc_id", F.col("doc_id").cast(kind))
    got = [tuple(r) for r in fingerprint.with_next(df, "doc_id", "text", out="following").collect()]
    order = df.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).orderBy(F.desc_nulls_last("doc_id"), F.desc(F.xxhash64("t"))).collect()
    want = [(a[0], a[1], b[1]) for a, b in zip(order, order[1:] + order[:1], strict=True)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert [tuple(r) for r in fingerprint.with_next(documents(spark, [(1, "x")]), "doc_id", "text", out="f").collect()] == [(1, "x", "x")]
    assert fingerprint.with_next(documents(spark, []), "doc_id", "text", out="f").count() == 0


def test_op11_equals_brute_force(spark, tmp_path):
    texts = [*some_texts(30, seed=5), None, "", "x", "three words here"]
    documents(spark, [(3 * k, t) for k, t in enumerate(texts)]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op11_fingerprint(spark, str(tmp_path)).collect()}
    for k, t in enumerate(texts):
        t, f = t or "", texts[k - 1] or ""
        e = t[: len(t) - len(t) // 2] + f[: len(t) // 2]
        r = got[3 * k]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        a, b, c = (set(sketch(x)) for x in (t, e, f))
        assert r["fingerprint"] == ",".join(f"{h:015x}" for h in sorted(a)) and r["edited_fingerprint"] == ",".join(f"{h:015x}" for h in sorted(b))
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        assert (r["near_edited"], r["near_next"]) == (like(a, b), like(a, c))


# ranked search


def ranking(docs, items, k):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    words = lambda t: term.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counts = [(d, Counter(words(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in counts:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(words(text)) if c[t])
            if score > 0:
                found.append((-score, d is not None, d))
        out += [(item, r, f[2], -f[0]) for r, f in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("shard", "block"), [(2000, 40), (1 << 20, 1 << 20)])
def test_search_equals_brute_force(spark, shard, block):
    texts = some_texts(400, seed=7, words=300)
    rows = [*enumerate(texts), *((1000 + k, texts[3]) for k in range(90)), (None, texts[5]), (None, texts[5]), (7, texts[9]), (2000, None), (2001, "--"), (2002, texts[2] * 300)]
    items = [*enumerate(some_texts(25, seed=7, words=300)), (3, texts[3]), (None, texts[5]), (50, None), (51, "..."), (52, "nowhere"), (53, texts[4].upper() * 50)]
    index = ranked_search.build_index(documents(spark, rows, score="clash", rank="clash"), "doc_id", "text", shard_bytes=shard)
    found = ranked_search.search(index, documents(spark, items).withColumnRenamed("doc_id", "item_id"), "item_id", "text", key="doc_id", k=20, block_terms=block)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == ranking(rows, items, 20)


def test_search_of_empty_tables(spark):
    none, one = documents(spark, []), documents(spark, [(1, "a b")])
    for docs, items in ((none, one), (one, none), (none, none), (one, documents(spark, [(2, "zz")]))):
        index = ranked_search.build_index(docs, "doc_id", "text")
        found = ranked_search.search(index, items.withColumnRenamed("doc_id", "item_id"), "item_id", "text", key="doc_id")
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0
    index = ranked_search.build_index(one.withColumn("doc_id", F.lit("k")), "doc_id", "text")
    assert ranked_search.search(index, one.withColumnRenamed("doc_id", "item_id"), "item_id", "text", key="doc_id").first()[2] == "k"


def test_intervals_are_left_unscored(spark):
    rng = np.random.default_rng(0)
    n = rng.integers(5, 60, 3000)
    names = np.arange(1, 9, dtype=np.uint64)
    lists = [np.sort(rng.choice(3000, 1500, replace=False)).astype(np.int32) for _ in names]
    row = {"sizes": np.sort(n).astype(np.int32), "names": names, "starts": (np.arange(9) * 1500).astype(np.int32), "rows": np.concatenate(lists), "times": rng.integers(1, 3, 12_000).astype(np.int32)}
    shard = ranked_search.Shard({k: v.tobytes() for k, v in row.items()}, names, rng.integers(1, 5000, 8), 3000, int(n.sum()))
    whole = np.zeros(3000, np.int64)
    np.add.at(whole, shard.rows, shard.impacts)
    docs, scores = shard.search(np.arange(8), 10, 1)
    assert len(docs) < 300
    assert sorted(scores)[-10:] == sorted(whole)[-10:] and (whole[docs] == scores).all()
    floor = int(np.sort(whole)[-5])
    docs, _ = shard.search(np.arange(8), 10, floor)
    assert set(docs) == set(np.flatnonzero(whole >= floor))


def test_op12_equals_brute_force(spark, tmp_path):
    rows, items = list(enumerate(some_texts(120, seed=11))), list(enumerate(some_texts(6, seed=11)))
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    documents(spark, items).withColumnRenamed("doc_id", "item_id").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted((tuple(r) for r in op12_ranked_search(spark, str(tmp_path)).collect()), key=repr) == ranking(rows, items, 50)


# spelling variants


def counted(docs, letters, least, every):
    n = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= letters and c >= least}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(n, times):
    out = {}
    for w in n:
        close = sorted((-n[x], x) for x in n if near(w, x))
        form = close[0][1] if close and -close[0][0] >= times * n[w] else None
        out[w] = [form, len(close), n[form] if form else None]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w].append(root)
    return out


def misspelt(seed, n, letters="aeé"):
    """Words that are often near each other, with very unequal counts."""
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(n)]
    return {w: rng.choice([1, 1, 2, 7, 40, 300]) for w in base}


def test_runs_are_counted_like_brute_force(spark):
    texts = [*some_texts(50, seed=2, words=40), None, "", "Ünïcôdé ÀÉ×÷ÿ Ÿ ŵord naïve-Naïve", "a" * 70_000, "İstanbul\x00abc1def", "é" * 300]
    rows = [(k * 7919, t) for k, t in enumerate(texts)] + [(None, "nullkey nullkey"), (5, "repeat"), (5, "repeat")]
    for letters, least, every in ((1, 1, None), (3, 2, 3), (6, 1, 1)):
        got = spelling.word_counts(documents(spark, rows, word="x", n="y"), "doc_id", "text", letters=letters, least=least, every=every)
        assert {r["word"]: r["n"] for r in got.collect()} == counted(rows, letters, least, every)
    assert spelling.word_counts(documents(spark, []), "doc_id", "text").count() == 0


@pytest.mark.parametrize("block", [4096, 5])
def test_variants_equal_brute_force(spark, block):
    # many words share a half; small blocks cut such buckets
    n = misspelt(4, 400) | {"x" * 200: 3, "x" * 201: 40, "x" * 199 + "y": 5, "日本語テキスト": 9, "日本語テキスツ": 1, "𝔘𝔫𝔦": 3, "𝔘𝔫𝔦𝔠": 30}
    least = 3
    vocabulary = spark.createDataFrame(spark.sparkContext.parallelize([(w, c) for w, c in n.items() if len(w) >= least], 3), "word string, n bigint")
    found = {r["word"]: (r["n_near"], r["best"], r["best_n"]) for r in spelling.near_words(vocabulary, least=least, block_words=block).collect()}
    want = {}
    for w in n:
        close = sorted((-n[x], x) for x in n if near(w, x))
        if close:
            want[w] = (len(close), close[0][1], -close[0][0])
    assert found == want


def test_roots_follow_long_chains(spark):
    links = spark.createDataFrame([(str(k), str(k + 1)) for k in range(13)] + [("a", "5"), ("b", "z")], "word string, form string")
    got = {r["word"]: r["root"] for r in spelling.roots(links).collect()}
    assert got == {**{str(k): "13" for k in range(13)}, "a": "13", "b": "z"}
    assert spelling.roots(links.limit(0)).count() == 0
    assert spelling.variants(spark.createDataFrame([], "word string, n bigint")).count() == 0


def test_op13_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    words = [w + "xyz" for w, c in misspelt(8, 60).items() for _ in range(c)]
    rng.shuffle(words)
    rows = [(k, " ".join(words[k * 30 : k * 30 + 30])) for k in range(-(-len(words) // 30))]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["word"]: [r["form"], r["n_near"], r["form_n"], r["root"], r["n"]] for r in op13_spelling(spark, str(tmp_path)).collect()}
    n = counted(rows, 6, 5, 199)
    assert got == {w: [*v, n[w]] for w, v in expected(n, 5).items()} and any(v[0] for v in got.values())
    assert table(spark, str(tmp_path), "documents").count() == len(rows)
