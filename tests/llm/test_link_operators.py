"""Sharding, top-k, URL rules, the n-gram join and line dedup against brute force, and the awkward inputs of each."""

from __future__ import annotations

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskgrain.llm import bit_index, line_dedup, ngram_join, pii, sharding, url_filter
from riskgrain.llm.common import hash_filter
from riskgrain.llm.components import components
from tests.llm.test_text_operators import ODD, documents


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("links", [[], [(k, k + 1) for k in range(70)], [(0, k) for k in range(1, 90)], [(5, 5), (9, 2), (2, 9), (7, 3), (3, 2)]])
def test_components(spark, links):
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for p in links for x in p if p[0] != p[1]}
    assert got == roots(nodes, [p for p in links if p[0] != p[1]])


def test_hash_filter_never_loses_a_key(spark):
    test = hash_filter(spark.range(0, 3000, 3).withColumn("k", F.col("id")), "k", bits=20)
    got = {r["id"] for r in spark.range(3000).where(test("id")).collect()}
    assert got >= set(range(0, 3000, 3)) and len(got) < 1200
    assert spark.range(5).where(hash_filter(spark.range(0), "id", bits=12)("id")).count() == 0


def test_shards_fit_and_split_only_when_needed(spark):
    texts = ["x" * (7 * k % 50) for k in range(400)] + ["y" * 900, None, ""]
    df = documents(spark, texts, depth="clash", shard="clash", bits="clash").unionByName(documents(spark, ["z" * 40] * 100, depth="d", shard="s", bits="b").withColumn("doc_id", F.lit(7).cast("long")))
    rows = sharding.assign_shards(df, limit=500).collect()
    assert len(rows) == len(texts) + 100
    size = {}
    for r in rows:
        size[r["shard"]] = size.get(r["shard"], 0) + r["bytes"]
    for r in rows:
        assert r["shard_bytes"] == size[r["shard"]] and (size[r["shard"]] <= 500 or r["shard"].startswith("+"))
    assert [r["shard"] for r in rows if r["bytes"] == 900] == ["+400#0"]
    plain = {s: b for s, b in size.items() if not s.startswith("+")}
    # no bucket inside another, and siblings together exceed the limit
    assert not any(a != b and b.startswith(a) for a, b in itertools.product(plain, plain))
    for s in plain:
        if s:
            assert sum(b for t, b in plain.items() if t.startswith(s[:-1])) > 500
    assert {r["shard"] for r in sharding.assign_shards(df, limit=10**9).collect()} == {""}
    assert sharding.assign_shards(df.limit(0), limit=5).count() == 0


def test_shard_files(spark, tmp_path):
    df = documents(spark, ["a" * 30] * 40, shard="kept")
    found = sharding.write_shards(df, f"{tmp_path}/out", limit=300)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 40 and back.select("shard").distinct().count() == 1
    assert found.select("shard").distinct().count() == back.select("_shard").distinct().count() > 2


def brute_top(vectors, queries, k):
    out = set()
    for q, v in queries:
        best = sorted(((-int(np.dot(v, w)), i) for i, w in vectors if i != q))[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 12))
    x[100:400] = x[3]
    x[400:420] = 0
    rows = [(k, [float(c) for c in v], "c") for k, v in enumerate(x)]
    rows += [(1000, None, "c"), (1001, [float("nan")] * 12, "c"), (1002, [None] * 12, "c"), (1003, [float("inf")] + [0.0] * 11, "c"), (1004, [1.0], "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    ints = df.withColumn("embedding", bit_index.quantised("embedding"))
    whole = [(k, np.floor(v * 256).astype(int)) for k, v in enumerate(x)]
    want = brute_top(whole, [w for w in whole if w[0] % 50 == 0], 5)
    for block in (7, 1000):
        got = bit_index.top_k(ints, ints.where("vec_id % 50 = 0"), 5, query_block=block)
        assert {tuple(r) for r in got.collect()} == want
    assert bit_index.top_k(ints.where("vec_id < 3"), ints.where("vec_id = 0"), 5).count() == 2
    assert bit_index.top_k(ints.limit(0), ints.where("vec_id = 0"), 5).count() == 0
    assert bit_index.top_k(ints, ints.limit(0), 5).count() == 0


def test_slice_arithmetic():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 64, (2, 100, 1))
    digits = lambda s: sum(np.unpackbits(s[0, k].view(np.uint8), bitorder="little")[:100].astype(int) << k for k in range(s.shape[1]))
    assert (digits(bit_index._add(bit_index._slices(a, 6), bit_index._slices(b, 6))) == (a + b)[:, 0]).all()
    for m, s in enumerate(bit_index._times(bit_index._slices(a, 6), 31)):
        assert (digits(s) == m * a[:, 0]).all()


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"), ("block", "a.com", ""), ("allow", "a.com", "/x/y"), ("block", "a.com", "/x/y"), ("allow", "b.a.com", "/")]


def brute_rule(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m.group(1).translate({i: i + 32 for i in range(65, 91)}), m.group(2)) if m else ("", "")
    fits = [(len(h.split(".")), len(p), v == "block", h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


@pytest.mark.parametrize("block_chars", [1 << 20, 12])
def test_url_rules(spark, block_chars):
    hosts = ["org", "X.Org", "example.org", "www.example.org", "notexample.org", "com", "a.com", "b.a.com", "c.b.a.com", "", "a.com:80", "net"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12/3", "/en/2", "/fr/x", "/de/", "/x/y", "/x/yz/", "/x", "//", "/x//y"]
    urls = [f"https://{h}{p}{t}" for h in hosts for p in paths for t in ("", "?q=/de/", "#x")] + [None, "", "org/x", "ftp://x://org/", "http://example.org/en/1\n"]
    df = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)], "page_id long, url string, best_rule string")
    rows = url_filter.filter_urls(df, RULES, block_chars=block_chars).collect()
    for r in rows:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute_rule(urls[r["page_id"]]), urls[r["page_id"]]
    assert {r["verdict"] for r in url_filter.filter_urls(df, []).collect()} == {"allow"}
    assert url_filter.filter_urls(df.limit(0), RULES).count() == 0


def gram_sets(texts, size):
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)})) for t in texts]
    return [{tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()) for w in words]


def brute_links(sets, share):
    return [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if sets[i] and 100 * len(sets[i] & sets[j]) >= round(100 * share) * len(sets[i] | sets[j])]


def near_copies(rng, base, n):
    out = []
    for _ in range(n):
        words = base.split()
        for _ in range(int(rng.integers(0, 4))):
            words[int(rng.integers(len(words)))] = "w" + str(rng.integers(10**6))
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("size", "share"), [(3, 0.9), (5, 0.8)])
def test_ngram_join_equals_brute_force(spark, size, share):
    rng = np.random.default_rng(8)
    bases = [" ".join(f"t{x}" for x in rng.integers(0, 300, int(n))) for n in (40, 90, 200, 12)]
    texts = [t for b in bases for t in near_copies(rng, b, 25)] + [bases[0]] * 6 + ["Same words", "same WORDS", "same", *ODD]
    passage = " ".join(f"p{k}" for k in range(60))
    texts += [passage + " " + " ".join(f"u{x}" for x in rng.integers(0, 10**6, 8)) for _ in range(20)]
    texts += [" ".join(f"c{k}" for k in range(s, s + 100)) for s in range(0, 40, 2)]
    df = documents(spark, texts, key="clash", component_id="clash")
    sets = gram_sets(texts, size)
    want = roots(range(len(texts)), brute_links(sets, share))
    rows = ngram_join.jaccard_components(df, "doc_id", size=size, share=share, bits=12).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows} == {(k, len(s), want[k]) for k, s in enumerate(sets)}
    left = ngram_join.one_of_each(df, size=size, share=share, bits=12)
    assert left.columns == df.columns and {r["doc_id"] for r in left.collect()} == {k for k in want if want[k] == k}


def test_ngram_join_awkward_tables(spark):
    df = documents(spark, [None, "", "a b c d", "a b c d"])
    assert ngram_join.jaccard_components(df.limit(0), "doc_id", bits=10).count() == 0
    twice = df.unionByName(df).unionByName(documents(spark, ["a b c d"]).withColumn("doc_id", F.lit(None).cast("long")))
    rows = ngram_join.jaccard_components(twice, "doc_id", bits=10).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in rows if r["doc_id"] is not None) == sorted([(0, 0), (1, 1), (2, 2), (3, 2)] * 2)
    assert ngram_join.one_of_each(twice, bits=10).count() == 7


def test_trie_walk_equals_set_arithmetic():
    rng = np.random.default_rng(9)
    for _ in range(40):
        probe = rng.choice(400, int(rng.integers(1, 200)), replace=False).astype(np.uint64)
        sets = []
        for _ in range(12):
            keep = probe[rng.random(len(probe)) < rng.choice([0.8, 0.95, 1.0])]
            sets.append(np.sort(np.union1d(keep, rng.choice(500, int(rng.integers(1, 12))).astype(np.uint64))))
        want = [len(np.intersect1d(probe, s)) / len(np.union1d(probe, s)) >= 0.8 for s in sets]
        assert list(ngram_join.trie_matches(np.sort(probe), sets, 0.8)) == want


def test_ngram_join_with_repeated_and_null_keys(spark):
    rows, want = [], {}
    for k in range(20):
        one, two, bridge = ([f"{kind}{k}w{i}" for i in range(60)] for kind in "abc")
        key = 100 * k
        # two texts of one key, a near copy of each
        rows += [(key, one), (key, two), (key + 1, [*one, "more"]), (key + 2, [*two, "more"])]
        # two texts that only a text without a key connects
        rows += [(key + 3, ["x", "y", "z", *bridge]), (None, bridge), (key + 4, [*bridge, "u", "v", "w"])]
        want |= {key + 1: key, key + 2: key, key + 3: key + 3, key + 4: key + 3}
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in rows], "doc_id bigint, text string")
    got = ngram_join.jaccard_components(df, "doc_id", share=0.93).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] in want} == want


def test_line_dedup_equals_brute_force(spark):
    rng = np.random.default_rng(12)
    line = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    bases = [line(12) for _ in range(12)] + ["short", "x", "longer one"]

    def variant(s):
        k = int(rng.integers(len(s)))
        return s if rng.random() < 0.4 else s[:k] + str(rng.choice(list("xyz"))) + s[k + 1 :]

    texts = ["\n".join([variant(str(rng.choice(bases))) if rng.random() < 0.5 else line(9) for _ in range(int(rng.integers(1, 7)))] + ["", "  "]) for _ in range(60)]
    texts += [*ODD, "a\r\nb\n", "\n\n\n"]
    df = documents(spark, texts, n_removed="clash", at="clash", key="clash")
    first = {}
    for k, t in enumerate(texts):
        for i, s in enumerate((t or "").split("\n")):
            if s.strip(" \t\r\x0b\x0c"):
                first.setdefault(s, (k, i))
    lines = list(first)
    grams = [line_dedup._shingles(s, 8) for s in lines]
    links = [(i, j) for i, j in itertools.combinations(range(len(lines)), 2) if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]) - 1e-9]
    top = roots(range(len(lines)), links)
    kept = {first[lines[k]] for k in top if top[k] == k}
    place = {s: k for k, s in enumerate(lines)}
    # many short bands, so that no link is missed by chance
    clean = line_dedup.dedup_lines(df, removed="gone", bands=30, rows=2)
    for r in clean.collect():
        t = texts[r["doc_id"]]
        if t is None:
            assert r["text"] is None
            continue
        parts = t.split("\n")
        want = [s for i, s in enumerate(parts) if s not in place or (r["doc_id"], i) in kept]
        assert r["text"] == "\n".join(want) and r["gone"] == len(parts) - len(want)
        assert r["n_removed"] == "clash"
    assert line_dedup.dedup_lines(df).columns == df.columns
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_line_dedup_finds_isolated_pairs_with_the_production_bands(spark):
    rng = np.random.default_rng(21)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    texts = []
    for _ in range(1500):
        n = int(rng.integers(79, 108))
        line = "".join(rng.choice(letters, n))
        k = int(rng.integers(8, n - 8))
        other = line[:k] + "#" + line[k + 1 :]
        a, b = line_dedup._shingles(line, 8), line_dedup._shingles(other, 8)
        assert 0.8 <= len(a & b) / len(a | b) < 0.86
        texts += [line, other]
    got = line_dedup.dedup_lines(documents(spark, texts), removed="gone").select("doc_id", "gone").collect()
    assert {r["doc_id"] for r in got if r["gone"]} == set(range(1, len(texts), 2))


def test_line_dedup_keeps_unique_lines_of_repeated_keys(spark):
    df = documents(spark, ["a line that comes first", "x", "x"]).where("doc_id = 0")
    twice = documents(spark, ["a unique line\na line that comes first", "a line that comes first\nanother unique line", None]).withColumn("doc_id", F.lit(5).cast("long"))
    got = line_dedup.dedup_lines(df.unionByName(twice), removed="gone").select("text", "gone").collect()
    assert len(got) == 4 and {tuple(r) for r in got} == {("a line that comes first", 0), ("a unique line", 1), ("another unique line", 1), (None, 0)}


def test_line_signatures_estimate_similarity():
    rng = np.random.default_rng(13)
    a = "".join(rng.choice(list("abcdefghijklmnop"), 400))
    b = a[:300] + "".join(rng.choice(list("abcdefghijklmnop"), 100))
    h, bounds = line_dedup.shingle_hashes([a, b], 8)
    sig = line_dedup.signatures(h, bounds, 2000)
    x, y = line_dedup._shingles(a, 8), line_dedup._shingles(b, 8)
    assert abs((sig[0] == sig[1]).mean() - len(x & y) / len(x | y)) < 0.05


def test_top_k_without_null_keys_and_with_repeated_ones(spark):
    rows = [(1, [1, 2]), (2, [3, 4]), (2, [3, 4]), (None, [9, 9]), (3, None)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<int>")
    got = [tuple(r) for r in bit_index.top_k(df, df, k=5).orderBy("query_id", "rank").collect()]
    # a repeated query asks once for each of its rows; only its own key is left out
    assert set(got) >= {(1, 1, 2, 11), (1, 2, 2, 11), (2, 1, 1, 11)} and all(None not in r for r in got)


def test_url_rules_with_null_parts_fit_nothing(spark):
    urls = spark.createDataFrame([(1, "http://a.org/x"), (2, None)], "page_id bigint, url string")
    rules = spark.createDataFrame([("block", None, "/"), ("block", "org", None), (None, "a.org", "/"), ("block", "a.org", "/x")], "verdict string, host string, path string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(urls, rules).collect()}
    assert got == {1: ("a.org/x", "block"), 2: (None, "allow")}


def test_line_dedup_with_text_keys_and_null_keys(spark):
    rows = [("b", "one line here\nanother longer line"), ("a", "another longer line\nthird"), (None, "third\nonly null"), (None, "third"), ("c", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted((tuple(r) for r in line_dedup.dedup_lines(df, removed="gone").collect()), key=repr)
    # null keys come first and lose nothing
    assert got == sorted([("b", "one line here", 1), ("a", "another longer line", 1), (None, "third\nonly null", 0), (None, "third", 0), ("c", None, 0)], key=repr)
    with pytest.raises(ValueError, match="TEXT"):
        line_dedup.dedup_lines(df, removed="TEXT")


def test_small_and_large_buckets_compare_the_same_members(spark, monkeypatch):
    from riskgrain.llm import linking

    base = "a line of some length that many rows share but for its end "
    rows = [(k, base + "xyzw"[k % 4] * 3 + str(k)) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    results = []
    for small in (1000, 2):
        monkeypatch.setattr(linking, "SMALL", small)
        results.append(sorted(tuple(r) for r in line_dedup.dedup_lines(df).collect()))
    assert results[0] == results[1]


def test_spans_of_many_addresses_equal_the_plain_rule():
    model, text = pii.train(), " ".join(["a@b.co 1.2.3.4", "+1 (555) 123-4567 x", "call 555 1234", "4111 1111 1111 1111.5@x.y"] * 30)
    base, spans = pii.all_spans(text, model)
    taken = [(a, b) for _, a, b in base]
    assert set(base) <= set(spans)
    assert all(all(z <= a or b <= y for a, b in taken) for k, y, z in set(spans) - set(base))


def test_ngram_join_moves_no_more_than_the_texts(spark, monkeypatch):
    word = lambda k: f"{k:04d}"
    texts = [" ".join(word(k) for k in range(s, s + 300)) for s in (0, 3, 6, 400, 405, 1000)] + ["a b c", "A b c", None, ""]
    sizes, whole = [], ngram_join.bucketed

    def measured(df, key):
        sizes.append(sum(len(v) for r in df.collect() for v in r if isinstance(v, (str, bytes, bytearray))))
        return whole(df, key)

    monkeypatch.setattr(ngram_join, "bucketed", measured)
    monkeypatch.setattr(ngram_join, "PIECE_BYTES", 2000)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(documents(spark, texts), "doc_id", bits=12).collect()}
    first = min(got)
    # 295 of 301 shingles and 293 of 303 are common to neighbours
    assert [got[first + k] - first for k in range(len(texts))] == [0, 0, 0, 3, 3, 5, 6, 6, 8, 9]
    assert sizes and all(s <= sum(len(t or "") for t in texts) for s in sizes)


def test_texts_of_the_join_meet_without_an_exchange_by_key(spark, monkeypatch):
    plans, whole = [], ngram_join.bucketed

    def seen(df, key):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return whole(df, key)

    monkeypatch.setattr(ngram_join, "bucketed", seen)
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(words[: 50 + k % 2])) for k in range(8)] + [(9, "a b c d"), (None, " ".join(words[:52])), (10, None)]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id").collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {**dict.fromkeys([*range(8), None], 0), 9: 9, 10: 10}
    assert len(plans) == 1 and "Join" not in plans[0]


def test_a_task_brings_equal_sets_once(spark):
    df = spark.createDataFrame([("a b c d",), ("A  b c d",), ("x y",), ("a b c d",)], "text string").coalesce(1)
    assert sorted(r["text"] for r in ngram_join.texts_by_set(df, "text", 3).collect()) == ["a b c d", "x y"]


@pytest.mark.parametrize("share", [0.85, 0.9, 0.97])
def test_similar_sets_share_a_part_and_others_do_not(share):
    rng, met = np.random.default_rng(5), 0
    for n in [1, 2, 5, 9, 10, 11, 13, 14, 19, 28, 40, 63, 100, 250, 700, 1500]:
        for _ in range(40):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            drop, add = rng.integers(0, int(n * (1 - share)) + 2, 2)
            b = np.unique(np.concatenate((rng.permutation(a)[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64))))
            c = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            keys, row, few = ngram_join.part_keys(np.concatenate((a, b, c)), np.cumsum([0, len(a), len(b), len(c)]), share)
            own = [set(keys[row == k].tolist()) for k in range(3)]
            common = len(np.intersect1d(a, b))
            if np.array_equal(a, b) or common < share * (len(a) + len(b) - common) - 1e-9:
                continue
            met += 1
            assert own[0] & own[1] or {0, 1} <= set(few.tolist())
            assert not own[0] & own[2]
    assert met > 40


def test_buckets_of_the_same_members_count_once(spark, monkeypatch):
    taken = []
    for module in (ngram_join, line_dedup):
        whole = module.connect
        monkeypatch.setattr(module, "connect", lambda members, *a, whole=whole: taken.append(members.count()) or whole(members, *a))
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(words), " ".join(words[:-1] + ["other"]), " ".join(f"v{k}" for k in range(300))]
    got = ngram_join.jaccard_components(documents(spark, texts), "doc_id", bits=12).collect()
    assert sorted(r["component_id"] for r in got) == [0, 0, 2]
    assert sorted(r["gone"] for r in line_dedup.dedup_lines(documents(spark, texts), removed="gone").collect()) == [0, 0, 1]
    assert taken == [2, 2]
