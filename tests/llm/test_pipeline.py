"""The corpus pipeline on the smallest tables, each stage against brute force on what the stage before kept."""

from __future__ import annotations

import hashlib
import itertools

import corpus_pipeline
from riskgrain.llm import line_dedup, quality
from riskgrain.llm.common import settle, table
from riskgrain.llm.queries import QUERIES, tokenizer_json
from tests.llm.test_link_operators import brute_links, gram_sets, roots
from tests.llm.test_text_operators import PATTERNS, brute_hits

FOLDER = "/root/testdata/sf0.001"


def test_every_stage_on_its_own_input(spark):
    docs = table(spark, FOLDER, "documents")
    columns, before, out = docs.columns, None, None
    names = [n for n, _ in corpus_pipeline.STAGES]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = settle(stage(spark, docs, FOLDER))
        after = {r["doc_id"]: r for r in docs.collect()}
        if name != names[-1]:
            assert docs.columns == columns
        assert set(after) <= set(before)
        if name == "quality classifier":
            model = quality.train(table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels"))
            scores = {r["doc_id"]: r["s"] for r in quality.score(table(spark, FOLDER, "documents"), model, out="s").collect()}
            assert set(after) == {k for k, s in scores.items() if s >= quality.ACCEPTED}
            assert all(after[k]["text"] == before[k]["text"] for k in after)
        elif name == "line dedup":
            first, order = {}, sorted(before)
            for k in order:
                for i, s in enumerate((before[k]["text"] or "").split("\n")):
                    if s.strip(" \t\r\x0b\x0c"):
                        first.setdefault(s, (k, i))
            lines = list(first)
            grams = [line_dedup._shingles(s, 8) for s in lines]
            links = [(i, j) for i, j in itertools.combinations(range(len(lines)), 2) if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]) - 1e-9]
            top = roots(range(len(lines)), links)
            kept = {lines[k]: first[lines[k]] for k in top if top[k] == k}
            for k in order:
                parts = (before[k]["text"] or "").split("\n")
                want = [s for i, s in enumerate(parts) if s not in first or kept.get(s) == (k, i)]
                assert (k in after) == (len(want) == len(parts) or bool("".join(want).strip()))
                if k in after:
                    assert after[k]["text"] == "\n".join(want) and after[k]["n_chars"] == len(after[k]["text"])
        elif name == "n-gram Jaccard join":
            keys = sorted(before)
            sets = gram_sets([before[k]["text"] for k in keys], 5)
            top = roots(range(len(keys)), brute_links(sets, 0.8))
            assert set(after) == {keys[k] for k in top if top[k] == k}
        elif name == "benchmark decontamination":
            items = [(r["item_id"], r["text"]) for r in table(spark, FOLDER, "benchmark").collect()]
            assert set(after) == {k for k in before if not brute_hits(before[k]["text"], items)[1]}
        else:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_str(tokenizer_json())
            assert set(after) == set(before)
            for k, r in after.items():
                want = whole.encode(before[k]["text"] or "", add_special_tokens=False).ids
                assert list(r["ids"]) == want and r["n_tokens"] == len(want)
        out = docs
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.columns == out.columns and {r["doc_id"] for r in got.collect()} == {r["doc_id"] for r in out.collect()}


def test_operator_queries_have_the_contracts_columns(spark):
    want = {
        "op1_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
        "op3_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
        "op4_html_text": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
        "op7_pii": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    }
    for name, columns in want.items():
        assert dict(QUERIES[name](spark, FOLDER).dtypes) == columns, name


def test_quality_on_the_held_out_fold(spark):
    scored = QUERIES["op3_quality"](spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "labels"), "doc_id")
    rows = scored.where("held_out").select("predicted", "quality").collect()
    assert len(rows) > 50 and sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.97


def test_pii_query_equals_the_patterns(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, "/root/testdata/sf0.01", "documents").collect()}
    for r in QUERIES["op7_pii"](spark, "/root/testdata/sf0.01").collect():
        t = texts[r["doc_id"]]
        spans = [(k, m.start(), m.end()) for k, p, ok in PATTERNS for m in p.finditer(t) if ok(m.group())]
        shown = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest()
        assert [r[f"n_{k}"] for k, _, _ in PATTERNS] == [sum(s[0] == k for s in spans) for k, _, _ in PATTERNS]
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(r["spans"].split(",")) | {""}


def test_stages_keep_columns_that_clash_with_their_own(spark):
    rows = [(1, "a first line of words\nthe same line here", "en", "s", 41, 7, 8, 0.5), (2, "other words\nthe same line here", "en", "s", 30, 7, 8, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, _removed int, n_removed int, score double")
    got = sorted(tuple(r) for r in corpus_pipeline.drop_repeated_lines(spark, docs, FOLDER).collect())
    assert got == [rows[0], (2, "other words", "en", "s", 11, 7, 8, 0.5)]
    assert corpus_pipeline.keep_good(spark, docs, FOLDER).columns == docs.columns


def test_encoding_in_the_pipeline_takes_smaller_blocks_with_the_same_ids(spark, monkeypatch):
    taken, whole = [], corpus_pipeline.bpe.encode_decode
    monkeypatch.setattr(corpus_pipeline.bpe, "encode_decode", lambda *a, **k: taken.append(k["block_bytes"]) or whole(*a, **k))
    docs = spark.createDataFrame([(1, "one two two"), (2, None), (3, "Two, three")], "doc_id bigint, text string")
    got = sorted((r["doc_id"], list(r["ids"])) for r in corpus_pipeline.encode(spark, docs, "").collect())
    assert taken[0] < corpus_pipeline.bpe.BLOCK_BYTES
    assert got == sorted((r["doc_id"], list(r["ids"])) for r in whole(docs, corpus_pipeline.tokenizer_json()).collect())
