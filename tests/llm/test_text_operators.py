"""BPE, quality, decontamination, PII and HTML text against brute force, and the awkward inputs of each."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgrain.llm import bpe, decontaminate, html_text, pii, quality
from riskgrain.llm.queries import tokenizer_json

ODD = [
    "", None, "  \n ", "a<|endoftext|>B's don't<|startoftext|>", "İstanbul ΣΑΣ ﬁ é é 中文字 ١٢٣ x²½", "\x00<|endoftext|> \x00", "I'LL we're !'s ''t",
    "A​B \x1c\x1d z\x85\xa0q ŉ ßẞ", "日本語テキスト", "😀😀 ok", "a" * 60_000, "word " * 30_000,
]


def documents(spark, texts, **extra):
    rows = [(k, t, *extra.values()) for k, t in enumerate(texts)]
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *(T.StructField(n, T.StringType()) for n in extra)]
    return spark.createDataFrame(rows, T.StructType(fields))


def test_bpe_equals_the_tokenizer(spark):
    from tokenizers import Tokenizer

    texts = [*ODD, "The same words again.", "The same words again."]
    df = documents(spark, texts, ids="clash", decoded="clash").unionByName(documents(spark, [None], ids="x", decoded="y").withColumn("doc_id", F.lit(None).cast("long")))
    got = {r["doc_id"]: r for r in bpe.encode_decode(df, tokenizer_json(), block_bytes=2000).collect()}
    whole = Tokenizer.from_str(tokenizer_json())
    for k, t in enumerate(texts):
        want = whole.encode(t or "", add_special_tokens=False).ids
        assert list(got[k]["ids"]) == want
        assert got[k]["decoded"] == whole.decode(want, skip_special_tokens=False)
    assert list(got[None]["ids"]) == []
    empty = bpe.encode_decode(documents(spark, []), tokenizer_json())
    assert empty.columns == ["doc_id", "ids", "decoded"] and empty.count() == 0


def test_bpe_keeps_equal_blocks_apart(spark):
    spec = tokenizer_json()
    rows = [(k, t) for k, t in enumerate(["the same text again " * 5] * 300 + [None, ""] * 300)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3), "doc_id bigint, text string")
    blocks = bpe._split_blocks(df, "doc_id", "text", spark.sparkContext.broadcast(spec), bpe.added_tokens(spec), 4, 1000)
    sizes = [r["count"] for r in blocks.where("bucket is null").groupBy("block").count().collect()]
    # a block has 1000 bytes of text; without text it is the rows of a batch
    assert sum(sizes) == len(rows) and sum(n <= 10 for n in sizes) >= 30 and max(sizes) <= 256
    got = bpe.encode_decode(df, spec, block_bytes=1000)
    assert got.count() == len(rows) and got.select("ids").distinct().count() == 2


def test_bpe_tells_blocks_with_other_row_boundaries_apart(spark):
    from tokenizers import Tokenizer

    texts = ["alpha beta", "gamma delta", "alpha bet", "agamma delta"]
    df = spark.createDataFrame(spark.sparkContext.parallelize(list(enumerate(texts)), 2), "doc_id bigint, text string")
    whole = Tokenizer.from_str(tokenizer_json())
    got = {r["doc_id"]: list(r["ids"]) for r in bpe.encode_decode(df, tokenizer_json()).collect()}
    assert got == {k: whole.encode(t, add_special_tokens=False).ids for k, t in enumerate(texts)}


def test_bpe_words_match_the_pre_tokenizer_below_the_plain_limit():
    from tokenizers import Tokenizer

    whole, split = Tokenizer.from_str(tokenizer_json()), bpe.Splitter(tokenizer_json(), list(bpe.added_tokens(tokenizer_json())))
    for c in range(0x300):
        text = "a" + chr(c) + "B1" + chr(c) + "'s"
        pieces = whole.pre_tokenizer.pre_tokenize_str(whole.normalizer.normalize_str(text))
        assert len(split.words(text)) == len(pieces), hex(c)


def test_bpe_decode_joins_pieces(spark):
    spec = tokenizer_json()
    df = spark.createDataFrame([([320, 1125, 49407],), (None,), ([],), ([10**8],)], "ids array<int>")
    pieces = dict(bpe.piece_table(spec))
    got = [r["decoded"] for r in bpe.decode(df, spec).collect()]
    assert got == [" ".join(pieces[i] for i in (320, 1125, 49407)), None, "", ""]


def test_statistics_and_scores_of_awkward_texts(spark):
    good = ["The quick brown fox jumps over the lazy dog, and then it rests. It was a fine day."] * 30
    rng = np.random.default_rng(0)
    good = [" ".join(rng.permutation(t.split())) for t in good]
    bad = [" ".join(w.upper() + "!!" for w in rng.permutation(t.split())) for t in good]
    docs = documents(spark, good + bad + ODD, score="x", statistics="y")
    labels = spark.createDataFrame([(k, 1 if k < 30 else 0) for k in range(60)] + [(0, None), (None, 1), (5, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    rows = quality.score(docs, model, out="_score").select("doc_id", "_score", "score").collect()
    got = {r["doc_id"]: r["_score"] for r in rows}
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 60 + len(ODD)
    assert min(got[k] for k in range(30)) > max(got[k] for k in range(30, 60))
    assert all(r["score"] == "x" for r in rows)
    none = quality.train(docs, labels.limit(0))
    assert {round(r["_score"], 6) for r in quality.score(docs, none, out="_score").collect()} == {0.5}


def test_density_difference_equals_the_formula():
    rng = np.random.default_rng(1)
    d = 3
    factors = np.stack([np.linalg.cholesky(a @ a.T + np.eye(d)) for a in rng.normal(size=(2, d, d))])
    model = quality.Discriminant(np.zeros(d), np.ones(d), rng.normal(size=(2, d)), factors, np.log([0.3, 0.7]))
    x = rng.normal(size=(20, d))
    log = []
    for c in (0, 1):
        cov = factors[c] @ factors[c].T
        delta = x - model.means[c]
        log.append(model.log_prior[c] - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", delta, np.linalg.inv(cov), delta))
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(log[0] - log[1])))


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(text, items, window=10):
    low = lambda t: (t or "").translate({i: i + 32 for i in range(65, 91)})
    w, hit, found = WORDS.findall(low(text)), set(), set()
    for k, t in items:
        v = WORDS.findall(low(t))
        size = min(window, len(v))
        grams = {tuple(v[p : p + size]) for p in range(len(v) - size + 1)} if v else set()
        for p in range(len(w) - size + 1):
            if size and tuple(w[p : p + size]) in grams:
                hit |= set(range(p, p + size))
                found.add(str(k))
    return len(w), len(hit), found


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_decontamination_equals_brute_force(spark, block_bytes):
    rng = np.random.default_rng(3)
    vocabulary = ["Ab", "cé", "dd", "e", "F1"]
    sentence = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(0, sentence(25)), (1, sentence(4)), (2, None), (3, " .. "), (4, "zz " * 12), (5, "zz " * 12), (6, sentence(13))]
    texts = [*ODD, *(sentence(int(n)) for n in rng.integers(0, 60, 40)), items[0][1], "x " + items[6][1].upper() + " y", "zz " * 40, items[1][1]]
    docs = documents(spark, texts, n_words="clash", matches="clash")
    tests = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.longest_matches(docs, tests, words="n", matches="m", block_bytes=block_bytes).withColumn("hit", decontaminate.hit_words("m"))
    for r in found.collect():
        assert (r["n"], r["hit"], {m["item_id"] for m in r["m"]}) == brute_hits(texts[r["doc_id"]], items)
    kept = {r["doc_id"] for r in decontaminate.decontaminate(docs, tests).collect()}
    assert kept == {k for k, t in enumerate(texts) if not brute_hits(t, items)[1]}
    assert decontaminate.decontaminate(docs, tests.limit(0)).count() == len(texts)
    assert decontaminate.decontaminate(docs.limit(0), tests).count() == 0


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(5)
    numbers = rng.integers(0, 3, 300)
    left = np.concatenate([np.arange(n, 0, -1) for n in (100, 1, 199)])
    order, _ = decontaminate.suffix_array(numbers, left, np.arange(300), 200)
    shown = [tuple(numbers[p : p + left[p]]) for p in order]
    assert shown == sorted(shown)


PATTERNS = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda s: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda s: all(int(x) <= 255 for x in s.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda s: 16 <= len(pii._digits(s)) <= 19 and pii.luhn(pii._digits(s))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda s: 8 <= len(pii._digits(s)) <= 15),
]


def test_base_spans_equal_the_patterns():
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("1234+@. ()-ab:%"), 60)) for _ in range(3000)]
    texts += ["a@b.c@d.e.f", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "9" * 4000, "x" * 4000 + "@b.c", "+49 (0)30.123-4", "0001.2.3.00255"]
    for t in texts:
        assert pii.base_spans(t) == [(k, m.start(), m.end()) for k, p, ok in PATTERNS for m in p.finditer(t) if ok(m.group())], t[:80]


def test_random_field_sums_and_best_path_equal_enumeration():
    rng = np.random.default_rng(4)
    crf = pii.SemiCrf(rng.normal(size=(5, len(pii.FEATURES))), rng.normal(size=(5, 5)))
    text = "555 123 4567 890"
    lattice = pii.Lattice(text, pii.clusters(text)[0])
    n = len(lattice.bounds)

    def paths(j, y, score, spans):
        if j == n - 1:
            yield score, spans
            return
        yield from paths(j + 1, 0, score + crf.move[y, 0], spans)
        for end in range(j + 1, n):
            for i, f in lattice.ending[end]:
                if i == j:
                    for c in range(1, 5):
                        yield from paths(end, c, score + crf.move[y, c] + crf.emit[c] @ f, [*spans, (pii.LABELS[c], lattice.bounds[j], lattice.bounds[end])])

    every = list(paths(0, 0, 0.0, []))
    total, _, _ = crf.expected(lattice)
    assert np.isclose(total, np.log(sum(np.exp(s) for s, _ in every)))
    assert crf.best(lattice) == max(every, key=lambda x: x[0])[1]


def test_trained_field_on_held_out_sentences(spark):
    model = pii.train()
    wrong = 0
    examples = pii.labelled_examples(200, 99)
    for text, spans in examples:
        found = [s for c in pii.clusters(text) for s in model.best(pii.Lattice(text, c))]
        wrong += sorted(found) != sorted(spans)
    assert wrong <= 6
    texts = [*ODD, "write to jane [at] corp [dot] com or call (415) 555-0123", "ip 10.0.0.1, card 4111 1111 1111 1111, a@b.co"]
    docs = documents(spark, texts, spans="clash", base_spans="clash")
    rows = pii.find_spans(docs, model=model, base="b", spans="s").collect()
    assert [(s["kind"], texts[len(ODD)][s["start"] : s["end"]]) for s in rows[len(ODD)]["s"]] == [("email", "jane [at] corp [dot] com"), ("phone", "(415) 555-0123")]
    assert [s["kind"] for s in rows[len(ODD) + 1]["b"]] == ["email", "ip", "card"]
    assert pii.redact(docs, model=model).collect()[len(ODD) + 1]["text"] == "ip [ip], card [card], [email]"
    assert pii.redact(docs, model=model).columns == docs.columns
    assert pii.find_spans(docs.limit(0), model=model, base="b", spans="s").count() == 0


def test_tree_marginals_equal_enumeration():
    nodes = html_text.parse("<div><p>a</p><ul><li>b</li></ul></div>c")
    rng = np.random.default_rng(6)
    model = html_text.TreeModel(rng.normal(size=len(html_text.FEATURES)), rng.normal(size=(2, 2)))
    x = html_text.node_features(nodes)
    n = len(nodes)
    weights = {}
    for k in range(2**n):
        y = [(k >> i) & 1 for i in range(n)]
        weights[tuple(y)] = np.exp(sum(x[i] @ model.weight * y[i] for i in range(n)) + sum(model.edge[y[nodes[i].parent], y[i]] for i in range(1, n)))
    z = sum(weights.values())
    p, pair, log_z = model.marginals(nodes, x)
    assert np.isclose(log_z, np.log(z))
    assert np.allclose(p, [sum(w for y, w in weights.items() if y[i]) / z for i in range(n)])
    assert np.allclose(pair[1:].sum(axis=(1, 2)), 1)


def test_html_text(spark):
    model = html_text.train()
    right = 0
    for nodes, y in html_text.labelled_pages(100, 77):
        p, _, _ = model.marginals(nodes, html_text.node_features(nodes))
        right += html_text.blocks(nodes, p > 0.5) == html_text.blocks(nodes, y == 1)
    assert right >= 97
    body = "<nav><a href=/>Home</a></nav><!-- ad --><div class=ad>Buy this now.</div><article><h1>A &amp; B</h1><p><b>First  line<br>of text.<p>Second &lt;p&gt; one.</p></article><footer>&copy; x</footer>"
    pages = [body, None, "", "<", "plain words only. Yes.", "<p>" * 3000 + "deep", body * 1 + "<script>var t='</p>';</script>", "</div></p><article><p>Cut <"]
    df = documents(spark, pages, url="u").withColumnRenamed("text", "html").withColumn("n_chars", F.lit(1))
    got = [r["text"] for r in html_text.extract(df, model=model).orderBy("doc_id").collect()]
    assert got[0] == got[6] == "A & B\n\nFirst line of text.\n\nSecond <p> one."
    assert got[1] == got[2] == "" and got[4] == "plain words only. Yes." and got[7].startswith("Cut")
    assert html_text.extract(df.limit(0), model=model).count() == 0


def test_digest_of_ids(spark):
    got = spark.createDataFrame([([1, 22],), ([],)], "ids array<int>").select(bpe.digest_of_ids("ids").alias("h")).collect()
    assert [r["h"] for r in got] == [hashlib.sha256(b"1 22").hexdigest(), hashlib.sha256(b"").hexdigest()]
