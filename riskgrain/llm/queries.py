"""The registered queries of the operators, with production parameters on whole tables, and their comparison SQL."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgrain.llm import bit_index, bpe, decontaminate, fingerprint, html_text, line_dedup, ngram_join, pii, quality, ranked_search, sharding, spelling, url_filter
from riskgrain.llm.common import sha_hex, table, unsettle, whole

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

SHARD_BYTES = 64 << 20
#: (verdict, host, path)
URL_RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def tokenizer_json(path: str = TOKENIZER) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_json())
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.digest_of_ids("ids").alias("ids_sha256"),
        sha_hex(F.col("decoded")).alias("decoded_sha256"),
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), limit=SHARD_BYTES)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, out="score")
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= quality.ACCEPTED).cast("int").alias("predicted"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), out="text")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.longest_matches(docs, table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    hit = decontaminate.hit_words("matches")
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        sha_hex(F.array_join(items, ",")).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", bit_index.quantised("embedding", 256).alias("embedding"))
    return bit_index.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), base="base_spans", spans="all_spans")
    named = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.KINDS), sha_hex(named("base_spans")).alias("base_sha256"), named("all_spans").alias("spans"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), "doc_id", size=3, share=0.9)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), removed="n_removed")
    return clean.select("doc_id", "n_removed", F.length(whole("text")).cast("long").alias("n_chars"), sha_hex(whole("text")).alias("text_sha256"))


def op11_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fingerprint.with_next(table(spark, sf_dir, "documents"), "doc_id", "text", out="following")
    pairs = pairs.withColumn("edited", fingerprint.edited("text", "following"))
    pairs = pairs.select("doc_id", F.length("text").cast("long").alias("n_chars"), sha_hex(F.col("edited")).alias("edited_sha256"), "text", "edited", "following")
    done = fingerprint.fingerprints(pairs, {"text": "own_sketch", "edited": "edited_sketch", "following": "next_sketch"})
    return done.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint.spelled("own_sketch").alias("fingerprint"),
        fingerprint.spelled("edited_sketch").alias("edited_fingerprint"), fingerprint.jaccard("own_sketch", "edited_sketch").alias("near_edited"),
        fingerprint.jaccard("own_sketch", "next_sketch").alias("near_next"),
    )


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranked_search.build_index(table(spark, sf_dir, "documents"), "doc_id", "text")
    found = ranked_search.search(index, table(spark, sf_dir, "benchmark"), "item_id", "text", key="doc_id", k=50)
    unsettle(index)
    return found.select("item_id", "rank", "doc_id", "score")


#: Runs whose CRC this number divides lose a letter; words have at least so many letters and occurrences; a form occurs so many times as often.
LOSES, LETTERS, OCCURRENCES, TIMES = 199, 6, 5, 5


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.word_counts(table(spark, sf_dir, "documents"), "doc_id", "text", letters=LETTERS, least=OCCURRENCES, every=LOSES)
    return spelling.variants(words, times=TIMES, least=LETTERS).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_sharding": op2_sharding,
    "op3_quality": op3_quality,
    "op4_html_text": op4_html_text,
    "op5_decontamination": op5_decontamination,
    "op6_top_k": op6_top_k,
    "op7_pii": op7_pii,
    "op8_url_filter": op8_url_filter,
    "op9_ngram_join": op9_ngram_join,
    "op10_line_dedup": op10_line_dedup,
    "op11_fingerprint": op11_fingerprint,
    "op12_ranked_search": op12_ranked_search,
    "op13_spelling": op13_spelling,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    # rows larger than a shard alone, then buckets split level by level
    "op2_sharding": f"""
WITH RECURSIVE r AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS bytes,
    row_number() OVER (PARTITION BY doc_id, strlen(coalesce(text, ''))) - 1 AS copy
  FROM documents),
h AS (
  SELECT *, ('0x' || substr(md5(CASE WHEN copy = 0 THEN coalesce(doc_id::VARCHAR, '')
    ELSE concat_ws('#', coalesce(doc_id::VARCHAR, ''), copy::VARCHAR, bytes::VARCHAR) END), 1, 15))::BIGINT AS h FROM r),
b AS (
  SELECT doc_id, copy, bytes, h, 0 AS depth, sum(bytes) OVER () AS total FROM h WHERE bytes <= {SHARD_BYTES}
  UNION ALL
  SELECT doc_id, copy, bytes, h, depth + 1, sum(bytes) OVER (PARTITION BY h >> (59 - depth)) FROM b
  WHERE total > {SHARD_BYTES} AND depth < 60)
SELECT doc_id, copy, bytes, depth, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(h >> (60 - depth)), depth, '0') END AS shard,
  total::BIGINT AS shard_bytes FROM b WHERE total <= {SHARD_BYTES}
UNION ALL
SELECT doc_id, copy, bytes, 60, '+' || coalesce(doc_id::VARCHAR, '') || '#' || copy, bytes FROM h WHERE bytes > {SHARD_BYTES}
""",
    "op5_decontamination": f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
g AS (
  SELECT doc_id, p, k, array_to_string(w[p : p + k - 1], ' ') AS gram
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, sizes WHERE len(w) >= k)),
m AS (SELECT doc_id, p, g.k, item_id FROM g JOIN win ON g.k = win.k AND g.gram = win.gram),
hits AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM m) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(hits.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
  sha256(coalesce(items.s, '')) AS items_sha256, hits.n IS NOT NULL AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op6_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op8_url_filter": f"""
WITH u AS (
  SELECT page_id, {_LOWER.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules(v, h, p) AS (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)}),
m AS (
  SELECT page_id, h || p AS rule, v,
    row_number() OVER (PARTITION BY page_id ORDER BY len(string_split(h, '.')) DESC, len(p) DESC, v DESC) AS n
  FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT u.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN m ON u.page_id = m.page_id AND n = 1
""",
    "op9_ngram_join": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda p: array_to_string(w[p : p + 2], ' ')) END) AS gram FROM d),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, k) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.k = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.k AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(k) AS k FROM r GROUP BY doc_id) AS m USING (doc_id)
""",
    "op10_line_dedup": """
WITH RECURSIVE lines AS (
  SELECT doc_id, generate_subscripts(s, 1) AS pos, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
u AS (SELECT line, min((doc_id, pos)) AS first FROM lines WHERE regexp_matches(line, '[^ \\t\\r\\x0b\\x0c]') GROUP BY line),
v AS (SELECT row_number() OVER (ORDER BY first) AS id, line, first FROM u),
g AS (SELECT DISTINCT id, line[p : p + 7] AS gram FROM (SELECT id, line, unnest(range(1, greatest(len(line) - 6, 2))) AS p FROM v)),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
p AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM g x JOIN g y ON x.gram = y.gram AND x.id < y.id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 10 * c >= 8 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, k) AS (SELECT id, id FROM v UNION SELECT r.id, e.b FROM r JOIN e ON r.k = e.a),
kept AS (SELECT v.line, v.first FROM v JOIN (SELECT id, min(k) AS k FROM r GROUP BY id) AS m USING (id) WHERE v.id = m.k),
t AS (
  SELECT lines.doc_id, pos, lines.line, v.line IS NULL OR kept.first = (lines.doc_id, pos) AS stays
  FROM lines LEFT JOIN v ON lines.line = v.line LEFT JOIN kept ON lines.line = kept.line),
c AS (
  SELECT doc_id, count(*) FILTER (NOT coalesce(stays, false)) AS gone, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '') AS text
  FROM t GROUP BY doc_id)
SELECT doc_id, coalesce(gone, 0)::BIGINT AS n_removed, len(coalesce(c.text, ''))::BIGINT AS n_chars, sha256(coalesce(c.text, '')) AS text_sha256
FROM documents LEFT JOIN c USING (doc_id)
""",
    "op11_fingerprint": f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
    coalesce(lead(coalesce(text, '')) OVER w, first_value(coalesce(text, '')) OVER w) AS f
  FROM documents WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT doc_id, t, f, substr(t, 1, len(t) - len(t) // 2) || substr(f, 1, len(t) // 2) AS e FROM d),
texts AS (SELECT doc_id, 't' AS k, t AS s FROM e UNION ALL SELECT doc_id, 'e', e FROM e UNION ALL SELECT doc_id, 'f', f FROM e),
words AS (
  SELECT doc_id, k, list_transform(regexp_extract_all({_LOWER.format("s")}, '[^\\x20\\x09-\\x0D]+'),
    lambda x: ('0x' || substr(md5(x), 1, 15))::BIGINT) AS w FROM texts),
grams AS (
  SELECT doc_id, k, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {fingerprint.SIZE} THEN [w]
    ELSE list_transform(range(1, len(w) - {fingerprint.SIZE - 2}), lambda p: w[p : p + {fingerprint.SIZE - 1}]) END) AS g FROM words),
h AS (SELECT DISTINCT doc_id, k, (({" + ".join(f"coalesce(g[{i + 1}], 0)::HUGEINT * {pow(fingerprint.MULTIPLIER, i, 1 << fingerprint.BITS)}" for i in range(fingerprint.SIZE))}) % {1 << fingerprint.BITS})::BIGINT AS h FROM grams),
kept AS (
  SELECT doc_id, k, h FROM (SELECT *, min(h) OVER (PARTITION BY doc_id, k) AS least FROM h)
  WHERE h < {(1 << fingerprint.BITS) // fingerprint.SCALE} OR h = least),
s AS (SELECT doc_id, k, count(*) AS n, string_agg(printf('%015x', h), ',' ORDER BY h) AS s FROM kept GROUP BY doc_id, k),
shared AS (SELECT a.doc_id, b.k, count(*) AS c FROM kept a JOIN kept b ON a.doc_id = b.doc_id AND a.h = b.h AND a.k = 't' AND b.k <> 't' GROUP BY ALL),
near AS (
  SELECT e.doc_id, x.k, CASE WHEN t.n IS NULL AND o.n IS NULL THEN 1.0::DOUBLE
    ELSE coalesce(c, 0)::DOUBLE / (coalesce(t.n, 0) + coalesce(o.n, 0) - coalesce(c, 0)) END AS near
  FROM e CROSS JOIN (VALUES ('e'), ('f')) x(k) LEFT JOIN s t ON t.doc_id = e.doc_id AND t.k = 't'
  LEFT JOIN s o ON o.doc_id = e.doc_id AND o.k = x.k LEFT JOIN shared ON shared.doc_id = e.doc_id AND shared.k = x.k)
SELECT e.doc_id, len(t)::BIGINT AS n_chars, sha256(e) AS edited_sha256, coalesce(a.s, '') AS fingerprint, coalesce(b.s, '') AS edited_fingerprint,
  x.near AS near_edited, y.near AS near_next
FROM e LEFT JOIN s a ON a.doc_id = e.doc_id AND a.k = 't' LEFT JOIN s b ON b.doc_id = e.doc_id AND b.k = 'e'
JOIN near x ON x.doc_id = e.doc_id AND x.k = 'e' JOIN near y ON y.doc_id = e.doc_id AND y.k = 'f'
""",
    "op12_ranked_search": f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
total AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d)
  WHERE term IN (SELECT term FROM i) GROUP BY doc_id, n, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, total GROUP BY term),
s AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM i JOIN p USING (term) JOIN w USING (term), total GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 50
""",
    # CRC-32 byte by byte over a table of its 256 steps; near words meet at what is left of them without one letter
    "op13_spelling": f"""
WITH RECURSIVE steps AS (SELECT [{", ".join(str(zlib.crc32(bytes([k]), 0xFFFFFFFF) ^ 0xFFFFFFFF) for k in range(256))}]::BIGINT[] AS t),
runs AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents)
  WHERE len(run) >= {LETTERS} GROUP BY doc_id, run),
c AS (
  SELECT run, times, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(x) // 2 + 1), lambda i: ('0x' || substr(x, 2 * i - 1, 2))::BIGINT)),
    lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295) AS h
  FROM (SELECT run, times, hex(encode(concat(doc_id, ':', run))) AS x FROM runs), steps),
r AS (
  SELECT CASE WHEN h % {LOSES} = 0 THEN substr(run, 1, (h % len(run))::INT) || substr(run, (h % len(run))::INT + 2) ELSE run END AS word, times FROM c),
v AS (SELECT word, sum(times)::BIGINT AS n FROM r WHERE len(word) >= {LETTERS} GROUP BY word HAVING sum(times) >= {OCCURRENCES}),
less AS (
  SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS p FROM v)),
pairs AS (
  SELECT a.word AS a, b.word AS b FROM less a JOIN less b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT less.word, v.word FROM less JOIN v ON less.rest = v.word
  UNION SELECT v.word, less.word FROM less JOIN v ON less.rest = v.word),
ranked AS (
  SELECT a, b, y.n AS bn, x.n AS an, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY y.n DESC, b COLLATE "C") AS k
  FROM pairs JOIN v x ON x.word = a JOIN v y ON y.word = b),
f AS (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN bn >= {TIMES} * n THEN b END AS form, CASE WHEN bn >= {TIMES} * n THEN bn END AS form_n
  FROM v LEFT JOIN ranked ON a = word AND k = 1),
walk(word, reached) AS (SELECT word, word FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.reached WHERE f.form IS NOT NULL)
SELECT f.word, f.form, walk.reached AS root, f.n, f.n_near, f.form_n FROM f JOIN walk ON walk.word = f.word JOIN f AS e ON e.word = walk.reached AND e.form IS NULL
""",
}
