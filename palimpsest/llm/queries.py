"""One query for each operator, over the whole of its table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import ann, bpe, decontaminate, jaccard, language, negatives, packing, paragraphs, pii, quality, repeats, secrets, spelling, warc
from palimpsest.llm.sampling import fold
from palimpsest.llm.text import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_quality")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0)
    scored = quality.classify(docs, labels.select("doc_id", F.col("quality").alias("label")), keep=["doc_id"])
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query("op2_language")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, docs.where(fold(F.col("doc_id"), 4) != 2), keep=["doc_id"])
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def _count(spans: str, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op3_personal")
def _(spark, sf_dir):
    found = pii.find_personal(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select(
        "doc_id", *[_count("base", k).alias(f"n_{k}") for k in pii.BASE], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


@query("op8_secrets")
def _(spark, sf_dir):
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    return found.select(
        "doc_id", *[_count("spans", k).alias(f"n_{k}") for k in secrets.BASE], F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


SIMILAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, least(len(ws), 1)))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS id, a AS reached FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reached)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.m, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT id, min(reached) AS m FROM r GROUP BY 1) c ON c.id = d.doc_id
"""


@query("op6_similar", SIMILAR_SQL)
def _(spark, sf_dir):
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


PASSAGES_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i : i + 9], ' ') AS g
  FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(ws[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)),
h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
k AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS w FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY 1)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(k.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(t.items, '')) AS items_sha256, coalesce(k.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query("op10_decontaminate", PASSAGES_SQL)
def _(spark, sf_dir):
    found = decontaminate.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    hit = F.aggregate("hits", F.lit(0), lambda total, h: total + h["end"] - h["start"])
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), hit.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


@query("op5_bpe")
def _(spark, sf_dir):
    import public_tokenizers

    vocabulary = bpe.Vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoded = bpe.encode(table(spark, sf_dir, "documents"), vocabulary, keep=["doc_id"])
    digested = encoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids", "ends"
    )
    decoded = bpe.decode(digested, vocabulary, keep=["doc_id", "n_tokens", "ids_sha256"])
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op7_neighbours")
def _(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op11_packing")
def _(spark, sf_dir):
    import public_tokenizers

    cut_up = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])
    return packing.pack(cut_up.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


NEGATIVES_SQL = r"""
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, coalesce(list_sum(list_transform(list_zip(a.v, c.v), lambda z: z[1] * z[2])), 0)::BIGINT AS score
  FROM r a JOIN r c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS k, s.vec_id AS negative_id,
    p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, k::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE k <= 3
"""


@query("op13_negatives", NEGATIVES_SQL)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.transform("embedding", lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), F.floor(256 * x.cast("double")))).alias("vector"),
    )
    return negatives.mine(rows, F.col("vec_id") % 50 == 0)


SPELLING_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS w FROM documents),
f AS (SELECT doc_id, w, count(*) AS k FROM d WHERE length(w) >= 7 GROUP BY 1, 2),
b AS (SELECT *, list_concat(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':', ''), lambda x: ord(x)),
  flatten(list_transform(string_split(w, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)] ELSE [192 + ord(x) // 64, 128 + ord(x) % 64] END)))::BIGINT[] AS bytes FROM f),
h AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, bytes),
  lambda c, y: list_reduce([xor(c, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))) AS crc FROM b),
v AS (SELECT CASE WHEN crc % 31 = 0 THEN left(w, (crc % length(w))::INTEGER) || substr(w, (crc % length(w))::INTEGER + 2) ELSE w END AS word, k FROM h),
c AS (SELECT word, sum(k)::BIGINT AS n FROM v WHERE length(word) >= 7 GROUP BY 1 HAVING sum(k) >= 2),
g AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM c)),
p AS (SELECT a.word, b.word AS near, b.n AS m FROM g a JOIN g b ON a.i = b.i AND a.less = b.less AND length(a.word) = length(b.word) AND a.word <> b.word
  UNION SELECT g.word, c.word, c.n FROM g JOIN c ON c.word = g.less UNION SELECT c.word, g.word, g.n FROM g JOIN c ON c.word = g.less),
s AS (SELECT word, count(*) AS n_near, max(m) AS m, first(near ORDER BY m DESC, near) AS near FROM p GROUP BY 1),
o AS (SELECT c.word, c.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 10 * n THEN near END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM c LEFT JOIN s USING (word)),
r(word, root, form) AS (SELECT word, word, form FROM o UNION ALL SELECT r.word, o.word, o.form FROM r JOIN o ON o.word = r.form)
SELECT o.word, o.form, r.root, o.n, o.n_near, o.form_n FROM o JOIN r ON r.word = o.word AND r.form IS NULL
"""


@query("op12_spelling", SPELLING_SQL)
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    words = spelling.count_words(docs, least=7, change=spelling.drop_letters("doc_id"), keep=["doc_id"])
    return spelling.group_variants(words.where("n >= 2"))


@query("op4_paragraphs")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return paragraphs.repeated_paragraphs(docs).unionByName(repeats.repeated_passages(docs))


def _warc_sql() -> str:
    text = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
    for name in warc.DROPPED:
        text = rf"regexp_replace({text}, '(?is)<{name}\b[^>]*>.*?</{name}\s*>', '', 'g')"
    text = rf"regexp_replace({text}, '(?i)</?({warc.BREAKING})\b[^>]*>', chr(10), 'g')"
    text = rf"regexp_replace({text}, '</?[A-Za-z!][^>]*>', '', 'g')"
    for name, char in warc.NAMED.items():
        text = f"replace({text}, '&{name};', chr({ord(char)}))"
    text = rf"regexp_replace({text}, '[ \t\r\f]+', ' ', 'g')"
    text = rf"trim(regexp_replace({text}, ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10))"
    uuid = "'<urn:uuid:' || {0}[1:8] || '-' || {0}[9:12] || '-' || {0}[13:16] || '-' || {0}[17:20] || '-' || {0}[21:32] || '>'"
    return rf"""
WITH p AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS html FROM pages),
r AS (SELECT *, md5('response ' || page_id || ' ' || target_uri) AS m, 'sha256:' || sha256(html) AS source_digest,
  'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) AS source_headers FROM p),
b AS (SELECT *, {uuid.format("m")} AS refers_to,
  array_to_string(list_concat(['source-payload-digest: ' || source_digest,
    'title: ' || trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title\s*>', 1), '\s+', ' ', 'g')),
    'language: ' || regexp_extract(html, '(?i)<html[^>]*\slang="([^"]*)"', 1)],
    list_transform(list_filter(string_split(source_headers, chr(13) || chr(10)), lambda s: s <> ''), lambda s: 'source-header: ' || s),
    list_transform(regexp_extract_all(html, '(?i)<a\s[^>]*?href="([^"]*)"', 1), lambda s: 'outlink: ' || s)), chr(13) || chr(10)) || chr(13) || chr(10) AS meta,
  {text} AS body FROM r),
e AS (SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type, meta AS block, md5('metadata ' || refers_to) AS h FROM b
  UNION ALL SELECT *, 'conversion', 'text/plain; charset=utf-8', body, md5('conversion ' || refers_to) FROM b)
SELECT page_id, record_type, {uuid.format("h")} AS record_id, refers_to, target_uri, '1970-01-01T00:00:00Z' AS date, content_type, block,
  'sha256:' || sha256(block) AS block_digest, source_digest, source_headers FROM e
"""


@query("op9_warc", _warc_sql())
def _(spark, sf_dir):
    return warc.derive(warc.responses(table(spark, sf_dir, "pages"), keep=["page_id"]), keep=["page_id"])
