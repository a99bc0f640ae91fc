"""Queries of snapshots, probes and retention over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest import fixed
from palimpsest.catalog.registry import query
from palimpsest.functions.stats import wilson95
from palimpsest.functions.text import word_set
from palimpsest.operators import probes as pr
from palimpsest.operators import retention as rt
from palimpsest.operators import snapshots as sn
from palimpsest.session import cut
from palimpsest.sources.tables import table


def record_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as snapshot records: a source is a snapshot."""
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("snapshot_sha"), F.col("doc_id").alias("record_index"),
        F.col("text").alias("raw"), F.sha2("text", 256).alias("record_sha"), F.col("lang").alias("type"),
        F.octet_length("text").cast("long").alias("bytes"),
    )


def index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the snapshot index: a user is a session, a page of its events a snapshot."""
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("append_order"),
        F.unix_seconds("ts").alias("ts"),
        F.sha2(F.concat_ws(":", F.col("user_id").cast("string"), k.cast("string")), 256).alias("sha256"),
        F.lit("p").alias("path"),
        F.col("user_id").cast("string").alias("session_id"),
        F.when(F.col("user_id") % 2 == 0, fixed.BRANCH).otherwise(fixed.WINDOW).alias("provider"),
        F.round("value").cast("long").alias("bytes"),
        F.when(kind == "error", "pre-compact").when(kind == "signup", "post-compact").alias("strategy"),
        k.alias("k"),
    )


INDEX = f"""
WITH i AS (SELECT event_id AS append_order, epoch_us(ts) // 1000000 AS sec, user_id::VARCHAR AS session_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
  sha256(user_id || ':' || CAST(json_extract(props, '$.k') AS BIGINT)) AS sha, CASE WHEN user_id % 2 = 0 THEN '{fixed.BRANCH}' ELSE '{fixed.WINDOW}' END AS provider,
  round(value)::BIGINT AS bytes, CASE event_type WHEN 'error' THEN 'pre-compact' WHEN 'signup' THEN 'post-compact' END AS strategy FROM events)
"""


@query(
    "record_search",
    """SELECT source AS snapshot_sha, count(*) FILTER (contains(text, 'the')) AS matched_records,
  sum((strlen(text) - strlen(replace(text, 'the', ''))) // 3)::BIGINT AS matches FROM documents GROUP BY 1""",
)
def _(spark, sf_dir):
    return sn.search_records(record_rows(spark, sf_dir), "the", text=F.col("raw"))[1].select(
        "snapshot_sha", "matched_records", "matches"
    )


@query(
    "record_search_first",
    """SELECT snapshot_sha, record_index FROM (SELECT source AS snapshot_sha, doc_id AS record_index, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r
 FROM documents WHERE contains(text, 'the')) WHERE r <= 5""",
)
def _(spark, sf_dir):
    return sn.search_records(record_rows(spark, sf_dir), "the", 5, text=F.col("raw"))[0].select(
        "snapshot_sha", "record_index"
    )


@query(
    "record_search_json",
    """SELECT sum((strlen(text) - strlen(replace(text, 'an', ''))) // 2)::BIGINT AS matches, count(*) FILTER (contains(text, 'an')) AS matched_records FROM conversations""",
)
def _(spark, sf_dir):
    """Conversation turns as JSON records; only decoded string values are searched."""
    rows = table(spark, sf_dir, "conversations").select(
        F.lit("conversations").alias("snapshot_sha"), F.col("turn").alias("record_index"),
        F.to_json(F.struct(F.struct(F.col("text").alias("ban")).alias("message"))).alias("raw"),
    )
    return sn.search_records(rows, "an")[1].select("matches", "matched_records")


@query("record_pages")
def _(spark, sf_dir):
    return sn.record_page(record_rows(spark, sf_dir).select("record_index", "raw"), 101, 64)


@query(
    "snapshot_diff",
    """WITH a AS (SELECT sha256(text) AS h FROM documents WHERE lang = 'fr'), b AS (SELECT sha256(text) AS h FROM documents WHERE lang <> 'fr')
SELECT 'removed' AS change, count(*) AS records FROM a WHERE h NOT IN (SELECT h FROM b) HAVING count(*) > 0
UNION ALL SELECT 'added', count(*) FROM b WHERE h NOT IN (SELECT h FROM a) HAVING count(*) > 0""",
)
def _(spark, sf_dir):
    rows = record_rows(spark, sf_dir).select("record_index", "record_sha", "type")
    changes, _types = sn.diff(rows.filter(F.col("type") == "fr"), rows.filter(F.col("type") != "fr"))
    return changes.groupBy("change").agg(F.sum("records").alias("records"))


@query(
    "snapshot_types",
    "SELECT 'a' AS side, source AS type, count(*) AS records FROM documents WHERE lang = 'fr' GROUP BY 2 UNION ALL SELECT 'b', source, count(*) FROM documents WHERE lang = 'de' GROUP BY 2",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("record_index"), F.sha2("text", 256).alias("record_sha"),
        F.col("source").alias("type"), "lang",
    )
    a, b = rows.filter(F.col("lang") == "fr").drop("lang"), rows.filter(F.col("lang") == "de").drop("lang")
    return sn.diff(a, b)[1]


@query(
    "snapshot_ingest",
    "SELECT count(DISTINCT text) AS stored FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE lang = 'de')",
)
def _(spark, sf_dir):
    rows = record_rows(spark, sf_dir)
    held = rows.filter(F.col("type") == "de").select("record_sha").distinct()
    bodies, _refs = sn.ingest_snapshots(rows.select("snapshot_sha", "record_index", "raw"), held)
    return bodies.groupBy().agg(F.count("*").alias("stored"))


@query(
    "prune_plan",
    INDEX + """, kept AS (SELECT DISTINCT sha FROM (SELECT *, row_number() OVER (PARTITION BY provider, session_id ORDER BY append_order DESC) AS r FROM i) WHERE r <= 10),
refs AS (SELECT sha, sha256('record:' || k) AS rec, k * 10 AS b FROM i),
bodies AS (SELECT rec, max(b) AS b FROM refs GROUP BY 1), live AS (SELECT DISTINCT rec FROM refs WHERE sha IN (SELECT sha FROM kept))
SELECT count(*) AS records_removed, coalesce(sum(b), 0)::BIGINT AS bytes_reclaimed FROM bodies WHERE rec NOT IN (SELECT rec FROM live)""",
)
def _(spark, sf_dir):
    index = index_rows(spark, sf_dir)
    refs = index.select(
        F.col("sha256").alias("snapshot_sha"),
        F.sha2(F.concat(F.lit("record:"), F.col("k").cast("string")), 256).alias("record_sha"),
        (F.col("k") * 10).alias("bytes"),
    )
    return sn.prune_plan(index.drop("k"), refs, 10)[2]


@query(
    "prune_dropped",
    INDEX + """SELECT session_id, count(*) AS dropped FROM (SELECT *, row_number() OVER (PARTITION BY provider, session_id ORDER BY append_order DESC) AS r FROM i) WHERE r > 10 GROUP BY 1""",
)
def _(spark, sf_dir):
    index = index_rows(spark, sf_dir)
    refs = index.select(F.col("sha256").alias("snapshot_sha"), F.col("sha256").alias("record_sha"), "bytes")
    return sn.prune_plan(index, refs, 10)[0].groupBy("session_id").agg(F.count("*").alias("dropped"))


@query(
    "index_accounting",
    INDEX + """SELECT count(*) AS entries, count(DISTINCT (provider, session_id)) AS streams, count(DISTINCT sha) AS objects, sum(bytes)::BIGINT AS bytes, min(sec) AS first_ts, max(sec) AS last_ts FROM i""",
)
def _(spark, sf_dir):
    return sn.index_accounting(index_rows(spark, sf_dir))[0]


@query("index_origins", INDEX + "SELECT coalesce(strategy, 'snapshot') AS origin, count(*) AS entries FROM i GROUP BY 1")
def _(spark, sf_dir):
    return sn.index_accounting(index_rows(spark, sf_dir))[1]


@query(
    "latest_snapshots",
    INDEX + """SELECT session_id, arg_max(sha, append_order) AS sha256 FROM (SELECT * FROM i WHERE session_id LIKE '1%') WHERE strategy = 'pre-compact' GROUP BY 1""",
)
def _(spark, sf_dir):
    index = index_rows(spark, sf_dir).withColumn("path", F.col("session_id"))
    return sn.latest_per_path(sn.snapshots(index, "1"), "pre-compact").select("session_id", "sha256")


@query(
    "snapshot_history",
    INDEX + """SELECT provider, session_id, count(*) AS snapshots, min(sec) AS first_ts, max(sec) AS last_ts, arg_max(bytes, append_order) AS latest_bytes,
  count(*) FILTER (strategy = 'pre-compact') AS pre_compact, count(*) FILTER (strategy = 'post-compact') AS post_compact FROM i GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    return sn.history(index_rows(spark, sf_dir))


@query(
    "compaction_pairs",
    INDEX + """, p AS (SELECT *, lag(sha) OVER w AS bs, lag(k % 4) OVER w AS bm, lag(strategy) OVER w AS bl, k % 4 AS m FROM i WINDOW w AS (PARTITION BY provider, session_id ORDER BY append_order)),
q AS (SELECT *, CASE WHEN m > bm THEN 'provider_native' WHEN bl = 'pre-compact' THEN 'surgery_next' END AS how FROM p WHERE bs IS NOT NULL AND bs <> sha)
SELECT session_id, append_order, how FROM (SELECT *, row_number() OVER (PARTITION BY provider, session_id ORDER BY append_order DESC) AS r FROM q WHERE how IS NOT NULL) WHERE r <= 5""",
)
def _(spark, sf_dir):
    index = index_rows(spark, sf_dir)
    markers = index.select("sha256", (F.col("k") % 4).alias("markers")).distinct()
    return sn.compaction_pairs(index, markers).select("session_id", "append_order", "how")


@query(
    "record_integrity",
    "SELECT count(*) AS damaged FROM documents WHERE doc_id % 50 = 3",
)
def _(spark, sf_dir):
    rows = record_rows(spark, sf_dir)
    bad = rows.withColumn(
        "raw", F.when(F.col("record_index") % 50 == 3, F.concat("raw", F.lit("!"))).otherwise(F.col("raw"))
    )
    return sn.verify_records(bad).groupBy().agg(F.count("*").alias("damaged"))


@query("recalled_cards")
def _(spark, sf_dir):
    """State cards of conversations, rendered, parsed back and searched."""
    from palimpsest.catalog.planning import conversations
    from palimpsest.plans.card import render_card
    from palimpsest.plans.planners import plan_compacted

    plans = plan_compacted(conversations(spark, sf_dir)).plans
    cards = plans.select(
        F.sha2("session_id", 256).alias("snapshot_sha"), F.lit(0).cast("long").alias("ts"), "provider",
        "session_id", F.lit(0).alias("record_index"), render_card("card").alias("text"),
    )
    return sn.recall(cards, "the").select("session_id", "score", "card.covers_items")


# --- probes and retention ----------------------------------------------------------------

Z = f"{fixed.WILSON_Z}::DOUBLE"
Z2 = f"{fixed.WILSON_Z2}::DOUBLE"


@query(
    "wilson_by_lang",
    f"""WITH c AS (SELECT lang, sum(quality)::DOUBLE AS k, count(*)::DOUBLE AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT lang, round(greatest((k / n + {Z2} / (n * 2.0)) / (1.0 + {Z2} / n) - {Z} * sqrt((k / n * (1.0 - k / n) + {Z2} / (n * 4.0)) / n) / (1.0 + {Z2} / n), 0.0), 9) AS low,
 round(least((k / n + {Z2} / (n * 2.0)) / (1.0 + {Z2} / n) + {Z} * sqrt((k / n * (1.0 - k / n) + {Z2} / (n * 4.0)) / n) / (1.0 + {Z2} / n), 1.0), 9) AS high FROM c""",
)
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    tally = table(spark, sf_dir, "labels").join(docs, "doc_id").groupBy("lang").agg(
        F.sum("quality").alias("k"), F.count("*").alias("n")
    )
    low, high = wilson95("k", "n")
    return tally.select("lang", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


def document_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.col("lang").alias("session_id"), F.col("doc_id").alias("line_index"), "text"
    )


@query("probes")
def _(spark, sf_dir):
    return pr.extract_probes(document_lines(spark, sf_dir), ["session_id"])


@query("probe_recall")
def _(spark, sf_dir):
    """Probes of all documents, looked for in those the oldest-first planner would keep."""
    from palimpsest.catalog.planning import documents
    from palimpsest.plans.planners import plan_elide

    keys = ["session_id"]
    lines = document_lines(spark, sf_dir)
    found = cut(pr.extract_probes(lines, keys), "probes")
    p = documents(spark, sf_dir)
    gone = plan_elide(p).edits.select("session_id", "line_index")
    kept = lines.join(gone, ["session_id", "line_index"], "left_anti")
    tail = pr.tail_start(p.items, keys, 8)
    return pr.score_probes(pr.survival(found, kept, keys), keys, tail)


@query(
    "tail_start",
    "SELECT lang AS session_id, min(doc_id) AS tail_line FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) AS r FROM documents WHERE strlen(text) > 256) WHERE r <= 8 GROUP BY 1",
)
def _(spark, sf_dir):
    from palimpsest.sources.tables import document_items

    return pr.tail_start(document_items(spark, sf_dir), ["session_id"], 8)


@query(
    "probe_probabilities",
    """WITH p AS (SELECT lang AS session_id, doc_id, CASE WHEN doc_id % 9 <> 0 THEN quality * 0.6 + (doc_id % 5) * 0.1 END AS p FROM labels JOIN documents USING (doc_id))
SELECT session_id, count(*) AS probes_requested, count(*) FILTER (p BETWEEN 0 AND 1) AS probes_total, count(*) FILTER (p BETWEEN 0.5 AND 1) AS probes_recalled FROM p GROUP BY 1""",
)
def _(spark, sf_dir):
    """Labelled documents as probes, judged by supplied probabilities; some missing or out of range."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        F.col("lang").alias("session_id"), F.col("doc_id").alias("probe_index"),
        F.col("doc_id").alias("line_index"), F.lit("fact").alias("kind"), F.lit("x").alias("text"),
        F.when(
            F.col("doc_id") % 9 != 0,
            (F.col("quality") * F.lit(0.6).cast("decimal(3,1)") + F.col("doc_id") % 5 * F.lit(0.1).cast("decimal(3,1)")),
        ).cast("double").alias("probability"),
    )
    judged = pr.survival_from_probabilities(rows.drop("probability"), rows, ["session_id"])
    return pr.score_probes(judged, ["session_id"]).select(
        "session_id", "probes_requested", "probes_total", "probes_recalled"
    )


def benchmark_checks(spark, sf_dir):
    """Benchmark passages as checks of every language; they name no document."""
    langs = table(spark, sf_dir, "documents").groupBy().agg(F.array_sort(F.collect_set("lang")).alias("s"))
    return table(spark, sf_dir, "benchmark").select(
        F.explode(langs.scalar()).alias("session_id"), F.col("item_id").cast("string").alias("id"),
        F.lit("fact").alias("kind"), F.col("item_id").alias("record"), F.lit("/content").alias("pointer"),
        F.lit("tool").alias("origin"), F.lit(False).alias("elidable"), "text",
    )


def document_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.col("lang").alias("session_id"), F.col("doc_id").alias("record"),
        F.lit("/content").alias("pointer"), F.lit("tool").alias("origin"), "text",
    )


WORDS = (
    "list_distinct(list_filter(list_transform(regexp_split_to_array(text, '[^\\p{L}\\p{N}]+'), lambda w: lower(w)), lambda w: strlen(w) >= 4 AND NOT list_contains(["
    + ", ".join(f"'{w}'" for w in rt.STOPWORDS)
    + "], w)))"
)


# A check's session, id, text and words; a text's session and words; what they have to do with each other; and all that is told of it.
_Z, _Z2 = "1.959963984540054", "3.841458820694124"


def _wilson(k: str, sign: str) -> str:
    p = f"({k}::DOUBLE / total)"
    bound = f"(({p} + {_Z2} / (total * 2.0)) {sign} {_Z} * sqrt(({p} * (1.0 - {p}) + {_Z2} / (total * 4.0)) / total)) / (1.0 + {_Z2} / total)"
    return f"greatest({bound}, 0.0)" if sign == "-" else f"least({bound}, 1.0)"


HITS = """h AS (SELECT c.session_id, c.id, c.kind, c.elidable, coalesce(bool_or(contains(d.text, c.text)), false) AS lit, coalesce(bool_or(len(c.w) > 0 AND len(list_intersect(c.w, d.w)) >= len(c.w) * 0.75), false) AS lex,
  coalesce(bool_or(contains(d.text, c.text) AND c.origin = d.origin), false) AS own, coalesce(bool_or(contains(d.text, c.text) AND c.origin = d.origin AND c.record = d.record), false) AS src
  FROM c LEFT JOIN d USING (session_id) GROUP BY 1, 2, 3, 4)
"""
SCORES = f"""t AS (SELECT session_id, count(*) AS total, count(*) FILTER (lit) AS retained, count(*) FILTER (lex) AS lexical_retained, count(*) FILTER (own) AS same_origin_retained,
  count(*) FILTER (src) AS source_bound_retained, count(*) FILTER (elidable) AS elidable_total, count(*) FILTER (elidable AND src) AS elidable_retained,
  coalesce(list(id ORDER BY id) FILTER (NOT src), []) AS missing_ids FROM h GROUP BY 1)
SELECT *, retained / total AS literal_recall, lexical_retained / total AS lexical_recall, {_wilson("retained", "-")} AS literal_low, {_wilson("retained", "+")} AS literal_high,
  {_wilson("lexical_retained", "-")} AS lexical_low, {_wilson("lexical_retained", "+")} AS lexical_high FROM t"""


@query(
    "retention",
    f"""WITH c AS (SELECT l.lang AS session_id, item_id::VARCHAR AS id, 'fact' AS kind, false AS elidable, item_id AS record, 'tool' AS origin, text, {WORDS} AS w FROM benchmark, (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL) l),
d AS (SELECT lang AS session_id, doc_id AS record, 'tool' AS origin, text, {WORDS} AS w FROM documents),
{HITS}, {SCORES}""",
)
def _(spark, sf_dir):
    hits = rt.check_hits(benchmark_checks(spark, sf_dir), document_texts(spark, sf_dir), ["session_id"])
    return rt.score_retention(hits, ["session_id"])


LINE_CHECKS = f"""l AS (SELECT lang AS session_id, doc_id, unnest(regexp_split_to_array(text, chr(10))) AS line, source FROM documents WHERE doc_id % 20 = 0 AND lang IS NOT NULL),
c AS (SELECT session_id, sha256(line) AS id, CASE min(doc_id) % 3 WHEN 0 THEN 'fact' WHEN 1 THEN 'procedure' ELSE 'constraint' END AS kind, min(doc_id) % 2 = 0 AS elidable, min(doc_id) AS record,
  CASE WHEN min(doc_id) % 7 = 0 THEN 'user' ELSE 'tool' END AS origin, line AS text, {WORDS.replace("text", "line")} AS w FROM l WHERE trim(line) <> '' GROUP BY session_id, line),
d AS (SELECT lang AS session_id, doc_id AS record, CASE WHEN doc_id % 7 = 0 THEN 'user' ELSE 'tool' END AS origin, CASE WHEN doc_id % 3 = 0 THEN replace(text, 'e', 'E') ELSE text END AS text FROM documents),
e AS (SELECT *, {WORDS} AS w FROM d WHERE record % 5 <> 0)
"""


def line_hits(spark, sf_dir):
    """Each distinct line of some documents as a check, over what a rewrite keeps: a fifth of all documents is gone, a third changed."""
    docs = table(spark, sf_dir, "documents").filter("lang is not null")
    origin = lambda c: F.when(c % 7 == 0, "user").otherwise("tool")
    lines = docs.filter("doc_id % 20 = 0").select(F.col("lang").alias("session_id"), "doc_id", F.explode(F.split("text", "\n")).alias("text")).filter("trim(text) <> ''")
    checks = lines.groupBy("session_id", "text").agg(F.min("doc_id").alias("record")).select(
        "session_id", F.sha2("text", 256).alias("id"), F.element_at(F.array(F.lit("fact"), F.lit("procedure"), F.lit("constraint")), (F.col("record") % 3 + 1).cast("int")).alias("kind"),
        (F.col("record") % 2 == 0).alias("elidable"), "record", F.lit("/content").alias("pointer"), origin(F.col("record")).alias("origin"), "text",
    )
    texts = docs.filter("doc_id % 5 <> 0").select(
        F.col("lang").alias("session_id"), F.col("doc_id").alias("record"), F.lit("/content").alias("pointer"), origin(F.col("doc_id")).alias("origin"),
        F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("e"), F.lit("E"))).otherwise(F.col("text")).alias("text"),
    )
    return rt.check_hits(checks, texts, ["session_id"])


@query("retention_lines", f"WITH {LINE_CHECKS}, {HITS.replace('JOIN d ', 'JOIN e AS d ')}, {SCORES}")
def _(spark, sf_dir):
    return rt.score_retention(line_hits(spark, sf_dir), ["session_id"])


@query(
    "retention_kinds",
    f"WITH {LINE_CHECKS}, {HITS.replace('JOIN d ', 'JOIN e AS d ')} SELECT session_id, kind, count(*) AS total, count(*) FILTER (src) AS source_bound_retained, count(*) FILTER (lex) AS lexical_retained FROM h GROUP BY 1, 2",
)
def _(spark, sf_dir):
    return rt.retention_by_kind(line_hits(spark, sf_dir), ["session_id"])


@query("knowledge_checks")
def _(spark, sf_dir):
    from palimpsest.sources.tables import document_items

    elidable = document_items(spark, sf_dir).filter("elidable_bytes IS NOT NULL").select(
        "session_id", F.col("line_index").alias("record")
    )
    return rt.build_checks(document_texts(spark, sf_dir), elidable, ["session_id"])


def study_checks(spark, sf_dir):
    """Benchmark passages as reviewed checks of all kinds, each bound to the first document of a language that holds it; a passage that none holds is no check there."""
    from palimpsest.sources.tables import document_items

    kinds = F.array(*[F.lit(k) for k in rt.KINDS])
    passages = benchmark_checks(spark, sf_dir).withColumn("kind", F.element_at(kinds, F.pmod("record", F.lit(len(rt.KINDS))).cast("int") + 1))
    bound = rt.first_places(passages, document_texts(spark, sf_dir), ["session_id"])
    elidable = document_items(spark, sf_dir).filter("elidable_bytes IS NOT NULL").select("session_id", F.col("line_index").alias("record"), F.lit(True).alias("_e"))
    return bound.join(elidable, ["session_id", "record"], "left").withColumn("elidable", F.coalesce("_e", F.lit(False))).drop("_e")


@query("study_arms")
def _(spark, sf_dir):
    """Passages that documents hold as checks, over what four ways of compaction keep, round after round."""
    from palimpsest.catalog.planning import documents

    keys = ["session_id"]
    scores = rt.study_arms(document_texts(spark, sf_dir), study_checks(spark, sf_dir), documents(spark, sf_dir), keys)
    return rt.study_summary(scores, keys)


@query(
    "word_sets",
    """SELECT doc_id, len(list_distinct(list_transform(list_filter(regexp_split_to_array(text, '[^\\p{L}\\p{N}/._]+'), lambda w: w <> '' AND strlen(w) <= 128), lambda w: lower(w)))) AS words FROM documents""",
)
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(word_set("text")).cast("long").alias("words"))
