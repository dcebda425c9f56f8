"""Queries over the driver's tables, each with the same result in SQL.

The tables hold no translations, so views of them stand in: orders, parts and suppliers for a corpus, customers
for analysed files, documents for responses with injected faults, line items for candidate translations, and events
for ingest. Both engines derive these by the same expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.values import estimate_tokens, provider, sha256, thinking_bucket, translator_id
from ..operators import alignment, corpus, corrections, files, packing, patches, playback, tree
from ..operators.rules import RULES, caps_kinds, validate
from ..streaming import ingest
from .tables import shared_folder, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- views ----


def corpus_view(spark: SparkSession, sf_dir: str, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """Segments: excerpts from orders, headings from parts, footnotes from suppliers."""
    orders = _table(spark, sf_dir, "orders")
    if first_day:
        orders = orders.where(F.col("o_orderdate").between(F.lit(first_day).cast("timestamp_ntz"), F.lit(last_day).cast("timestamp_ntz")))
    text = F.when(F.col("o_orderstatus") == "O", None).when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderpriority"))
    kind = F.when(F.col("o_orderkey") % 5 == 0, "arabic_leak_correction").when(F.col("o_orderkey") % 7 == 0, "all_caps_correction").when(F.col("o_orderkey") % 11 == 0, "other")
    excerpts = orders.select(
        F.lit("excerpts").alias("collection"), F.col("o_orderkey").alias("idx"), F.concat(F.lit("P"), F.col("o_orderkey").cast("string")).alias("id"), F.concat(F.lit("text "), "o_orderpriority").alias("nass"),
        text.alias("text"), (879 + F.col("o_custkey") % 12).cast("int").alias("translator"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("last_updated_at"),
        (F.col("o_orderkey") % 4).cast("int").alias("alt_count"), kind.alias("patch_type"),
    )
    headings = _table(spark, sf_dir, "part").select(
        F.lit("headings").alias("collection"), F.col("p_partkey").alias("idx"), F.concat(F.lit("T"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("nass"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("text"), (890 + F.col("p_size") % 5).cast("int").alias("translator"),
        (F.lit(820_454_400) + F.col("p_partkey") % 900 * 86_400).cast("long").alias("last_updated_at"), (F.col("p_partkey") % 3).cast("int").alias("alt_count"), F.lit(None).cast("string").alias("patch_type"),
    )
    footnotes = _table(spark, sf_dir, "supplier").select(
        F.lit("footnotes").alias("collection"), F.col("s_suppkey").alias("idx"), F.concat(F.lit("F"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("nass"),
        F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("text"), F.lit(901).alias("translator"), F.lit(None).cast("long").alias("last_updated_at"), F.lit(1).alias("alt_count"), F.lit(None).cast("string").alias("patch_type"),
    )
    return excerpts.unionByName(headings).unionByName(footnotes)


def _corpus_sql(where: str = "") -> str:
    return f"""
corpus AS (
  SELECT 'excerpts' AS collection, 1 AS o, o_orderkey AS idx, 'P' || o_orderkey AS id, 'text ' || o_orderpriority AS nass,
    CASE o_orderstatus WHEN 'O' THEN NULL WHEN 'P' THEN '' ELSE o_orderpriority END AS text, (879 + o_custkey % 12)::INT AS translator, epoch(o_orderdate)::BIGINT AS ts,
    (o_orderkey % 4)::INT AS alt_count,
    CASE WHEN o_orderkey % 5 = 0 THEN 'arabic_leak_correction' WHEN o_orderkey % 7 = 0 THEN 'all_caps_correction' WHEN o_orderkey % 11 = 0 THEN 'other' END AS patch_type FROM orders {where}
  UNION ALL SELECT 'headings', 2, p_partkey, 'T' || p_partkey, p_name, CASE WHEN p_size % 2 = 0 THEN p_type END, (890 + p_size % 5)::INT, 820454400 + p_partkey % 900 * 86400, (p_partkey % 3)::INT, NULL FROM part
  UNION ALL SELECT 'footnotes', 3, s_suppkey, 'F' || s_suppkey, s_name, CASE WHEN s_acctbal > 0 THEN s_name END, 901, NULL, 1, NULL FROM supplier)"""


_CORPUS = _corpus_sql()
_T = "coalesce(length(text), 0) > 0"


def files_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    path = F.concat(F.lit("m"), F.col("c_nationkey").cast("string"), F.lit("/"), F.col("c_custkey").cast("string"), F.lit(".json"))
    model = F.when(F.col("c_mktsegment") == "BUILDING", "gpt-5-4-pro").when(F.col("c_mktsegment") == "MACHINERY", "grok-4").when(F.col("c_mktsegment") == "FURNITURE", None).otherwise(F.lower("c_mktsegment"))
    return c.select(path.alias("path"), model.alias("model"), (F.col("c_acctbal") >= 0).alias("is_valid"), (F.col("c_custkey") % 3).cast("int").alias("patches_applied"), (F.col("c_custkey") % 90 - 5).cast("double").alias("thinking_sec"))


_FILES = """
files AS (SELECT 'm' || c_nationkey || '/' || c_custkey || '.json' AS path,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'gpt-5-4-pro' WHEN 'MACHINERY' THEN 'grok-4' WHEN 'FURNITURE' THEN NULL ELSE lower(c_mktsegment) END AS model,
  c_acctbal >= 0 AS is_valid, (c_custkey % 3)::INT AS patches_applied, (c_custkey % 90 - 5)::DOUBLE AS thinking_sec FROM customer)"""
_BUCKET = "CASE WHEN thinking_sec < 0 THEN NULL WHEN thinking_sec < 10 THEN 'lt_10s' WHEN thinking_sec < 30 THEN '10_to_30s' WHEN thinking_sec < 60 THEN '30_to_60s' ELSE '1m_plus' END"


def responses_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A response for each document: its text as one segment, a fault by doc_id, then a glued marker."""
    body = F.replace(F.replace("text", F.lit("\r"), F.lit(" ")), F.lit("\n"), F.lit(" "))
    k = F.col("doc_id") % 7
    fault = (
        F.when(k == 1, " قال الله then").when(k == 2, " THEY KNEW THAT THE BUYER left").when(k == 3, " () () () ()").when(k == 4, " said…").otherwise("")
    )
    second = F.when(k == 4, "…").when(k == 5, "[INCOMPLETE]").otherwise("end of it")
    key = F.col("doc_id").cast("string")
    return _table(spark, sf_dir, "documents").where("text is not null").select(
        "doc_id", F.concat(F.lit("note\nP"), key, F.lit(" - "), body, fault, F.lit("P"), key, F.lit("b - "), second).alias("response"),
        F.array(F.struct(F.concat(F.lit("P"), key).alias("id"), F.repeat(F.lit("س"), F.when(k == 6, 90_000).otherwise(10)).alias("text")), F.struct(F.concat(F.lit("P"), key, F.lit("b")).alias("id"), F.repeat(F.lit("س"), F.when(k == 6, 60).otherwise(5)).alias("text"))).alias("source"),
    )


_RESPONSES = """
base AS (SELECT doc_id, doc_id % 7 AS k, replace(replace(text, chr(13), ' '), chr(10), ' ') AS body FROM documents WHERE text IS NOT NULL),
resp AS (SELECT doc_id, k, 'P' || doc_id AS id1, 'P' || doc_id || 'b' AS id2,
  body || CASE k WHEN 1 THEN ' قال الله then' WHEN 2 THEN ' THEY KNEW THAT THE BUYER left' WHEN 3 THEN ' () () () ()' WHEN 4 THEN ' said…' ELSE '' END AS t1,
  CASE k WHEN 4 THEN '…' WHEN 5 THEN '[INCOMPLETE]' ELSE 'end of it' END AS t2 FROM base),
seg AS (SELECT doc_id, k, 0 AS pos, id1 AS id, trim(t1, ' ' || chr(9) || chr(160)) AS text FROM resp UNION ALL SELECT doc_id, k, 1, id2, t2 FROM resp)"""


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses_view(spark, sf_dir).withColumn("parsed", T.segments(T.normalize(F.col("response"))))


def candidates_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct("l_suppkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate")
    key = F.concat_ws("|", F.lpad(F.col("l_suppkey").cast("string"), 9, "0"), F.lpad(F.col("l_linenumber").cast("string"), 3, "0"), F.lpad(F.col("l_partkey").cast("string"), 9, "0"), F.format_string("%015.2f", "l_extendedprice"), F.date_format("l_shipdate", "yyyyMMdd"))
    return _table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("P"), F.col("l_orderkey").cast("string")).alias("id"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("path"), order.alias("file_order"), F.lit(0).alias("pos"),
        key.alias("text"), (879 + F.col("l_partkey") % 20).cast("int").alias("translator"), F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("last_updated_at"),
    )


def targets_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_view(spark, sf_dir).where((F.col("collection") == "excerpts") & (F.col("idx") % 10 != 0))


_PLAY = f"""
WITH {_CORPUS}, targets AS (SELECT * FROM corpus WHERE collection = 'excerpts' AND idx % 10 <> 0),
cand AS (SELECT 'P' || l_orderkey AS id, 's' || l_suppkey AS path, l_suppkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate,
  (879 + l_partkey % 20)::INT AS translator, epoch(l_shipdate)::BIGINT AS ts FROM lineitem),
cls AS (SELECT c.*, CASE WHEN t.id IS NULL THEN 'unknown' WHEN coalesce(length(t.text), 0) > 0 THEN 'already_translated' ELSE 'playable' END AS state
  FROM cand c LEFT JOIN targets t USING (id)),
ranked AS (SELECT *, CASE WHEN state = 'playable' THEN row_number() OVER (PARTITION BY id, state ORDER BY l_suppkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate) END AS nth FROM cls)"""


def events_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ingest requests: a conversation for each user, seq falls back or is left out now and then, keys repeat across users."""
    return events_of(_table(spark, sf_dir, "events"))


def events_of(e: DataFrame) -> DataFrame:
    return e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"), F.col("event_id").alias("arrival"), F.when(F.col("event_id") % 11 != 0, F.col("event_id") - F.when(F.col("event_id") % 5 == 0, 400).otherwise(0)).alias("seq"),
        F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("k"), (F.col("event_id") % 1999).cast("string"))).alias("key"), F.col("props").alias("payload"),
    )


# ---- corpus ----

_M1 = "floor({0} * 10 + 0.5) / 10"


@query(f"WITH {_CORPUS} SELECT collection, count(*) AS total, count(*) FILTER ({_T}) AS translated, count(*) FILTER (NOT ({_T})) AS untranslated FROM corpus GROUP BY collection")
def corpus_counts(spark, sf_dir):
    return corpus.counts(corpus_view(spark, sf_dir))


@query(f"""WITH {_CORPUS}, b AS (SELECT *, collection IN ('excerpts', 'headings') AS both_, {_T} AS t FROM corpus)
SELECT count(*) FILTER (both_) AS total_segments, count(*) FILTER (both_ AND t) AS translated_segments, count(*) FILTER (both_ AND NOT t) AS untranslated_segments,
 count(*) FILTER (o = 1) AS excerpts_total, count(*) FILTER (o = 1 AND t) AS excerpts_translated, count(*) FILTER (o = 2) AS headings_total, count(*) FILTER (o = 2 AND t) AS headings_translated,
 count(DISTINCT translator) FILTER (o = 1) AS unique_translators, 820000000::BIGINT AS created_at, 830000000::BIGINT AS last_updated_at, 10000000::BIGINT AS work_duration_sec FROM b""")
def corpus_stats(spark, sf_dir):
    return corpus.stats(corpus_view(spark, sf_dir), 820_000_000, 830_000_000)


@query(f"""WITH {_CORPUS} SELECT count(DISTINCT translator) FILTER (o = 1) AS of_excerpts, count(DISTINCT translator) FILTER ({_T}) AS of_translated,
 count(DISTINCT translator) FILTER (o = 1 AND translator <> 0) AS of_snapshot FROM corpus""")
def corpus_translators_distinct(spark, sf_dir):
    return corpus.distinct_translators(corpus_view(spark, sf_dir))


def _timeline_sql(where: str, grain: str, label: str, start: str) -> str:
    return f"""WITH {_corpus_sql(where)}, use AS (SELECT * FROM corpus {'' if not where else "WHERE collection <> 'headings'"}),
d AS (SELECT {start} AS day, o FROM use WHERE {_T} AND o < 3 AND ts IS NOT NULL),
g AS (SELECT day, count(*) FILTER (o = 1) AS excerpts, count(*) FILTER (o = 2) AS headings, count(*) AS translated FROM d GROUP BY day),
n AS (SELECT count(*) AS total FROM use WHERE o < 3),
r AS (SELECT *, (sum(translated) OVER (ORDER BY day))::BIGINT AS cumulative_translated FROM g)
SELECT strftime(day, '%Y-%m-%d') AS date, '{grain}' AS granularity, {label} AS label, excerpts, headings, translated, cumulative_translated,
  {_M1.format('(cumulative_translated / total * 100)')} AS completion_percent FROM r, n"""


_DAY = "CAST(to_timestamp(ts) AT TIME ZONE 'UTC' AS DATE)"


@query(_timeline_sql("", "month", "strftime(day, '%b %Y')", f"CAST(date_trunc('month', {_DAY}) AS DATE)"))
def corpus_timeline_month(spark, sf_dir):
    return corpus.timeline(corpus_view(spark, sf_dir))


def _between(a: str, b: str) -> str:
    return f"WHERE o_orderdate BETWEEN TIMESTAMP '{a}' AND TIMESTAMP '{b}'"


@query(_timeline_sql(_between("1995-01-01", "1995-08-31"), "week", "'Week of ' || strftime(day, '%b ') || day(day)", f"CAST(date_trunc('week', {_DAY}) AS DATE)"))
def corpus_timeline_week(spark, sf_dir):
    return corpus.timeline(corpus_view(spark, sf_dir, "1995-01-01", "1995-08-31").where("collection <> 'headings'"))


@query(_timeline_sql(_between("1995-03-01", "1995-04-15"), "day", "strftime(day, '%b ') || day(day)", _DAY))
def corpus_timeline_day(spark, sf_dir):
    return corpus.timeline(corpus_view(spark, sf_dir, "1995-03-01", "1995-04-15").where("collection <> 'headings'"))


@query(f"""WITH {_CORPUS}, u AS (SELECT translator::VARCHAR AS id, count(*) AS n FROM corpus WHERE {_T} AND translator IS NOT NULL GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, id) AS rank, count(*) OVER () AS kinds, sum(n) OVER () AS uses FROM u),
s AS (SELECT CASE WHEN kinds <= 8 OR rank < 8 THEN rank ELSE 8 END AS slot, CASE WHEN kinds <= 8 OR rank < 8 THEN id ELSE 'other' END AS key, n, uses FROM r),
g AS (SELECT slot, key, sum(n)::BIGINT AS n, count(*) AS members, any_value(uses) AS uses FROM s GROUP BY slot, key),
dim(id, label) AS (VALUES ('879', 'GPT 5o'), ('890', 'Gemini 3.0 Pro'), ('893', 'OpenAI GPT 5.2 Thinking'), ('895', 'Grok 4 Expert'), ('900', 'GPT 5.4 Thinking'), ('901', 'Gemini 3.1 Pro'), ('903', 'GPT 5.4 Pro'), ('904', 'GPT 5.4 Thinking Mini'))
SELECT slot::INT AS rank, key AS id, CASE WHEN key = 'other' THEN 'Other (' || members || ')' ELSE coalesce(label, 'Translator ' || key) END AS label, n AS count,
 {_M1.format('(n / uses * 100)')} AS percent FROM g LEFT JOIN dim ON dim.id = key""")
def translator_shares(spark, sf_dir):
    return corpus.translator_shares(corpus_view(spark, sf_dir))


@query(f"WITH {_CORPUS} SELECT alt_count, alt_count || CASE WHEN alt_count = 1 THEN ' alt' ELSE ' alts' END AS label, count(*) AS segments FROM corpus WHERE alt_count > 0 GROUP BY alt_count")
def alt_histogram(spark, sf_dir):
    return corpus.alternatives(corpus_view(spark, sf_dir))


@query(f"WITH {_CORPUS} SELECT patch_type AS type, CASE patch_type WHEN 'arabic_leak_correction' THEN 'Arabic Leak' ELSE 'All Caps' END AS label, count(*) AS count FROM corpus WHERE patch_type IN ('arabic_leak_correction', 'all_caps_correction') GROUP BY patch_type")
def patch_type_counts(spark, sf_dir):
    return corpus.patch_types(corpus_view(spark, sf_dir))


@query(f"""WITH {_CORPUS}, two AS (SELECT *, 'P' || (idx % 7000) AS twin FROM corpus WHERE o < 3)
SELECT twin AS id, count(*) AS n, string_agg(collection || ':' || idx, ',' ORDER BY o, idx) AS places FROM two GROUP BY twin HAVING count(*) > 1""")
def duplicate_targets(spark, sf_dir):
    rows = corpus_view(spark, sf_dir).where("collection <> 'footnotes'")
    return corpus.duplicate_targets(rows.withColumn("id", F.concat(F.lit("P"), (F.col("idx") % 7000).cast("string"))))


# ---- the work queue ----

_QUEUE = f"WITH {_CORPUS}, queue AS (SELECT o AS collection_order, idx, collection, id, nass, row_number() OVER (ORDER BY o, idx) AS position FROM corpus WHERE text IS NULL)"


@query(f"{_QUEUE} SELECT position, collection_order, collection, id, nass FROM queue")
def untranslated_queue(spark, sf_dir):
    return packing.positions(corpus.untranslated(corpus_view(spark, sf_dir)), place="idx", within=["collection_order"]).select("position", "collection_order", "collection", "id", "nass")


@query(f"""{_QUEUE}, n AS (SELECT count(*) AS total, greatest(1, (count(*) + 19) // 20) AS total_pages FROM queue)
SELECT position, id, total, total_pages::BIGINT AS total_pages, least(3, total_pages)::BIGINT AS page FROM queue, n WHERE position > (least(3, total_pages) - 1) * 20 AND position <= least(3, total_pages) * 20""")
def untranslated_page(spark, sf_dir):
    rows = packing.page(corpus.untranslated(corpus_view(spark, sf_dir)), 3, 20)
    return rows.select("position", "id", "total", F.col("total_pages").cast("long").alias("total_pages"), F.col("page").cast("long").alias("page"))


_COST = "ceil(length(nass) / 4)::BIGINT + ceil((length(id) + {0}) / 4)::BIGINT"


@query(f"""{_QUEUE}, c AS (SELECT *, {_COST.format(5)} AS tokens FROM queue), r AS (SELECT *, 100 + sum(tokens) OVER (ORDER BY position) AS running FROM c),
g AS (SELECT *, CASE WHEN running <= 5000 THEN 0 WHEN running <= 11000 THEN 1 WHEN running <= 16000 THEN 2 ELSE 3 END AS group_no FROM r),
dim(group_no, label, "limit") AS (VALUES (0, '5k', 5000), (1, '11k', 11000), (2, '16k', 16000), (3, 'all', NULL))
SELECT dim.group_no, dim.label, coalesce(dim."limit", 0)::BIGINT AS "limit", count(g.id) AS ids, coalesce(sum(tokens), 0)::BIGINT AS tokens, coalesce(max(position) - 1, -1)::BIGINT AS last_index
FROM dim LEFT JOIN g USING (group_no) GROUP BY 1, 2, 3""")
def token_groups(spark, sf_dir):
    queue = corpus.untranslated(corpus_view(spark, sf_dir))
    return packing.group_summary(spark, packing.token_groups(queue, 100)).withColumn("limit", F.coalesce("limit", F.lit(0)))


@query(f"""{_QUEUE}, c AS (SELECT *, ceil(length(id || ' - ' || nass) / 4)::BIGINT AS tokens FROM queue), r AS (SELECT *, 6 + sum(tokens) OVER (ORDER BY position) AS running FROM c)
SELECT position, id, tokens, running::BIGINT AS running FROM r WHERE running <= 4000""")
def budget_prefix(spark, sf_dir):
    return packing.budget(corpus.untranslated(corpus_view(spark, sf_dir)), 4000, "Translate these texts.").select("position", "id", "tokens", "running")


@query(f"""{_QUEUE}, c AS (SELECT *, {_COST.format(4)} AS tokens FROM queue WHERE collection_order = 1 AND position <= 200), r AS (SELECT *, 5 + sum(tokens) OVER (ORDER BY position) AS running FROM c)
SELECT 'Translate these text' || chr(10) || chr(10) || string_agg(id || ' - ' || nass, chr(10) ORDER BY position) AS payload, count(*) AS item_count, (5 + sum(tokens))::BIGINT AS used_tokens FROM r WHERE running <= 900""")
def payload_text(spark, sf_dir):
    return packing.payload(corpus.untranslated(corpus_view(spark, sf_dir)), 900, "Translate these text", 200)


@query(f"""{_QUEUE}, c AS (SELECT *, ceil(length(id || ' - ' || nass) / 4)::BIGINT AS tokens FROM queue), r AS (SELECT *, 5 + sum(tokens) OVER (ORDER BY position) AS running FROM c)
SELECT 'Translate these text' || chr(10) || chr(10) || string_agg(id || ' - ' || nass, chr(10) || chr(10) ORDER BY position) AS payload, count(*) AS item_count, (5 + sum(tokens))::BIGINT AS used_tokens FROM r WHERE running <= 700""")
def shift_payload(spark, sf_dir):
    return packing.shift(corpus.untranslated(corpus_view(spark, sf_dir)), 700, "Translate these text")


@query(f"{_QUEUE} SELECT id, lag(id) OVER (ORDER BY position) AS prev_id, lead(id) OVER (ORDER BY position) AS next_id FROM queue")
def neighbours(spark, sf_dir):
    return packing.neighbours(corpus.untranslated(corpus_view(spark, sf_dir)))


@query(f"{_QUEUE} SELECT id, nass FROM queue WHERE position > 250")
def shift_resume(spark, sf_dir):
    return packing.resume(corpus.untranslated(corpus_view(spark, sf_dir)), shifted_count=250).select("id", "nass")


@query(f"{_QUEUE} SELECT id, nass FROM queue WHERE NOT (collection = 'headings' AND idx % 2 = 0)")
def shift_resume_by_ids(spark, sf_dir):
    queue = corpus.untranslated(corpus_view(spark, sf_dir))
    return packing.resume(queue, queue.where("collection = 'headings' and idx % 2 = 0").select("id")).select("id", "nass")


@query(f"{_QUEUE} SELECT id, ((position - 1) // 10)::BIGINT AS chunk_no FROM queue")
def request_chunks(spark, sf_dir):
    return packing.chunks(corpus.untranslated(corpus_view(spark, sf_dir)), 10, place="idx", within=["collection_order"]).select("id", "chunk_no")


# ---- files ----


@query(f"WITH {_FILES} SELECT count(*) AS total_files, count(*) FILTER (is_valid) AS valid_files, count(*) FILTER (NOT is_valid) AS invalid_files, sum(patches_applied)::BIGINT AS patches_applied FROM files")
def file_stats(spark, sf_dir):
    return files.stats(files_view(spark, sf_dir))


@query(f"WITH {_FILES} SELECT coalesce(model, 'unknown') AS model, count(model) AS files, count(*) FILTER (NOT is_valid) AS invalid FROM files WHERE model IS NOT NULL OR NOT is_valid GROUP BY 1")
def file_model_breakdown(spark, sf_dir):
    return files.by_model(files_view(spark, sf_dir))


@query(f"WITH {_FILES}, b AS (SELECT {_BUCKET} AS bucket FROM files) SELECT bucket, count(*) AS files FROM b WHERE bucket IS NOT NULL GROUP BY bucket")
def thinking_time_hist(spark, sf_dir):
    return files.thinking_times(files_view(spark, sf_dir))


@query(f"WITH {_FILES} SELECT path, model FROM files WHERE model = 'grok-4' AND is_valid AND {_BUCKET} = '10_to_30s'")
def tree_filter(spark, sf_dir):
    return files.matching(files_view(spark, sf_dir), "grok-4", "valid", "10_to_30s").select("path", "model")


@query(f"""WITH {_FILES}, t AS (SELECT split_part(path, '/', 1) AS path, '' AS parent, split_part(path, '/', 1) AS name, 'directory' AS kind, 1 AS depth, count(*) AS files FROM files GROUP BY 1
UNION ALL SELECT path, split_part(path, '/', 1), split_part(path, '/', 2), 'file', 2, 1 FROM files) SELECT * FROM t""")
def tree_dir_counts(spark, sf_dir):
    return files.tree(files_view(spark, sf_dir))


# ---- segments and rules ----


@query(f"WITH {_RESPONSES} SELECT doc_id, pos, id, text FROM seg")
def segment_parse(spark, sf_dir):
    return _parsed(spark, sf_dir).select("doc_id", F.explode_outer("parsed").alias("s")).where("s is not null").select("doc_id", "s.pos", "s.id", "s.text")


@query(f"WITH {_RESPONSES} SELECT doc_id, id1 || ',' || id2 AS ids FROM resp")
def marker_ids(spark, sf_dir):
    return responses_view(spark, sf_dir).select("doc_id", F.array_join(T.marker_ids(T.normalize(F.col("response"))), ",").alias("ids"))


@query(f"WITH {_RESPONSES} SELECT doc_id, 'P1' AS id, id2 || ' ' || t2 AS text FROM resp")
def segment_map_last_wins(spark, sf_dir):
    rows = _parsed(spark, sf_dir).withColumn("same", F.transform("parsed", lambda s: F.struct(s["pos"].alias("pos"), F.lit("P1").alias("id"), F.concat(s["id"], F.lit(" "), s["text"]).alias("text"))))
    return rows.select("doc_id", F.explode(T.segment_map(F.col("same"))).alias("id", "text"))


def _errors(spark: SparkSession, sf_dir: str, *rules: str) -> DataFrame:
    rows = validate(responses_view(spark, sf_dir), rules=rules)
    # the outer form: from the plain one Spark infers a filter that works the errors out twice more
    return rows.select("doc_id", F.posexplode_outer("errors").alias("n", "e")).where("n is not null").select("doc_id", "n", "e.*")


@query(f"WITH {_RESPONSES} SELECT doc_id, id1 AS id, 'قال الله' AS match, (strpos(text, 'قال') - 1)::INT AS segment_start, (strpos(text, 'قال') + 7)::INT AS segment_end FROM resp JOIN seg USING (doc_id) WHERE resp.k = 1 AND pos = 0")
def leak_spans(spark, sf_dir):
    return _errors(spark, sf_dir, "arabic_leak").select("doc_id", "id", "match", "segment_start", "segment_end")


@query(f"""WITH {_RESPONSES}, t AS (SELECT doc_id, regexp_extract_all(text, '[\\p{{L}}][\\p{{L}}\\p{{M}}\\p{{Nd}}''’.-]*|[^\\p{{L}}]+') AS w FROM seg),
f AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS x FROM t),
c AS (SELECT *, CASE WHEN regexp_matches(x, '^\\p{{L}}') AND regexp_matches(x, '[\\p{{Lu}}\\p{{Lt}}]') AND NOT regexp_matches(x, '\\p{{Ll}}') THEN 'c' WHEN regexp_matches(x, '^\\s+$') THEN 's' ELSE 'o' END AS kind FROM f),
m AS (SELECT doc_id, string_agg(kind, '' ORDER BY i) AS kinds FROM c GROUP BY doc_id)
SELECT count(*) AS segments, 1 AS one FROM m WHERE regexp_matches(kinds, 'c(sc){{4,}}')""")
def caps_runs_documents(spark, sf_dir):
    """Documents with a run as the SQL has it: the lexemes of all segments are strung together by their place in their own segment.

    The rule all_caps looks within a segment. Whose lexeme comes first at the same place the SQL leaves open; here the later segment's.
    """
    both = lambda later, earlier: F.concat(F.coalesce(later, F.lit("")), F.coalesce(earlier, F.lit("")))
    strung = F.aggregate("parsed", F.expr("cast(array() as array<string>)"), lambda acc, s: F.zip_with(caps_kinds(s["text"]), acc, both))
    rows = _parsed(spark, sf_dir).where(F.array_join(strung, "").rlike("c(sc){4,}"))
    return rows.agg(F.count(F.lit(1)).alias("segments"), F.lit(1).alias("one"))


@query(f"WITH {_RESPONSES} SELECT doc_id, length(t1) - length(replace(t1, '()', ' ')) AS n FROM resp WHERE length(t1) - length(replace(t1, '()', ' ')) > 3")
def empty_parens(spark, sf_dir):
    return _errors(spark, sf_dir, "empty_parentheses").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_RESPONSES}, s AS (SELECT *, CASE WHEN pos = 0 THEN CASE WHEN k = 6 THEN 90000 ELSE 10 END ELSE CASE WHEN k = 6 THEN 60 ELSE 5 END END AS n FROM seg)
SELECT doc_id, id, 'Translation for "' || id || '" appears truncated: ' || length(text) || ' chars for ' || n || ' char arabic text (expected at least ~' || floor(n * 0.25 + 0.5)::BIGINT || ' chars)' AS message
FROM s WHERE n >= 50 AND length(text) < 0.25 * n""")
def length_mismatch(spark, sf_dir):
    return _errors(spark, sf_dir, "length_mismatch").select("doc_id", "id", "message")


@query(f"WITH {_RESPONSES} SELECT doc_id, id2 AS id FROM resp WHERE k IN (4, 5)")
def truncated(spark, sf_dir):
    return _errors(spark, sf_dir, "truncated_segment").select("doc_id", "id")


@query("""WITH d AS (SELECT doc_id, 'P' || doc_id AS id FROM documents WHERE text IS NOT NULL)
SELECT doc_id, id || '$1 -' AS match, 'Invalid reference format "' || id || '$1 -" - expected format is letter + numbers + optional suffix (a-j) + dash' AS message, 2::BIGINT AS n FROM d WHERE doc_id % 2 = 0
UNION ALL SELECT doc_id, id || '$1', 'Invalid reference format "' || id || '$1" - contains $ character', 2 FROM d WHERE doc_id % 2 = 0
UNION ALL SELECT doc_id, id || 'a', 'Suspicious reference found: "' || id || 'a"', 1 FROM d WHERE doc_id % 2 = 1""")
def marker_format(spark, sf_dir):
    key = F.concat(F.lit("P"), F.col("doc_id").cast("string"))
    bad = F.when(F.col("doc_id") % 2 == 0, F.concat(key, F.lit("$1 - x\n"), key, F.lit("$1 - y"))).otherwise(F.concat(key, F.lit("ab - x")))
    rows = _table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.concat(F.lit("P1 - fine\n"), bad).alias("response"), F.expr("cast(array() as array<struct<id:string,text:string>>)").alias("source"))
    errors = validate(rows, rules=["invalid_marker_format"]).select("doc_id", F.explode("errors").alias("e"))
    return errors.groupBy("doc_id", "e.match", "e.message").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_RESPONSES} SELECT rule, count(*) AS errors, count(DISTINCT doc_id) AS documents FROM (SELECT 'arabic_leak' AS rule, doc_id FROM resp WHERE k = 1 UNION ALL SELECT 'truncated_segment', doc_id FROM resp WHERE k IN (4, 5)) GROUP BY rule")
def error_rollup(spark, sf_dir):
    return _errors(spark, sf_dir, "arabic_leak", "truncated_segment").groupBy("rule").agg(F.count(F.lit(1)).alias("errors"), F.countDistinct("doc_id").alias("documents"))


# ---- alignment ----

_IDS = """
conv AS (SELECT conv_id, list('P' || turn ORDER BY turn) AS prompt, list('P' || CASE WHEN turn % 5 = 3 THEN turn + 100 WHEN turn % 7 = 2 THEN 1 ELSE turn END ORDER BY turn) AS got FROM conversations GROUP BY conv_id)"""


def _ids_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    turn = F.col("turn")
    got = F.when(turn % 5 == 3, turn + 100).when(turn % 7 == 2, 1).otherwise(turn)
    name = lambda c: F.concat(F.lit("P"), c.cast("string"))
    both = F.array_sort(F.collect_list(F.struct("turn", name(turn).alias("p"), name(got).alias("g"))))
    return rows.groupBy("conv_id").agg(both.alias("b")).select("conv_id", F.transform("b", lambda x: x["p"]).alias("prompt"), F.transform("b", lambda x: x["g"]).alias("got"))


@query(f"WITH {_IDS}, g AS (SELECT conv_id, unnest(got) AS id FROM conv) SELECT conv_id, id, count(*)::INT AS n FROM g GROUP BY conv_id, id HAVING count(*) > 1")
def dup_ids(spark, sf_dir):
    return _ids_view(spark, sf_dir).select("conv_id", F.explode(alignment.duplicate_ids(F.col("got"))).alias("d")).select("conv_id", "d.id", "d.n")


@query(f"WITH {_IDS}, g AS (SELECT conv_id, prompt, unnest(got) AS id FROM conv) SELECT conv_id, id FROM g WHERE NOT list_contains(prompt, id)")
def invented_ids(spark, sf_dir):
    return _ids_view(spark, sf_dir).select("conv_id", F.explode(alignment.invented_ids(F.col("prompt"), F.col("got"))).alias("id"))


@query(f"WITH {_IDS} SELECT conv_id, array_to_string(list_filter(prompt, lambda x: NOT list_contains(got, x)), ', ') AS missing FROM conv")
def missing_ids(spark, sf_dir):
    return _ids_view(spark, sf_dir).select("conv_id", F.array_join(alignment.missing_ids(F.col("prompt"), F.col("got")), ", ").alias("missing"))


@query(f"""WITH {_IDS}, z AS (SELECT conv_id, prompt, got, list_filter(range(1, len(prompt) + 1), lambda i: prompt[i] <> got[i])[1] AS spot FROM conv)
SELECT conv_id, spot::INT AS position, prompt[spot] AS expected, got[spot] AS received FROM z WHERE spot IS NOT NULL""")
def first_out_of_order(spark, sf_dir):
    found = alignment.first_out_of_order(F.col("prompt"), F.col("got"))
    return _ids_view(spark, sf_dir).select("conv_id", found.alias("f")).where("f is not null").select("conv_id", "f.position", "f.expected", "f.received")


@query(f"WITH {_IDS}, z AS (SELECT conv_id, list_concat(prompt, prompt) AS p, prompt AS g FROM conv) SELECT conv_id, (len(p) - len(g))::INT AS start FROM z")
def contiguous_align(spark, sf_dir):
    return _ids_view(spark, sf_dir).select("conv_id", alignment.exact_block(F.concat("prompt", "prompt"), F.col("prompt")).alias("start"))


@query(f"""WITH RECURSIVE {_IDS},
walk AS (SELECT conv_id, prompt, got, i AS start, i AS p, 1::BIGINT AS r, 0 AS hits, i - 1 AS last FROM conv, unnest(range(1, len(prompt) + 1)) u(i) WHERE list_contains(got, prompt[i])
UNION ALL SELECT conv_id, prompt, got, start, CASE WHEN step = 'skip' THEN p ELSE p + 1 END, CASE WHEN step = 'pass' THEN r ELSE r + 1 END, hits + (step = 'hit')::INT, CASE WHEN step = 'hit' THEN p ELSE last END
  FROM (SELECT *, CASE WHEN prompt[p] = got[r] THEN 'hit' WHEN list_contains(got, prompt[p]) AND NOT list_contains(prompt[p:], got[r]) THEN 'skip' ELSE 'pass' END AS step FROM walk) w WHERE p <= len(prompt) AND r <= len(got)),
best AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY hits DESC, last - start, start DESC, last DESC) AS n FROM walk WHERE (p > len(prompt) OR r > len(got)) AND hits > 0)
SELECT conv_id, (start - 1)::INT AS start, last::INT AS "end" FROM conv LEFT JOIN (SELECT * FROM best WHERE n = 1) b USING (conv_id)""")
def align_fallback(spark, sf_dir):
    found = _ids_view(spark, sf_dir).withColumn("r", alignment.overlap_range("prompt", "got"))
    return found.select("conv_id", F.col("r.start").alias("start"), F.col("r.end").alias("end"))


# ---- conversations ----

@query("""WITH RECURSIVE walk AS (SELECT conv_id, max(turn) AS turn, 1 AS depth FROM conversations GROUP BY conv_id
UNION ALL SELECT w.conv_id, w.turn - 1, depth + 1 FROM walk w JOIN conversations c ON c.conv_id = w.conv_id AND c.turn = w.turn - 1)
SELECT conv_id, string_agg(turn::VARCHAR, '>' ORDER BY turn) AS chain, max(depth)::BIGINT AS depth FROM walk GROUP BY conv_id""")
def conv_chain(spark, sf_dir):
    from ..sources.conversations import chain_places

    turns = F.array_sort(F.collect_list(F.col("turn")))
    rows = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("turns"))
    rows = rows.withColumns({"nodes": F.transform("turns", lambda t: t.cast("string")), "parents": F.transform("turns", lambda t: (t - 1).cast("string")), "start": F.array_max("turns").cast("string")})
    rows = rows.withColumn("path", F.transform(F.reverse(chain_places(F.col("nodes"), F.col("parents"), F.col("start"))), lambda p: F.get("nodes", p)))
    return rows.select("conv_id", F.array_join("path", ">").alias("chain"), F.size("path").cast("long").alias("depth"))


#: Each turn answers the one before, or the one before that; the first answers itself in every fifth conversation, a turn that isn't there in others.
_PARENT = "CASE WHEN turn = 0 AND conv_id % 5 = 0 THEN turn ELSE turn - 1 - CASE WHEN turn % 4 = 3 OR length(text) % 7 = 0 THEN 1 ELSE 0 END END"


@query(f"""WITH RECURSIVE e AS (SELECT conv_id, turn, {_PARENT} AS parent FROM conversations),
walk AS (SELECT conv_id, max(turn) AS turn, 0::BIGINT AS steps FROM conversations GROUP BY conv_id
UNION ALL SELECT w.conv_id, e.parent, steps + 1 FROM walk w JOIN e ON e.conv_id = w.conv_id AND e.turn = w.turn WHERE e.parent < w.turn AND EXISTS (SELECT 1 FROM e x WHERE x.conv_id = e.conv_id AND x.turn = e.parent))
SELECT conv_id, turn, steps FROM walk""")
def conv_ancestors(spark, sf_dir):
    """The way from each conversation's last turn up, a row for each turn on it: no conversation is collected."""
    turns = _table(spark, sf_dir, "conversations")
    edges = turns.select(F.col("conv_id").alias("conversation"), F.col("turn").alias("node"), F.expr(_PARENT).alias("parent"))
    found = tree.ancestors(edges, edges.groupBy("conversation").agg(F.max("node").alias("node")))
    return found.select(F.col("conversation").alias("conv_id"), F.col("node").alias("turn"), "steps")


@query("SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING') THEN 'ChatGPT' WHEN c_mktsegment = 'MACHINERY' THEN 'Grok' WHEN c_mktsegment = 'FURNITURE' THEN 'Gemini' ELSE 'Unknown' END AS provider, CASE c_mktsegment WHEN 'BUILDING' THEN 903 WHEN 'MACHINERY' THEN 895 WHEN 'FURNITURE' THEN 901 ELSE 0 END AS translator FROM customer")
def model_dimension(spark, sf_dir):
    seg = F.col("c_mktsegment")
    model = F.when(seg == "BUILDING", "gpt-5-4-pro").when(seg == "MACHINERY", "grok-4").when(seg == "FURNITURE", "gemini-3-pro").otherwise(F.lower(seg))
    return _table(spark, sf_dir, "customer").select("c_custkey", provider(model).alias("provider"), F.coalesce(translator_id(model), F.lit(0)).alias("translator"))


# ---- patches ----


@query("SELECT doc_id, 'AB' || substr(text, 4, 7) || 'Z' || substr(text, 13) AS patched FROM documents WHERE length(text) >= 20")
def patch_apply(spark, sf_dir):
    ops = F.expr("array(named_struct('start', 10, 'end', 12, 'text', 'Z'), named_struct('start', 0, 'end', 3, 'text', 'AB'))")
    return _table(spark, sf_dir, "documents").where(F.length("text") >= 20).select("doc_id", patches.apply_patch(F.col("text"), ops).alias("patched"))


@query("""WITH o AS (SELECT doc_id, doc_id % 5 AS a, doc_id % 3 AS gone, doc_id % 4 AS n, 10 + doc_id % 7 AS b FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN n > 0 THEN a || '-' || (a + n) || ',' ELSE '' END || (b + n - gone) || '-' || (b + n - gone + 1) AS ranges FROM o""")
def patch_highlights(spark, sf_dir):
    ops = F.expr("array(named_struct('start', int(10 + doc_id % 7), 'end', int(12 + doc_id % 7), 'text', 'Z'), named_struct('start', int(doc_id % 5), 'end', int(doc_id % 5 + doc_id % 3), 'text', repeat('x', int(doc_id % 4))))")
    shown = F.array_join(F.transform(patches.highlight_ranges(ops), lambda r: F.concat_ws("-", r["start"], r["end"])), ",")
    return _table(spark, sf_dir, "documents").where("text is not null").select("doc_id", shown.alias("ranges"))


@query("SELECT doc_id, true AS same FROM documents WHERE text IS NOT NULL")
def patch_create_roundtrip(spark, sf_dir):
    """Every text with a part of its middle shouted and more at both ends."""
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.lit("start "), F.substring("text", 1, half), F.upper(F.substr("text", half + 1, F.lit(20))), F.substr("text", half + 21), F.lit(" end"))
    rows = spread(_table(spark, sf_dir, "documents").select("doc_id", "text").where("text is not null")).withColumn("edited", edited)
    rows = rows.withColumn("ops", patches.create_patch("text", "edited"))
    return rows.select("doc_id", (patches.apply_patch(F.col("text"), F.col("ops")) == F.col("edited")).alias("same"))


@query(r"""WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
n AS (SELECT *, len(ls) AS n, (doc_id * 7) % len(ls) + 1 AS "at", doc_id % 9 - 4 AS off FROM d),
h AS (SELECT *, greatest(1, "at" - 1) AS head, least(n, "at" + 1) AS tail, greatest(1, greatest(1, "at" - 1) + off) AS told FROM n),
p AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY abs(i - told), i < told) AS nth FROM h, unnest(range(1, n - (tail - head) + 1)) u(i) WHERE ls[i:i + tail - head] = ls[head:tail])
SELECT h.doc_id, i::BIGINT AS line, sha256(array_to_string(list_concat(ls[1:i + "at" - head - 1], [ls["at"] || ' (changed)'], ls[i + "at" - head + 1:]), chr(10))) AS patched FROM h JOIN p ON p.doc_id = h.doc_id AND nth = 1""")
def legacy_patch(spark, sf_dir):
    """An old unified diff of one line for every text, with the lines around it, that tells another line than where it fits."""
    rows = _table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", F.split("text", "\n").alias("ls"))
    rows = rows.withColumn("n", F.size("ls")).withColumns({"at": F.expr("int(doc_id * 7 % n + 1)"), "off": F.expr("int(doc_id % 9 - 4)")})
    rows = rows.withColumns({"first": F.expr("greatest(1, at - 1)"), "last": F.expr("least(n, at + 1)")}).withColumn("told", F.expr("greatest(1, first + off)"))
    line = lambda mark, k: F.concat(F.lit(mark), F.get("ls", F.col(k) - 1 if isinstance(k, str) else k))
    size = F.expr("last - first + 1").cast("string")
    head = F.concat(F.lit("@@ -"), F.col("told").cast("string"), F.lit(","), size, F.lit(" +"), F.col("told").cast("string"), F.lit(","), size, F.lit(" @@"))
    before, after = F.when(F.col("first") < F.col("at"), F.array(line(" ", "first"))), F.when(F.col("last") > F.col("at"), F.array(line(" ", "last")))
    none = F.expr("cast(array() as array<string>)")
    body = F.concat(F.array(head), F.coalesce(before, none), F.array(line("-", "at"), F.concat(line("+", "at"), F.lit(" (changed)"))), F.coalesce(after, none))
    rows = rows.withColumn("ops", F.get(patches.legacy_patches(F.array("text"), F.array(F.array_join(body, "\n"))), F.lit(0)))
    # the line that the patch's one place is on
    rows = rows.withColumn("patched", patches.apply_patch(F.col("text"), F.col("ops")))
    changed = F.size(F.split(F.substring(F.col("text"), F.lit(1), F.get("ops", F.lit(0))["start"]), "\n"))
    return rows.select("doc_id", (changed - (F.col("at") - F.col("first"))).cast("long").alias("line"), F.sha2("patched", 256).alias("patched"))


@query("""SELECT doc_id, sha256(replace(text, 'E', 'Ee')) AS text, contains(text, 'E') AS changed, (length(text) - length(replace(text, 'E', '')))::INT AS marks,
  'Skipping non-ALL-CAPS correction "the" in excerpt P' || doc_id || '.' || CASE WHEN contains(text, 'E') THEN '' ELSE '|Could not find "E" in excerpt P' || doc_id || '.' END AS issues FROM documents WHERE text IS NOT NULL""")
def corrections_apply(spark, sf_dir):
    fixes = F.expr("array(named_struct('match', 'the', 'replacement', 'x'), named_struct('match', 'E', 'replacement', 'Ee'), named_struct('match', 'E', 'replacement', 'Ee'))")
    fixed = corrections.fix_all_caps(F.col("text"), fixes, F.expr("cast(array() as array<string>)"), F.concat(F.lit("P"), F.col("doc_id").cast("string")))
    rows = _table(spark, sf_dir, "documents").where("text is not null").select("doc_id", fixed.alias("f"))
    return rows.select("doc_id", F.sha2("f.text", 256).alias("text"), "f.changed", F.size("f.highlights").alias("marks"), F.array_join("f.issues", "|").alias("issues"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'he said  then ' ELSE 'he قال then ' || doc_id END AS text, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'Skipping unmatched Arabic correction "قال" in excerpt P.' ELSE 'Could not find "كان" in excerpt P.' END AS issues
FROM documents WHERE text IS NOT NULL""".replace("'he said  then '", "'he said then ' || doc_id"))
def corrections_leaks(spark, sf_dir):
    """A leak that is replaced, one that no hint names, and one that isn't there."""
    case = F.col("doc_id") % 3
    fix = F.array(F.struct(F.when(case == 2, "كان").otherwise("قال").alias("match"), F.lit("said").alias("replacement")))
    hints = F.when(case == 1, F.array(F.lit("كان"))).otherwise(F.expr("cast(array() as array<string>)"))
    fixed = corrections.fix_arabic_leaks(F.concat(F.lit("he قال then "), F.col("doc_id").cast("string")), fix, hints, F.lit("P"))
    rows = _table(spark, sf_dir, "documents").where("text is not null").select("doc_id", fixed.alias("f"))
    return rows.select("doc_id", "f.text", F.array_join("f.issues", "|").alias("issues"))


@query("SELECT doc_id, ((length(text) - length(replace(text, 'th', ''))) // 2)::INT AS n FROM documents WHERE text IS NOT NULL")
def literal_occurrences(spark, sf_dir):
    return _table(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.occurrences(F.col("text"), F.lit("th")).alias("n"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents WHERE text IS NOT NULL")
def payload_hash(spark, sf_dir):
    return _table(spark, sf_dir, "documents").where("text is not null").select("doc_id", sha256(F.col("text")).alias("hash"))


@query("SELECT doc_id, 'P' || doc_id AS id, 'x' AS match, source AS replacement FROM documents WHERE text IS NOT NULL")
def json_recover(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").where("text is not null")
    item = F.struct(F.concat(F.lit("P"), F.col("doc_id").cast("string")).alias("id"), F.lit("x").alias("match"), F.col("source").alias("replacement"))
    reply = F.concat(F.lit("Sure: "), F.to_json(F.struct(F.array(item, item).alias("corrections"))), F.lit("\nDone} "))
    return rows.select("doc_id", F.explode(corrections.parse_corrections(reply)).alias("c")).select("doc_id", "c.id", "c.match", "c.replacement")


# ---- playback ----


@query(f"{_PLAY} SELECT state, count(*) AS candidates, count(DISTINCT id) AS ids, coalesce(max(nth), 0) AS most FROM ranked GROUP BY state")
def playback_classify(spark, sf_dir):
    rows = playback.classify(candidates_view(spark, sf_dir), targets_view(spark, sf_dir))
    return rows.groupBy("state").agg(F.count(F.lit(1)).alias("candidates"), F.countDistinct("id").alias("ids"), F.coalesce(F.max("nth"), F.lit(0)).cast("long").alias("most"))


@query(f"""{_PLAY}, x AS (SELECT *, max(nth) OVER (PARTITION BY id) AS most FROM ranked), y AS (SELECT CASE WHEN state <> 'playable' THEN state WHEN most > 1 THEN 'duplicate' END AS kind, id, path FROM x)
SELECT kind, id, string_agg(DISTINCT path, ',' ORDER BY path) AS paths FROM y WHERE kind IS NOT NULL GROUP BY kind, id""")
def playback_issues(spark, sf_dir):
    return playback.issues(playback.classify(candidates_view(spark, sf_dir), targets_view(spark, sf_dir)))


@query(f"""{_PLAY}, f AS (SELECT id, translator, ts FROM ranked WHERE nth = 1), n AS (SELECT id, count(*) - 1 AS alts FROM ranked WHERE state = 'playable' GROUP BY id)
SELECT t.id, t.idx, CASE WHEN f.id IS NULL THEN t.translator ELSE f.translator END AS translator, CASE WHEN f.id IS NULL THEN t.ts ELSE f.ts END AS last_updated_at, coalesce(alts, 0)::INT AS alts
FROM targets t LEFT JOIN f USING (id) LEFT JOIN n USING (id)""")
def playback_merge(spark, sf_dir):
    targets = targets_view(spark, sf_dir)
    merged = playback.merge(targets, playback.classify(candidates_view(spark, sf_dir), targets))
    return merged.select("id", "idx", "translator", "last_updated_at", F.size("alt").alias("alts"))


@query(f"{_PLAY} SELECT count(*) AS candidates, count(*) FILTER (state = 'playable') AS applied, count(*) FILTER (state = 'unknown') AS unknown, count(*) FILTER (state = 'already_translated') AS already_translated FROM ranked")
def playback_counters(spark, sf_dir):
    return playback.counters(playback.classify(candidates_view(spark, sf_dir), targets_view(spark, sf_dir)))


# ---- ingest ----

_EVENTS = """ev AS (SELECT 'u' || user_id AS id, event_id AS arrival, CASE WHEN event_id % 11 <> 0 THEN event_id - CASE WHEN event_id % 5 = 0 THEN 400 ELSE 0 END END AS seq,
  CASE WHEN event_id % 3 <> 0 THEN 'k' || (event_id % 1999) END AS key, props AS payload FROM events)"""


@query(f"WITH {_EVENTS} SELECT key, arg_min(id, arrival) AS id, min(arrival) AS arrival FROM ev WHERE key IS NOT NULL GROUP BY key")
def ingest_first_by_key(spark, sf_dir):
    return ingest.first_by_key(events_view(spark, sf_dir))


@query(f"WITH {_EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC, arrival) AS n FROM ev WHERE seq IS NOT NULL) SELECT id, seq, arrival FROM r WHERE n = 1")
def ingest_latest_seq(spark, sf_dir):
    return ingest.latest_by_seq(events_view(spark, sf_dir).where("seq is not null"))


#: A walk over the events in order of arrival, one a step, with what is saved under each key and conversation beside it.
_WALK = f"""WITH RECURSIVE {_EVENTS},
line AS (SELECT *, row_number() OVER (ORDER BY arrival) AS step FROM ev),
walk(k, step, seq, outcome) USING KEY (k) AS (
  SELECT 'now', 0::BIGINT, NULL::BIGINT, NULL::VARCHAR
  UNION
  SELECT u.row.k, u.row.step, u.row.seq, u.row.outcome
  FROM (SELECT l.*, CASE WHEN seen.k IS NOT NULL THEN 'duplicate' WHEN l.seq <= kept.seq THEN 'stale' ELSE 'saved' END AS outcome
        FROM walk w JOIN line l ON l.step = w.step + 1
        LEFT JOIN recurring.walk seen ON seen.k = 'key ' || l.key LEFT JOIN recurring.walk kept ON kept.k = 'id ' || l.id WHERE w.k = 'now') e,
    unnest([{{k: 'now', step: e.step, seq: NULL::BIGINT, outcome: NULL::VARCHAR}}, {{k: 'event ' || e.arrival, step: e.arrival, seq: NULL::BIGINT, outcome: e.outcome}},
      {{k: 'id ' || e.id, step: 0::BIGINT, seq: e.seq, outcome: 'saved'}}, {{k: 'key ' || e.key, step: 0::BIGINT, seq: NULL::BIGINT, outcome: 'saved'}}]) u(row)
  WHERE u.row.k IS NOT NULL AND (u.row.k = 'now' OR starts_with(u.row.k, 'event ') OR e.outcome = 'saved')
)
SELECT id, arrival, outcome FROM walk JOIN ev ON k = 'event ' || arrival"""


@query(_WALK)
def ingest_idempotent(spark, sf_dir):
    return ingest.ingest_batch(events_view(spark, sf_dir)).select("id", "arrival", "outcome")


@query(_WALK)
def stream_ingest(spark, sf_dir):
    """The same by the stream, which is started and stopped for each quarter of the arrivals; its tables go to the shared folder."""
    events, folder = _table(spark, sf_dir, "events"), shared_folder(spark)
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    quarter = F.when(F.lit(high == low), 0).otherwise(F.least(F.lit(3), F.floor((F.col("event_id") - F.lit(low)) * 4 / F.lit((high or 0) - (low or 0)))))
    for k in range(4):
        events.where(quarter == k).write.mode("append").parquet(f"{folder}/in")
        ingest.ingest_available(events_of(spark.readStream.schema(events.schema).parquet(f"{folder}/in")), folder)
    return ingest.outcomes(spark, folder).select("id", "arrival", "outcome")


@query("SELECT thinking AS seconds, CASE WHEN thinking < 0 THEN NULL WHEN thinking < 10 THEN 'lt_10s' WHEN thinking < 30 THEN '10_to_30s' WHEN thinking < 60 THEN '30_to_60s' ELSE '1m_plus' END AS bucket, ceil(length(p_name) / 4)::BIGINT AS tokens, p_partkey FROM (SELECT *, (p_size * 2 - 9)::DOUBLE AS thinking FROM part)")
def value_functions(spark, sf_dir):
    seconds = (F.col("p_size") * 2 - 9).cast("double")
    return _table(spark, sf_dir, "part").select(seconds.alias("seconds"), thinking_bucket(seconds).alias("bucket"), estimate_tokens(F.col("p_name")).alias("tokens"), "p_partkey")


assert RULES  # the rules register themselves on import
