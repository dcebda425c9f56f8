"""Queries over conversation files: JSON of every shape is made of `conversations`, read back by the reader, and held against the table itself.

Customers stand in for files whose prompts, responses and edits go through segmenting, aligning, patching and validation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.offsets import raw_ranges
from ..functions.values import duration_text, platform, utc_text
from ..operators import corpus, corrections, files, packing, patches, playback
from ..operators.rules import validate
from ..sources import conversations as S
from ..streaming.files import changed_files, shift_in_batches, shift_status
from . import edits, validity
from .queries import _CORPUS, _QUEUE, _RESPONSES, _table, corpus_view, query, responses_view
from .tables import materialize, shared_folder, snapshot, spread

# ---- files made of the conversations table ----

def _empty():
    return F.lit(None).cast("string")


def _talks(spark, sf_dir) -> DataFrame:
    """(conv_id, turns): the turns in order."""
    rows = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return rows.withColumns({"cid": F.concat(F.lit("c"), F.col("conv_id").cast("string")), "k": F.col("conv_id").cast("int")})


def _chat(rows: DataFrame) -> DataFrame:
    """rows with content: the chat shape, with padded senders, two model names, thinking times, traces and steps."""
    k = F.col("k")
    sender = lambda t: F.when(t["role"] == "user", F.lit(" Human ")).otherwise(t["role"])
    date = lambda ms: F.struct(F.struct(ms.cast("long").cast("string").alias("$numberLong")).alias("$date"))
    model = F.when(k % 4 == 0, F.lit("grok-4")).when(k % 4 == 1, F.lit("auto"))
    steps = F.array(F.struct(F.array(F.lit("b"), F.lit("a")).alias("tag_order"), F.create_map(F.lit("a"), F.concat(F.lit("trace "), k.cast("string")), F.lit("b"), F.lit("step")).alias("tagged_text")))
    response = lambda t: F.struct(F.struct(
        F.concat(F.lit(" \t"), t["text"], F.lit("\n ")).alias("message"), sender(t).alias("sender"), F.when(k % 4 < 2, " grok-3 ").otherwise("Unknown").alias("model"),
        F.struct(F.struct(model.alias("model")).alias("request_metadata")).alias("metadata"),
        date(k.cast("long") * 10_000).alias("thinking_start_time"), date(k.cast("long") * 10_000 + (k % 5 - 1) * 1500).alias("thinking_end_time"),
        F.array(F.struct(F.concat(F.lit(" trace "), k.cast("string"), F.lit(" ")).alias("thinking_trace")), F.struct(F.lit(" ").alias("thinking_trace"))).alias("agent_thinking_traces"), steps.alias("steps"),
    ).alias("response"))
    head = F.struct(F.col("cid").alias("id"), F.when(k % 2 == 0, "").otherwise("Title").alias("title"), F.lit("2024-01-02T03:04:05Z").alias("create_time"), _empty().alias("modify_time"))
    return rows.withColumn("content", F.to_json(F.struct(head.alias("conversation"), F.transform("turns", response).alias("responses"))))


def _tree(rows: DataFrame) -> DataFrame:
    """rows with content: the tree shape. A root without a message, a node for each turn, one with thoughts before each of the assistant's, and a
    recap after those of every third conversation; every seventh is a cycle, every fifth points to a node that isn't there."""
    k = F.col("k")
    n = lambda t: F.concat(F.lit("n"), t.cast("string"))
    at = lambda t: 1000.0 + t["turn"] * 10
    slug = F.when(k % 4 == 0, "gpt-5-4-pro").when(k % 4 == 1, " gemini-3-pro ").when(k % 4 == 2, "grok-4")
    meta = F.create_map(F.lit("resolved_model_slug"), F.lit("auto"), F.lit("model_slug"), slug)
    kind = "struct<parent:string,message:struct<author:struct<role:string>,create_time:double,update_time:double,content:struct<content_type:string,parts:array<string>,content:string,thoughts:array<struct<content:string>>>,metadata:map<string,string>>>"
    none = "cast(null as array<struct<content:string>>)"

    def node(name, parent, role, create, update, content_type, parts, content, thoughts, metadata):
        body = F.struct(content_type.alias("content_type"), parts.alias("parts"), content.alias("content"), thoughts.alias("thoughts"))
        message = F.struct(F.struct(role.alias("role")).alias("author"), create.alias("create_time"), update.alias("update_time"), body.alias("content"), metadata.alias("metadata"))
        return F.struct(name.alias("key"), F.struct(parent.alias("parent"), message.alias("message")).cast(kind).alias("value"))

    no_meta = F.expr("cast(map() as map<string,string>)")
    no_parts = F.expr("cast(array() as array<string>)")

    def nodes(t):
        told, robot = t["role"] == "assistant", F.lit("assistant")
        thought, recap = F.concat(F.lit("t"), t["turn"].cast("string")), F.concat(F.lit("r"), t["turn"].cast("string"))
        above = F.when(t["turn"] == 0, "root").otherwise(n(t["turn"] - 1))
        parent = F.when(told, F.when(k % 3 == 0, recap).otherwise(thought)).otherwise(above)
        think = F.array(F.struct(F.concat(F.lit(" think "), t["turn"].cast("string"), F.lit(" ")).alias("content")), F.struct(F.lit("again").alias("content")))
        own = node(n(t["turn"]), parent, t["role"], at(t), F.when(told & (k % 2 == 0), at(t) + 5), F.lit("text"), F.array(F.concat(F.lit(" "), t["text"], F.lit("\n"))), _empty(), F.expr(none), F.when(told, meta).otherwise(no_meta))
        first = node(thought, above, robot, at(t) - 3, F.lit(None).cast("double"), F.lit("thoughts"), no_parts, _empty(), think, no_meta)
        second = node(recap, thought, robot, at(t) - 2, F.lit(None).cast("double"), F.lit("reasoning_recap"), no_parts, F.lit("Thought for 22s"), F.expr(none), no_meta)
        return F.when(told & (k % 3 == 0), F.array(first, second, own)).when(told, F.array(first, own)).otherwise(F.array(own))

    last = n(F.element_at("turns", -1)["turn"])
    root = F.array(F.struct(F.lit("root").alias("key"), F.struct(F.when(k % 7 == 3, last).alias("parent"), F.lit(None).alias("message")).cast(kind).alias("value")))
    mapping = F.map_from_entries(F.concat(root, F.flatten(F.transform("turns", nodes))))
    nothing = F.expr("cast(array() as array<string>)")
    tree = F.struct(
        F.lit("T").alias("title"), F.lit(1.5).alias("create_time"), F.lit(2.0).alias("update_time"), F.col("cid").alias("conversation_id"), F.when(k % 5 == 4, "gone").otherwise(last).alias("current_node"),
        F.when(k % 8 == 3, "auto").otherwise("o3").alias("default_model_slug"), nothing.alias("moderation_results"), nothing.alias("plugin_ids"), nothing.alias("safe_urls"), nothing.alias("blocked_urls"), mapping.alias("mapping"),
    )
    return rows.withColumn("content", F.to_json(tree))


def _files(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("cid").alias("path"), "content")


_TALKS = r"""t AS (SELECT conv_id, turn, role, trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS text FROM conversations),
k AS (SELECT DISTINCT conv_id, 'c' || conv_id AS cid, conv_id % 4 AS m FROM conversations)"""


@query(f"""WITH {_TALKS}, p AS (SELECT conv_id, arg_max(text, turn) FILTER (role = 'user') AS prompt, arg_max(text, turn) FILTER (role = 'assistant') AS response FROM t GROUP BY conv_id)
SELECT cid AS conversation_id, CASE WHEN conv_id % 2 = 1 THEN 'Title' END AS title, 'Grok' AS llm, CASE WHEN response IS NOT NULL THEN CASE m WHEN 0 THEN 'grok-4' WHEN 1 THEN 'grok-3' END END AS model, coalesce(prompt, '') AS prompt, coalesce(response, '') AS response,
  CASE WHEN response IS NULL THEN '' ELSE 'trace ' || conv_id || '|step' END AS reasoning, CASE WHEN conv_id % 5 > 1 AND response IS NOT NULL THEN floor((conv_id % 5 - 1) * 1.5 + 0.5)::DOUBLE END AS reasoning_sec, '2024-01-02T03:04:05Z' AS created_at
FROM k JOIN p USING (conv_id)""")
def conv_chat_shape(spark, sf_dir):
    found = S.to_common(_files(_chat(_talks(spark, sf_dir))))
    return found.select("conversation_id", "title", "llm", "model", "prompt", "response", F.array_join("reasoning", "|").alias("reasoning"), "reasoning_sec", "created_at")


_TREE = f"""{_TALKS}, a AS (SELECT conv_id, max(turn) AS last FROM t WHERE role = 'assistant' GROUP BY conv_id),
u AS (SELECT conv_id, max(turn) AS asked FROM t JOIN a USING (conv_id) WHERE role = 'user' AND turn < last GROUP BY conv_id),
r AS (SELECT conv_id, arg_max(text, turn) FILTER (text <> '') AS response, min(turn) AS from_turn, max(turn) AS to_turn, string_agg('think ' || turn || CASE WHEN turn = from_ THEN '|again' ELSE '' END || CASE WHEN conv_id % 3 = 0 AND turn = from_ THEN '|Thought for 22s' ELSE '' END, '|' ORDER BY turn) AS reasoning
  FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS from_ FROM t JOIN a USING (conv_id) LEFT JOIN u USING (conv_id) WHERE role = 'assistant' AND turn <= last AND turn > coalesce(asked, -1)) x GROUP BY conv_id),
f AS (SELECT k.*, a.last, coalesce((SELECT text FROM t WHERE t.conv_id = k.conv_id AND t.turn = coalesce(asked, CASE WHEN last IS NOT NULL OR k.conv_id % 5 <> 4 THEN (SELECT max(turn) FROM t x WHERE x.conv_id = k.conv_id AND role = 'user' AND (last IS NULL OR turn < last)) END)), '') AS prompt, coalesce(response, '') AS response, coalesce(reasoning, '') AS reasoning,
  from_turn, to_turn, coalesce(CASE WHEN last IS NOT NULL THEN CASE m WHEN 0 THEN 'gpt-5-4-pro' WHEN 1 THEN 'gemini-3-pro' WHEN 2 THEN 'grok-4' END END, CASE WHEN k.conv_id % 8 <> 3 THEN 'o3' END) AS model
  FROM k LEFT JOIN a USING (conv_id) LEFT JOIN u USING (conv_id) LEFT JOIN r USING (conv_id))"""


@query(f"""WITH {_TREE}
SELECT cid AS conversation_id, model, CASE WHEN model LIKE 'g%i%' THEN 'Gemini' WHEN model LIKE 'grok%' THEN 'Grok' WHEN model IS NULL THEN 'Unknown' ELSE 'ChatGPT' END AS llm, prompt, response, reasoning,
  CASE WHEN last IS NULL THEN NULL WHEN model = 'gpt-5-4-pro' OR model = 'o3' THEN CASE WHEN conv_id % 3 = 0 THEN 22.0 END ELSE (to_turn - from_turn) * 10.0 + 3 + CASE WHEN conv_id % 2 = 0 THEN 5 ELSE 0 END END AS reasoning_sec,
  '1970-01-01T00:00:01.500Z' AS created_at, CASE WHEN model IS NULL THEN 'Could not detect model' END AS error FROM f""")
def conv_tree_shape(spark, sf_dir):
    found = S.to_common(_files(_tree(_talks(spark, sf_dir))))
    return found.select("conversation_id", "model", "llm", "prompt", "response", F.array_join("reasoning", "|").alias("reasoning"), "reasoning_sec", "created_at", "error")


@query(f"WITH {_TREE} SELECT conv_id, prompt, response FROM f")
def conv_last_turns(spark, sf_dir):
    found = S.to_common(_files(_tree(_talks(spark, sf_dir))))
    return found.select(F.substring("path", 2, 20).cast("long").alias("conv_id"), "prompt", "response")


@query(f"""WITH {_TALKS} SELECT cid AS path, CASE conv_id % 9 WHEN 0 THEN 'tree' WHEN 1 THEN 'wrapper' WHEN 2 THEN 'wrapper' WHEN 3 THEN 'wrapper' WHEN 4 THEN 'chat' WHEN 5 THEN 'common' WHEN 6 THEN 'unknown' WHEN 7 THEN 'unreadable' ELSE 'unknown' END AS shape,
  CASE WHEN conv_id % 9 IN (1, 3) THEN '{{"skip":["P1"]}}' END AS edits, CASE WHEN conv_id % 9 = 1 THEN '{{"by":"x"}}' END AS capture, CASE WHEN conv_id % 9 < 6 THEN cid END AS conversation_id,
  CASE conv_id % 9 WHEN 6 THEN 'Input does not match a supported translation JSON shape.' WHEN 8 THEN 'Input does not match a supported translation JSON shape.' WHEN 7 THEN 'not JSON' END AS error FROM k""")
def conv_shapes(spark, sf_dir):
    """Every shape, wrapped and broken ones, with the edits and the capture that some carry."""
    rows = _tree(_talks(spark, sf_dir).withColumn("k", (F.col("conv_id") - F.col("conv_id") % 4).cast("int")))  # all with a model
    rows = rows.withColumn("tree", F.col("content"))
    chat = _chat(rows).select("conv_id", F.col("content").alias("chat"))
    rows = rows.join(chat, "conv_id")
    kind, say = F.col("conv_id") % 9, lambda text: F.format_string(text, "tree")
    extra = '"__edits": {"skip":["P1"]}'
    content = (
        F.when(kind == 0, F.col("tree")).when(kind == 1, say('{"format": "original", "data": %s, ' + extra + ', "__capture": {"by":"x"}}')).when(kind == 2, say('{"payload": %s}'))
        .when(kind == 3, say('{"data": {"payload": %s, ' + extra + "}}")).when(kind == 4, F.col("chat"))
        .when(kind == 5, F.to_json(F.struct(F.lit("common").alias("format"), F.col("cid").alias("conversation_id"), F.lit("p").alias("prompt"), F.lit("r").alias("response"))))
        .when(kind == 6, F.lit('{"hello": 1}')).when(kind == 7, F.lit('{"bad')).otherwise("[]")
    )
    found = S.to_common(rows.select(F.col("cid").alias("path"), content.alias("content")))
    return found.select("path", "shape", "edits", "capture", "conversation_id", "error")


@query("SELECT 'c' || (conv_id // 2) AS conversation_id, max(conv_id) AS last FROM conversations GROUP BY 1")
def conv_mass_export(spark, sf_dir):
    """Exports of many conversations, in which every id comes twice: the last stays."""
    item = F.struct(F.struct(F.concat(F.lit("c"), F.floor(F.col("conv_id") / 2).cast("string")).alias("id")).alias("conversation"), F.col("conv_id").alias("last"))
    rows = _table(spark, sf_dir, "conversations").select("conv_id").distinct().groupBy(F.format_string("%09d", F.floor(F.col("conv_id") / 10)).alias("path"))
    rows = rows.agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("conv_id", item.alias("item")))).alias("c"))).alias("c"))
    rows = rows.select("path", F.to_json(F.struct(F.transform(F.from_json("c", "c array<struct<item:struct<conversation:struct<id:string>,last:long>>>")["c"], lambda x: x["item"]).alias("conversations"))).alias("content"))
    return S.mass_export(rows).select("conversation_id", F.get_json_object("content", "$.last").cast("long").alias("last"))


# ---- files that go through the whole analysis ----

_CASES = "c_custkey % 7"


def analysed_view(spark, sf_dir) -> DataFrame:
    """Analyses of a file for each customer: clean, with a leak (bare, patched or skipped), a lost segment, shouting, or no marker at all."""
    rows = spread(_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    case = F.col("c_custkey") % 7
    two = F.when(case.isin(1, 2, 3), "two قال x").when(case == 5, "THEY KNEW THAT THE BUYER left").otherwise("two")
    three = F.when(case == 4, "\nP3 - …").otherwise("\nP3 - three")
    response = F.when(case == 6, "nothing is marked").otherwise(F.concat(F.lit("P1 - one\nP2 - "), two, three))
    edit = F.when(case == 2, '{"patches": {"P2": {"ops": [{"start": 4, "end": 9, "text": "said"}]}}}').when(case == 3, '{"skip": ["P2", " "]}')
    model = F.when(F.col("c_nationkey") % 2 == 0, "grok-4").otherwise("gpt-5-4-pro")
    return materialize(validity.analyse(rows.select(
        F.concat(F.lit("f/"), F.col("c_custkey").cast("string"), F.lit(".json")).alias("path"), F.col("c_custkey").alias("key"), F.lit("P1 - alif\nP2 - ba\nP3 - jim").alias("prompt"), response.alias("response"), model.alias("model"),
        edit.alias("edits"), _empty().alias("error"), F.lit(5.0).alias("reasoning_sec"), F.lit("2024-01-02T03:04:05.900Z").alias("created_at"), _empty().alias("updated_at"),
    )))


_ANALYSED = f"""f AS (SELECT c_custkey AS key, 'f/' || c_custkey || '.json' AS path, {_CASES} AS k, CASE WHEN c_nationkey % 2 = 0 THEN 895 ELSE 903 END AS translator FROM customer)"""


@query(f"WITH {_ANALYSED} SELECT path, k IN (0, 2, 3) AS is_valid, (k = 2)::INT AS patches_applied, (CASE WHEN k IN (0, 2, 3) THEN 0 WHEN k = 6 THEN 8 ELSE 1 END)::INT AS errors, (CASE WHEN k IN (0, 2, 3) THEN 0 WHEN k = 6 THEN 8 ELSE 1 END)::INT AS visible FROM f")
def file_analysis(spark, sf_dir):
    return analysed_view(spark, sf_dir).select("path", "is_valid", "patches_applied", F.size("errors").alias("errors"), F.size("visible_errors").alias("visible"))


_WHY = "CASE k WHEN 1 THEN 'arabic_leak' WHEN 4 THEN 'truncated_segment' WHEN 5 THEN 'all_caps' ELSE 'truncated_segment' END"


@query(f"""WITH {_ANALYSED}, x AS (SELECT path, k, CASE k WHEN 4 THEN 'P3' ELSE 'P2' END AS id, CASE k WHEN 6 THEN 1 ELSE 0 END AS row_order FROM f WHERE k IN (1, 4, 5)
  UNION ALL SELECT path, k, id, row_order FROM f, (VALUES ('P1', 0), ('P2', 1), ('P3', 2), (NULL, 3)) v(id, row_order) WHERE k = 6)
SELECT path, row_order::INT AS row_order, id, CASE WHEN id IS NULL THEN NULL WHEN k = 1 THEN 'two قال x' WHEN k = 5 THEN 'THEY KNEW THAT THE BUYER left' WHEN k = 4 THEN '…' ELSE '' END AS translation,
  CASE WHEN id IS NULL THEN 'invalid_marker_format|newline_after_id' ELSE {_WHY} END AS error_types,
  CASE WHEN id IS NULL THEN '5' WHEN k = 1 THEN 'Arabic script detected: "قال"' WHEN k = 5 THEN 'ALL CAPS detected: "THEY KNEW THAT THE BUYER"' ELSE 'Truncated segment detected: "' || id || '" - segments must be fully translated' END AS messages,
  CASE WHEN k = 1 THEN 'قال' ELSE '' END AS leak_hints, CASE WHEN k = 5 THEN 'THEY KNEW THAT THE BUYER' ELSE '' END AS caps_hints, CASE k WHEN 1 THEN '4-7' WHEN 5 THEN '0-24' ELSE '' END AS ranges FROM x""")
def invalid_rows(spark, sf_dir):
    rows = validity.invalid_excerpts(analysed_view(spark, sf_dir))
    messages = F.when(F.col("id").isNull(), F.size("messages").cast("string")).otherwise(F.array_join("messages", "|"))
    shown = F.array_join(F.transform("ranges", lambda r: F.concat_ws("-", r["start"], r["end"])), "|")
    joined = [F.array_join(c, "|").alias(c) for c in ("error_types", "leak_hints", "caps_hints")]
    return rows.select("path", "row_order", "id", "translation", *joined, messages.alias("messages"), shown.alias("ranges"))


@query(f"WITH {_ANALYSED} SELECT path, 'P2' AS id FROM f WHERE k IN (1, 5)")
def fixable_rows(spark, sf_dir):
    return validity.fixable(validity.invalid_excerpts(analysed_view(spark, sf_dir))).select("path", "id")


@query(f"""WITH {_ANALYSED}, s(pos, id, arabic) AS (VALUES (0, 'P1', 'alif'), (1, 'P2', 'ba'), (2, 'P3', 'jim'))
SELECT path, pos, id, arabic, CASE WHEN k = 6 THEN '' WHEN id = 'P1' THEN 'one' WHEN id = 'P3' THEN CASE k WHEN 4 THEN '…' ELSE 'three' END WHEN k = 2 THEN 'two said' WHEN k IN (1, 3) THEN 'two قال x' WHEN k = 5 THEN 'THEY KNEW THAT THE BUYER left' ELSE 'two' END AS translation,
  k = 2 AND id = 'P2' AS has_patch, k = 3 AND id = 'P2' AS is_skipped, k = 6 AS is_missing, ((k IN (1, 5) AND id = 'P2') OR (k = 4 AND id = 'P3') OR k = 6)::INT AS messages FROM f, s""")
def review_table(spark, sf_dir):
    rows = validity.review_rows(analysed_view(spark, sf_dir))
    return rows.select("path", "pos", "id", "arabic", "translation", F.coalesce("has_patch", F.lit(False)).alias("has_patch"), "is_skipped", "is_missing", F.size("messages").alias("messages"))


@query(f"""WITH {_ANALYSED}, s(pos, id, nass) AS (VALUES (0, 'P1', 'alif'), (1, 'P2', 'ba'), (2, 'P3', 'jim'))
SELECT path, id, nass, CASE id WHEN 'P1' THEN 'one' WHEN 'P2' THEN CASE k WHEN 2 THEN 'two said' ELSE 'two' END ELSE 'three' END AS text, translator, 1704164645::BIGINT AS last_updated_at FROM f, s WHERE k IN (0, 2) OR (k = 3 AND id <> 'P2')""")
def playable_rows(spark, sf_dir):
    return validity.candidates(analysed_view(spark, sf_dir)).select("path", "id", "nass", "text", "translator", "last_updated_at")


@query(f"WITH {_ANALYSED} SELECT count(*) AS total_files, count(*) FILTER (k IN (0, 2, 3)) AS valid_files, count(*) FILTER (k NOT IN (0, 2, 3)) AS invalid_files, (count(*) FILTER (k = 2))::BIGINT AS patches_applied FROM f")
def validated_files(spark, sf_dir):
    return files.stats(validity.file_rows(analysed_view(spark, sf_dir)))


# ---- the rules that the other queries leave out ----


@query("""SELECT doc_id, 'newline_after_id' AS rule, 'P1 -' || chr(10) AS match, NULL AS id FROM documents WHERE text IS NOT NULL AND doc_id % 4 = 0
UNION ALL SELECT doc_id, 'all_caps', 'ONE TWO THREE FOUR FIVE', 'P2' FROM documents WHERE text IS NOT NULL AND doc_id % 4 = 1
UNION ALL SELECT doc_id, 'multiword_translit_without_gloss', 'al-a fi al-b', 'P1' FROM documents WHERE text IS NOT NULL AND doc_id % 4 = 2
UNION ALL SELECT doc_id, 'no_valid_markers', 'nothing here ' || doc_id, NULL FROM documents WHERE text IS NOT NULL AND doc_id % 4 = 3""")
def rule_errors(spark, sf_dir):
    case = F.col("doc_id") % 4
    response = (
        F.when(case == 0, "P1 -\nP2 - b").when(case == 1, "P1 - Fine Words\nP2 - x ONE TWO THREE FOUR FIVE y").when(case == 2, "P1 - see al-a  fi al-b now, without any gloss in brackets at all\nP2 - al-c fi al-d (glossed)")
        .otherwise(F.concat(F.lit("nothing here "), F.col("doc_id").cast("string")))
    )
    rows = _table(spark, sf_dir, "documents").where("text is not null").select("doc_id", response.alias("response"), F.expr("cast(array() as array<struct<id:string,text:string>>)").alias("source"))
    found = validate(rows, rules=["newline_after_id", "all_caps", "multiword_translit_without_gloss"])
    return found.select("doc_id", F.explode_outer("errors").alias("e")).where("e is not null").select("doc_id", "e.rule", "e.match", "e.id")


@query(f"""WITH {_RESPONSES}, x AS (SELECT doc_id, length('note' || chr(10) || id1 || ' - ') AS head, length(id1) AS n, t1, t2, length(t1) - length(ltrim(t1, ' ' || chr(9) || chr(160))) AS lead, trim(t1, ' ' || chr(9) || chr(160)) AS own FROM resp)
SELECT doc_id, (head + lead)::INT AS first_start, (head + lead + length(own))::INT AS first_end, (head + length(t1) + n + 4)::INT AS second_start, (head + length(t1) + n + 4 + length(t2))::INT AS second_end FROM x""")
def raw_offsets(spark, sf_dir):
    """Where the two segments stand in the response as it was written, before its glued marker was put on a line of its own."""
    rows = responses_view(spark, sf_dir).withColumn("parsed", T.segments(T.normalize(F.col("response"))))
    rows = rows.withColumns({"starts": F.transform("parsed", lambda s: s["start"]), "ends": F.transform("parsed", lambda s: s["end"])})
    rows = rows.withColumn("r", raw_ranges("response", "starts", "ends"))
    at = lambda i, k: F.get("r", F.lit(i))[k]
    return rows.select("doc_id", at(0, "start").alias("first_start"), at(0, "end").alias("first_end"), at(1, "start").alias("second_start"), at(1, "end").alias("second_end"))


@query("SELECT doc_id, chr(10) || 'Amr: ' || doc_id AS text, 'Amr|Zayd' AS labels FROM documents WHERE text IS NOT NULL")
def speakers(spark, sf_dir):
    text = F.concat(F.lit("Amr: a\nZayd : b\nAmr: c Zayd: d\nOnce: e\nAmr: "), F.col("doc_id").cast("string"))
    rows = _table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.alias("t"))
    return rows.select("doc_id", F.concat(F.lit("\n"), F.element_at(F.split("t", "\n"), -1)).alias("text"), F.array_join(T.speaker_labels(F.col("t")), "|").alias("labels"))


# ---- patches and edits ----


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE '0-2-a|' || CASE doc_id % 3 WHEN 1 THEN '2' ELSE '5' END || '-7-b' END AS ops FROM documents""")
def patches_checked(spark, sf_dir):
    """Overlapping edits are no patch; others come in order."""
    ops = F.expr("array(named_struct('start', int(case doc_id % 3 when 0 then 1 when 1 then 2 else 5 end), 'end', 7, 'text', 'b'), named_struct('start', 0, 'end', 2, 'text', 'a'))")
    shown = F.array_join(F.transform(patches.checked(ops), lambda o: F.concat_ws("-", o["start"], o["end"], o["text"])), "|")
    return _table(spark, sf_dir, "documents").select("doc_id", shown.alias("ops"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '0-10' WHEN 1 THEN '0-2|4-10' ELSE '0-2|3-6=t' END AS shown FROM documents""")
def highlights_merged(spark, sf_dir):
    """Untitled ranges with blanks alone between them become one; letters between them, or a title, keep them apart."""
    case = F.col("doc_id") % 3
    text = F.when(case == 0, "ab \tcd   ef").otherwise("ab xcd   ef")
    mark = lambda a, b, title=None: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(title).cast("string").alias("title"))
    found = F.when(case == 2, F.array(mark(3, 6, "t"), mark(0, 2))).otherwise(F.array(mark(9, 10), mark(4, 6), mark(0, 2), mark(7, 7)))
    shown = F.array_join(F.transform(patches.merge_highlights(text, found), lambda h: F.concat(h["start"].cast("string"), F.lit("-"), h["end"].cast("string"), F.coalesce(F.concat(F.lit("="), h["title"]), F.lit("")))), "|")
    return _table(spark, sf_dir, "documents").select("doc_id", shown.alias("shown"))


@query("""SELECT 'f' || c_custkey AS path, CASE c_custkey % 5 WHEN 0 THEN '{"patches":{"P1":{"ops":[{"start":0,"end":1,"text":"n"}]}},"patchMetadata":{"P1":{"by":"' || c_custkey || '"}},"skip":["P2"]}'
  WHEN 1 THEN NULL WHEN 2 THEN '{"skip":["P2","P3"]}' WHEN 3 THEN '{"patches":{"P1":{"ops":[{"start":3,"end":4,"text":"o"}]}}}' ELSE '{"patches":{"P1":{"ops":[{"start":3,"end":4,"text":"o"}]}},"skip":["P2"]}' END AS edits FROM customer""")
def edits_applied(spark, sf_dir):
    """A new patch with metadata, a patch dropped with the last skip, an excerpt skipped, one taken off, and a file without changes."""
    case = F.col("c_custkey") % 5
    old = F.lit('{"patches":{"P1":{"ops":[{"start":3,"end":4,"text":"o"}]}},"skip":["P2"]}')
    rows = _table(spark, sf_dir, "customer").select("c_custkey", case.alias("k"), F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("path"), F.when(case == 2, '{"skip":["P2","P9"]}').otherwise(old).alias("edits"), F.array(*map(F.lit, ("P1", "P2", "P3"))).alias("known"))
    ops = "array<struct<start:int,end:int,text:string>>"
    new = F.when(F.col("k") == 0, F.expr("array(named_struct('start', 0, 'end', 1, 'text', 'n'))")).when(F.col("k") == 1, F.expr(f"cast(array() as {ops})"))
    note = F.when(F.col("k") == 0, F.to_json(F.struct(F.col("c_custkey").cast("string").alias("by"))))
    one = rows.where("k in (0, 1)").select("path", F.lit("P1").alias("id"), new.cast(ops).alias("ops"), note.alias("metadata"), F.lit(None).cast("boolean").alias("skip"))
    two = rows.where("k in (1, 2, 3)").select("path", F.when(F.col("k") == 2, "P3").otherwise("P2").alias("id"), F.lit(None).cast(ops).alias("ops"), F.lit(None).cast("string").alias("metadata"), (F.col("k") == 2).alias("skip"))
    return edits.apply_changes(rows.select("path", "edits", "known"), one.union(two)).select("path", "edits")


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'P1,P2' ELSE 'P2' END AS patched, CASE WHEN doc_id % 2 = 0 THEN 'P2' ELSE '' END AS noted, CASE doc_id % 3 WHEN 0 THEN 'P1,P2' WHEN 1 THEN 'P2' ELSE '' END AS skips FROM documents""")
def patch_maps(spark, sf_dir):
    """An edit put into a map of patches or, where it gives the base text again, taken out; the metadata that is left; and skip lists."""
    old = F.expr("map('P1', array(named_struct('start', 0, 'end', 1, 'text', 'x')), 'P2', array(named_struct('start', 0, 'end', 1, 'text', 'y')))")
    made = patches.upsert(old, F.lit("P1"), F.expr("array(named_struct('start', 0, 'end', 2, 'text', 'z'))"), F.lit("base"), F.when(F.col("doc_id") % 2 == 0, "edited").otherwise("base"))
    notes = F.when(F.col("doc_id") % 2 == 0, F.expr("map('P2', 'n', 'P7', 'gone')")).otherwise(F.expr("map('P1', 'gone')"))
    known, case = F.array(F.lit("P1"), F.lit("P2")), F.col("doc_id") % 3
    skips = patches.set_skip(F.when(case == 2, F.array(F.lit("P1"), F.lit("P9"), F.lit(" "))).otherwise(F.array(F.lit("P2"), F.lit("P9"))), known, F.lit("P1"), case == 0)
    keys = lambda m: F.coalesce(F.array_join(F.array_sort(F.map_keys(m)), ","), F.lit(""))
    return _table(spark, sf_dir, "documents").select("doc_id", keys(made).alias("patched"), keys(patches.prune(notes, made)).alias("noted"), F.coalesce(F.array_join(skips, ","), F.lit("")).alias("skips"))


# ---- corrections ----


def _suggested(spark, sf_dir) -> DataFrame:
    """Suggestions (pos, path, id, match, replacement) from line items; matches repeat, padded now and then."""
    line = _table(spark, sf_dir, "lineitem")
    number = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return line.select(
        number.alias("pos"), F.concat(F.lit("f"), (F.col("l_orderkey") % 50).cast("string")).alias("path"), F.concat(F.lit("P"), (F.col("l_partkey") % 40).cast("string")).alias("id"),
        F.concat(F.when(F.col("l_linenumber") % 2 == 0, " ").otherwise(""), F.lit("m"), (F.col("l_suppkey") % 30).cast("string")).alias("match"), F.col("l_returnflag").alias("replacement"),
    )


_SUGGESTED = """s AS (SELECT l_orderkey * 10 + l_linenumber AS pos, l_partkey, 'f' || (l_orderkey % 50) AS path, 'P' || (l_partkey % 40) AS id, CASE WHEN l_linenumber % 2 = 0 THEN ' ' ELSE '' END || 'm' || (l_suppkey % 30) AS match, l_returnflag AS replacement FROM lineitem)"""


@query(f"""WITH {_SUGGESTED}, o AS (SELECT trim(match) AS match, path, id, replacement, pos, row_number() OVER (PARTITION BY trim(match) ORDER BY pos, path, id, replacement) AS n FROM s),
r AS (SELECT match, replacement, min(n) AS first FROM o GROUP BY ALL)
SELECT match, count(*) AS seen, md5(string_agg(path || '#' || id, ',' ORDER BY n)) AS observations, (SELECT string_agg(replacement, ',' ORDER BY first) FROM r WHERE r.match = o.match) AS responses FROM o GROUP BY match""")
def leak_dictionary(spark, sf_dir):
    found = corrections.dictionary(_suggested(spark, sf_dir))
    return found.select("match", F.size("observations").cast("long").alias("seen"), F.md5(F.array_join("observations", ",")).alias("observations"), F.array_join("responses", ",").alias("responses"))


@query(f"""WITH {_SUGGESTED}, t AS (SELECT DISTINCT path, id FROM s WHERE pos % 3 = 0 OR id = 'P7')
SELECT t.path, t.id, count(s.pos) AS corrections, min(s.pos) AS first, (SELECT count(*) FROM s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.path = s.path AND t.id = s.id)) AS unmatched FROM t LEFT JOIN s USING (path, id) GROUP BY t.path, t.id""")
def corrections_attached(spark, sf_dir):
    made = materialize(_suggested(spark, sf_dir))
    rows = made.where("pos % 3 = 0 or id = 'P7'").select("path", "id").distinct()
    lost = corrections.unmatched(rows, made).agg(F.count(F.lit(1)).alias("unmatched"))
    found = corrections.attach(rows, made).select("path", "id", F.size("corrections").cast("long").alias("corrections"), F.element_at("corrections", 1)["pos"].alias("first"))
    return found.join(F.broadcast(lost))  # one row


@query(f"WITH {_SUGGESTED} SELECT id, match, replacement, min(pos) AS pos FROM s GROUP BY ALL")
def corrections_distinct(spark, sf_dir):
    return corrections.first_of_each(_suggested(spark, sf_dir)).select("id", "match", "replacement", "pos")


@query(f"WITH {_SUGGESTED} SELECT 'home' || (l_partkey % 40) AS path, pos, id FROM s")
def corrections_resolved(spark, sf_dir):
    made = _suggested(spark, sf_dir)
    asked = _table(spark, sf_dir, "part").select((F.col("p_partkey") % 40).cast("string").alias("n")).distinct().select(F.concat(F.lit("home"), "n").alias("path"), F.concat(F.lit("P"), "n").alias("id"))
    return corrections.resolve(made.drop("path"), asked).select("path", "pos", "id")


@query("""SELECT 'n' || c_nationkey AS path, 'Mend these.' || chr(10) || '{"excerpts":[' || string_agg('{"id":"P' || lpad(c_custkey::VARCHAR, 6, '0') || '","text":"' || c_mktsegment || '","hints":["' || c_name || '"]}', ',' ORDER BY lpad(c_custkey::VARCHAR, 6, '0')) || ']}' AS request FROM customer GROUP BY c_nationkey""")
def correction_requests(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("path"), F.concat(F.lit("P"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("id"), F.col("c_mktsegment").alias("translation"), F.array("c_name").alias("hints"))
    return corrections.request(rows, " Mend these. ")


# ---- files, the picker and the checkpoint ----


@query("""WITH p AS (SELECT DISTINCT CASE WHEN c_custkey % 3 = 0 THEN chr((97 + c_nationkey % 26)::INT) || '/x' || lpad((c_custkey % 100)::VARCHAR, 3, '0') ELSE CASE WHEN c_custkey % 2 = 0 THEN 'B' ELSE 'b' END || lpad((c_custkey % 200)::VARCHAR, 3, '0') END AS path FROM customer),
k AS (SELECT path, CASE WHEN contains(path, '/') THEN 0 ELSE 1 END AS is_file, lower(path) AS name, path[1] = upper(path[1]) AS upper_case FROM p)
SELECT path, row_number() OVER (ORDER BY is_file, name, upper_case) AS place FROM k""")
def files_in_tree_order(spark, sf_dir):
    """Folders before files, names in the root collation's order: small letters right before capitals."""
    key = F.col("c_custkey")
    folder = F.concat(F.chr(97 + F.col("c_nationkey") % 26), F.lit("/x"), F.lpad((key % 100).cast("string"), 3, "0"))
    path = F.when(key % 3 == 0, folder).otherwise(F.concat(F.when(key % 2 == 0, "B").otherwise("b"), F.lpad((key % 200).cast("string"), 3, "0")))
    rows = S.in_tree_order(_table(spark, sf_dir, "customer").select(path.alias("path")).distinct())
    return rows.select("path", F.row_number().over(Window.orderBy("file_order")).cast("long").alias("place"))  # as many rows as names in this view


@query(f"{_QUEUE} SELECT position, id, nass FROM queue WHERE position <= 41")
def picker_items(spark, sf_dir):
    return packing.picked(corpus.untranslated(corpus_view(spark, sf_dir)), packing.whole_number(" 40 ", 0), packing.whole_number("x", packing.MAX_IDS)).select("position", "id", "nass")


@query(f"{_QUEUE} SELECT 1700000000123::BIGINT AS source_mtime_ms, 1700000000123::BIGINT AS checkpoint_mtime_ms, 60::BIGINT AS shifted_count, (SELECT id FROM queue WHERE position = 60) AS last_shifted_id, true AS has_checkpoint, true AS checkpoint_valid")
def shift_checkpoint(spark, sf_dir):
    """Two batches of thirty are shifted; the checkpoint is of this version of the source."""
    queue, state = corpus.untranslated(corpus_view(spark, sf_dir)), shared_folder(spark)
    for _ in range(2):
        shift_in_batches(queue, lambda q: q.orderBy("collection_order", "idx").limit(30), state, 1_700_000_000_123)
    return shift_status(spark, state, 1_700_000_000_123)


@query("SELECT c_custkey AS size, 'f' || c_custkey AS path FROM customer WHERE c_custkey % 4 = 0 OR c_custkey % 10 = 1")
def files_to_analyse(spark, sf_dir):
    """New files, and those whose time of change is another than when they were analysed."""
    rows = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("size"), F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("path"), F.lit(5).alias("modified_ms"))
    before = rows.where("size % 4 <> 0").withColumn("modified_ms", F.when(F.col("size") % 10 == 1, 4).otherwise(5))
    return changed_files(rows, before).select("size", "path")


@query("SELECT 'f' || c_custkey AS path FROM customer WHERE c_custkey NOT IN (1, 7)")
def files_deleted(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer").select(F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("path"))
    return files.without(rows, ["f1", "f7", "f/none"])


@query("SELECT 'k=n' || n_nationkey AS folder, octet_length(encode('{\"name\":\"' || n_name || '\"}')) + 1 AS size, '{\"name\":\"' || n_name || '\"}' AS content, true AS dated FROM nation")
def files_read(spark, sf_dir):
    """A file for each nation, each in a folder of its own, read back with its path, size and time."""
    folder = shared_folder(spark)
    rows = _table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("k"), F.to_json(F.struct(F.col("n_name").alias("name"))).alias("value"))
    rows.write.partitionBy("k").text(folder)
    found = S.read_files(spark, folder, "*.txt")
    return found.select(F.split("path", "/")[0].alias("folder"), F.col("size").cast("long").alias("size"), "content", (F.col("modified_ms") > 1_600_000_000_000).alias("dated"))


@query(f"WITH {_CORPUS} SELECT collection, count(*) AS total, count(*) FILTER (coalesce(length(text), 0) > 0) AS translated FROM corpus GROUP BY collection")
def stats_snapshot(spark, sf_dir):
    """Counts kept as a snapshot of their source; the second call reads what the first wrote."""
    folder, source = shared_folder(spark), f"{sf_dir}/orders.parquet"
    snapshot(spark, folder, source, lambda: corpus.counts(corpus_view(spark, sf_dir)))
    return snapshot(spark, folder, source, lambda: spark.range(0)).select("collection", "total", "translated")


@query("SELECT doc_id, 3 AS labels, 2 AS at_starts FROM documents WHERE text IS NOT NULL")
def label_patterns(spark, sf_dir):
    """Labels with signs in them, anywhere and at the start of a line, behind a marker or not."""
    names = ["A. (b)", "Zayd"]
    text = F.concat(F.lit("P1 - Zayd: a A. (b) : b\nA. (b): c "), F.col("doc_id").cast("string"))
    rows = _table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.alias("t"))
    return rows.select("doc_id", F.regexp_count("t", F.lit(T.label_pattern(names))).alias("labels"), F.regexp_count("t", F.lit("(?m)" + T.line_start_label_pattern(names))).alias("at_starts"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'm' || CASE WHEN c_custkey % 3 = 1 THEN ' (v1)' ELSE '' END END AS model, CASE WHEN c_custkey % 3 <> 0 THEN 1704164645 ELSE 0 END::BIGINT AS applied_at, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'ChatGPT' ELSE 'Grok' END AS platform,
 strftime(make_timestamp(c_custkey * 86400000000), '%Y-%m-%d %H:%M:%S UTC') AS at, coalesce(nullif(CASE WHEN c_custkey // 1440 > 0 THEN (c_custkey // 1440) || 'd' || CASE WHEN c_custkey % 1440 > 0 THEN ' ' ELSE '' END ELSE '' END || CASE WHEN c_custkey % 1440 >= 60 THEN (c_custkey % 1440 // 60) || 'h' || CASE WHEN c_custkey % 60 > 0 THEN ' ' ELSE '' END ELSE '' END || CASE WHEN c_custkey % 60 > 0 THEN (c_custkey % 60) || 'm' ELSE '' END, ''), '0m') AS took FROM customer""")
def provenance_and_times(spark, sf_dir):
    case, key = F.col("c_custkey") % 3, F.col("c_custkey")
    meta = F.struct(F.when(case == 0, "no date").otherwise("2024-01-02T03:04:05Z").alias("appliedAt"), F.struct(F.lit("m").alias("model"), F.when(case == 1, "v1").alias("modelVersion"), F.lit("t").alias("task")).alias("source"))
    rows = _table(spark, sf_dir, "customer").select("c_custkey", F.when(case == 0, "other").when(case == 1, "o3-mini").otherwise("Grok-9").alias("name"), playback.provenance(meta).alias("p"))
    return rows.select("c_custkey", "p.model", F.coalesce("p.applied_at", F.lit(0)).cast("long").alias("applied_at"), platform(F.col("name")).alias("platform"), utc_text(key * 86_400).alias("at"), duration_text(key * 60).alias("took"))
