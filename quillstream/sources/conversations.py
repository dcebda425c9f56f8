"""Conversation files of four JSON shapes, as one table of conversations.

Common columns: path, shape, conversation_id, title, llm, model, prompt, response, reasoning, reasoning_sec,
created_at, updated_at, edits (the file's own record of patches and skips, as JSON), error. A file that
can't be read gets its reason in error; it never stops the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import find, index, let
from ..functions.text import trim
from ..functions.values import is_openai, iso_text, model_name, provider
from .json_items import archive_pieces, items

CHAT = """conversation struct<id:string,title:string,create_time:string,modify_time:string>,
 responses array<struct<response:struct<message:string,sender:string,model:string,metadata:struct<request_metadata:struct<model:string>>,
 thinking_start_time:struct<`$date`:struct<`$numberLong`:string>>,thinking_end_time:struct<`$date`:struct<`$numberLong`:string>>,
 agent_thinking_traces:array<struct<thinking_trace:string>>,steps:array<struct<tag_order:array<string>,tagged_text:map<string,string>>>>>>"""
_MESSAGE = """struct<author:struct<role:string>,create_time:double,update_time:double,
 content:struct<content_type:string,parts:array<variant>,content:string,thoughts:array<struct<content:string>>>,metadata:map<string,variant>>"""
TREE = f"""title string, create_time double, update_time double, conversation_id string, current_node string, default_model_slug string,
 mapping map<string,struct<parent:string,message:{_MESSAGE}>>"""
COMMON = """llm string, model string, title string, conversation_id string, created_at string, updated_at string, prompt string,
 response string, reasoning array<string>, reasoning_duration_sec double"""
_NONE = "cast(array() as array<string>)"
_OUT = ("conversation_id", "title", "llm", "model", "prompt", "response", "reasoning", "reasoning_sec", "created_at", "updated_at")


def read_files(spark: SparkSession, folder: str, glob: str = "*.json") -> DataFrame:
    """(path, name, size, modified_ms, content) of all files below a folder; path is relative to it."""
    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(folder)
    meta = F.col("_metadata")
    base = F.lit(folder.rstrip("/").split("://")[-1].split("/", 1)[-1] if "://" in folder else folder.strip("/"))
    path = F.regexp_replace(meta["file_path"], F.concat(F.lit(r"^.*?\Q"), base, F.lit(r"\E/")), F.lit(""))
    return rows.select(path.alias("path"), meta["file_name"].alias("name"), meta["file_size"].alias("size"), F.unix_millis(meta["file_modification_time"].cast("timestamp")).alias("modified_ms"), F.col("value").alias("content"))


def in_tree_order(files: DataFrame, by: str = "path") -> DataFrame:
    """files with file_order: of each folder its folders first, then its files, both by name in the order of the root collation.

    Names that the collation takes for equal are told apart by their bytes.
    """
    parts = F.split(by, "/")
    # a folder's name sorts before any file's beside it
    key = F.transform(parts, lambda x, i: F.struct((i == F.size(parts) - 1).alias("file"), F.collate(x, "UNICODE").alias("name"), x.alias("bytes")))
    return files.withColumn("file_order", key)


def mass_export(files: DataFrame) -> DataFrame:
    """(conversation_id, content): the conversations of files that hold {"conversations": [...]}, the last of each id."""
    items = F.from_json("content", "conversations array<variant>")["conversations"]
    rows = files.select("path", F.posexplode(items).alias("pos", "item"))
    key = F.try_variant_get("item", "$.conversation.id", "string")
    rows = rows.select("path", "pos", key.alias("conversation_id"), F.to_json("item").alias("content")).where("conversation_id is not null")
    return rows.groupBy("conversation_id").agg(F.max_by("content", F.struct("path", "pos")).alias("content"))


def mass_export_items(found: DataFrame, parts: int | None = None) -> DataFrame:
    """The same of json_items.pieces() or archive_pieces(), by many tasks for one file: the conversations of all files, the last of each id."""
    rows = items(found, parts).where("collection = 'conversations'").withColumn("conversation_id", F.get_json_object("json", "$.conversation.id")).where("conversation_id is not null")
    return rows.groupBy("conversation_id").agg(F.max_by("json", F.struct("path", "idx")).alias("content"))


def read_archives(spark: SparkSession, folder: str, member: str) -> DataFrame:
    """(path, content) of every member of that name, in any folder, of the zip archives below a folder, each as one row: for small members."""
    found = archive_pieces(spark, folder, member)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "text"))), lambda p: p["text"]), "}")
    return found.groupBy("path").agg(text.alias("content"))


# ---- the chat shape: a list of responses ----


def _texts(found: Column) -> Column:
    """Trimmed texts that aren't empty, each once, in order."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(found, F.expr(_NONE)), trim), lambda x: F.coalesce(x != "", F.lit(False))))


def chat_to_common(c: Column) -> Column:
    by = lambda who: F.get(F.reverse(F.filter(c["responses"], lambda r: F.lower(trim(r["response"]["sender"])) == who)), F.lit(0))["response"]
    human, assistant = by("human"), by("assistant")
    steps = F.flatten(F.transform(F.coalesce(assistant["steps"], F.expr("cast(array() as array<struct<tag_order:array<string>,tagged_text:map<string,string>>>)")), lambda s: F.coalesce(F.transform(s["tag_order"], lambda t: F.try_element_at(s["tagged_text"], t)), F.expr(_NONE))))
    traces = F.coalesce(F.transform(assistant["agent_thinking_traces"], lambda t: t["thinking_trace"]), F.expr(_NONE))
    ms = lambda t: assistant[t]["$date"]["$numberLong"].try_cast("double")
    gap = ms("thinking_end_time") - ms("thinking_start_time")
    name = F.coalesce(model_name(assistant["metadata"]["request_metadata"]["model"]), model_name(assistant["model"]))
    head = c["conversation"]
    return _row(
        head["id"], F.nullif(head["title"], F.lit("")), F.lit("Grok"), name, F.coalesce(trim(human["message"]), F.lit("")), F.coalesce(trim(assistant["message"]), F.lit("")),
        _texts(F.concat(traces, steps)), F.when(gap > 0, F.floor(gap / 1000 + 0.5)).cast("double"), head["create_time"], head["modify_time"],
    )


def _row(*values: Column) -> Column:
    return F.struct(*(v.alias(k) for k, v in zip(_OUT, values)))


# ---- the tree shape: messages that point to their parents ----


def _fact(m: Column) -> Column:
    """What is used of a message: role, text, fragments of reasoning, ts, times, model, and its stated duration."""
    body, meta = m["content"], m["metadata"]
    word = lambda k: F.try_variant_get(F.try_element_at(meta, F.lit(k)), "$", "string")
    is_text = lambda v: F.schema_of_variant(v) == "STRING"
    parts = F.transform(F.filter(body["parts"], is_text), lambda v: F.try_variant_get(v, "$", "string"))
    text = F.when(F.size(body["parts"]) > 0, trim(F.array_join(parts, "\n"))).otherwise(F.coalesce(trim(body["content"]), F.lit("")))
    recap = body["content_type"] == "reasoning_recap"
    said = lambda k: F.when(F.coalesce(is_text(F.try_element_at(meta, F.lit(k))), F.lit(False)), word(k))
    fragments = F.concat(
        F.coalesce(F.transform(body["thoughts"], lambda t: t["content"]), F.expr(_NONE)), F.when(recap, F.array(body["content"])).otherwise(F.expr(_NONE)),
        F.array(said("reasoning"), said("thinking_trace")),
    )
    stated = F.coalesce(
        F.try_variant_get(F.try_element_at(meta, F.lit("finished_duration_sec")), "$", "double"),
        F.when(recap, F.nullif(F.regexp_extract(body["content"], r"(?i)Thought for\s+(\d+)s", 1), F.lit("")).try_cast("double")),
    )
    name = F.coalesce(*(model_name(said(k)) for k in ("resolved_model_slug", "model_slug", "default_model_slug", "model")))
    return F.struct(
        m["author"]["role"].alias("role"), text.alias("text"), F.filter(F.transform(fragments, trim), lambda x: F.coalesce(x != "", F.lit(False))).alias("fragments"),
        F.coalesce(m["update_time"], m["create_time"], F.lit(0.0)).alias("ts"), F.filter(F.array(m["create_time"], m["update_time"]), lambda x: x.isNotNull()).alias("times"),
        name.alias("model"), stated.alias("stated"),
    )


def chain_places(nodes: Column, parents: Column, start: Column) -> Column:
    """The places in nodes from start up to the root; a cycle or an unknown node ends them.

    nodes and parents are columns with arrays of ids, start a column with one. Where each node's 1st, 2nd, 4th ... ancestor stands is worked out by doubling; the k-th
    ancestor of the start is reached through these by the bits of k.
    """
    n = F.size(nodes)
    bits = F.when(n > 1, F.sequence(F.lit(1), F.ceil(F.log2(n)).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
    doubled = lambda tables, _: let(F.get(tables, F.size(tables) - 1), lambda up: F.array_append(tables, F.transform(up, lambda p: F.get(up, p))))

    def walk(tables: Column, first: Column) -> Column:
        climb = lambda k: F.aggregate(F.sequence(F.lit(0), F.size(tables) - 1), first, lambda at, b: F.when(F.call_function("getbit", k, b) == 1, F.get(F.get(tables, b), at)).otherwise(at))
        met = F.filter(F.transform(F.sequence(F.lit(0), n - 1), climb), lambda p: p.isNotNull())
        # what is met again is on a cycle, and so is all behind it
        return let(met, lambda m: let(index(m), lambda seen: F.filter(m, lambda p, i: find(seen, p) == i)))

    def placed(ids: Column) -> Column:
        up = F.transform(parents, lambda p: find(ids, p))
        tables = F.aggregate(bits, F.array(up), doubled)
        return let(find(ids, start), lambda first: F.when(first.isNull(), F.expr("cast(array() as array<int>)")).otherwise(let(tables, lambda t: walk(t, first))))

    return F.when(n > 0, let(index(nodes), placed)).otherwise(F.expr("cast(array() as array<int>)"))


def _tree_steps(rows: DataFrame) -> DataFrame:
    """rows(tree) with common: one named step after another, each a column that the next reads."""
    tree = F.col("tree")
    nodes = F.transform(F.map_entries(tree["mapping"]), lambda e, i: F.struct(e["key"].alias("node"), i.alias("i"), e["value"]["parent"].alias("parent"), e["value"]["message"].isNotNull().alias("some"), _fact(e["value"]["message"]).alias("m")))
    rows = rows.withColumn("_nodes", nodes)
    assistants = F.filter("_nodes", lambda n: n["some"] & (n["m"]["role"] == "assistant"))
    newest = F.transform(F.array_sort(F.transform(assistants, lambda n: F.struct((-n["m"]["ts"]).alias("age"), n["i"].alias("i"), n["node"].alias("node"), n["m"]["fragments"].alias("f"), n["m"]["ts"].alias("ts")))), lambda x: x)
    rows = rows.withColumn("_newest", newest)
    current = F.exists("_nodes", lambda n: (n["node"] == tree["current_node"]) & n["some"])
    rows = rows.withColumn("_start", F.when(current, tree["current_node"]).otherwise(F.get("_newest", F.lit(0))["node"]))
    rows = rows.withColumns({"_ids": F.col("_nodes.node"), "_parents": F.col("_nodes.parent")})
    rows = rows.withColumn("_path", F.reverse(chain_places(F.col("_ids"), F.col("_parents"), F.col("_start"))))
    rows = rows.withColumn("_chain", F.transform(F.filter(F.transform("_path", lambda p: F.get("_nodes", p)), lambda n: n["some"]), lambda n: n["m"]))
    at = lambda cond: F.coalesce(F.array_max(F.transform("_chain", lambda m, i: F.when(cond(m, i), i))), F.lit(-1))
    rows = rows.withColumn("_last", at(lambda m, i: (m["role"] == "assistant") & ((m["text"] != "") | (F.size(m["fragments"]) > 0))))
    rows = rows.withColumn("_user", F.when(F.col("_last") >= 0, at(lambda m, i: (m["role"] == "user") & (i < F.col("_last")))).otherwise(-1))
    rows = rows.withColumn("_turn", F.when(F.col("_last") >= 0, F.filter(F.slice("_chain", F.col("_user") + 2, F.col("_last") - F.col("_user")), lambda m: m["role"] == "assistant")))
    prompt = F.coalesce(F.get("_chain", F.when(F.col("_user") >= 0, F.col("_user")).otherwise(at(lambda m, i: m["role"] == "user")))["text"], F.lit(""))
    response = F.coalesce(F.get(F.reverse(F.filter("_turn", lambda m: m["text"] != "")), F.lit(0))["text"], F.lit(""))
    own = F.array_distinct(F.flatten(F.transform("_turn", lambda m: m["fragments"])))
    since = F.when(F.col("_user") >= 0, F.get("_chain", F.col("_user"))["ts"])
    other = F.get(F.filter("_newest", lambda x: (F.size(x["f"]) > 0) & (since.isNull() | (x["ts"] >= since))), F.lit(0))["f"]
    reasoning = F.when(F.size(own) > 0, own).otherwise(F.coalesce(F.array_distinct(other), F.expr(_NONE)))
    said = F.get(F.reverse(F.filter("_chain", lambda m: (m["role"] == "assistant") & m["model"].isNotNull())), F.lit(0))["model"]
    rows = rows.withColumn("_model", F.coalesce(said, model_name(tree["default_model_slug"])))
    times = F.flatten(F.transform("_turn", lambda m: m["times"]))
    gap = F.array_max(times) - F.array_min(times)
    stated = F.get(F.reverse(F.filter("_turn", lambda m: m["stated"].isNotNull())), F.lit(0))["stated"]
    seconds = F.when(is_openai(F.col("_model")), stated).otherwise(F.when(gap > 0, F.floor(gap + 0.5).cast("double")))
    return rows.withColumn("common", _row(
        F.nullif(tree["conversation_id"], F.lit("")), F.nullif(tree["title"], F.lit("")), provider(F.col("_model")), F.col("_model"), prompt, response, reasoning, seconds,
        iso_text(tree["create_time"]), iso_text(tree["update_time"]),
    )).drop("_nodes", "_newest", "_start", "_ids", "_parents", "_path", "_chain", "_last", "_user", "_turn", "_model")


def _is_tree(v: Column, root: str) -> Column:
    """Whether the JSON at a path has the tree shape, by the types of its members."""
    kind = lambda k: F.schema_of_variant(F.try_variant_get(v, f"{root}.{k}", "variant"))
    has = lambda k, *names: F.coalesce(F.regexp_extract(kind(k), "^[A-Z]+", 0).isin(*names), F.lit(False))
    number = ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL")
    checks = [has(k, "STRING") for k in ("title", "conversation_id", "current_node", "default_model_slug")]
    checks += [has(k, *number) for k in ("create_time", "update_time")]
    checks += [has("mapping", "OBJECT"), has("plugin_ids", "ARRAY", "VOID")] + [has(k, "ARRAY") for k in ("moderation_results", "safe_urls", "blocked_urls")]
    out = checks[0]
    for check in checks[1:]:
        out = out & check
    return out


def to_common(files: DataFrame, edits_key: str = "__edits", capture_key: str = "__capture") -> DataFrame:
    """files(path, content, ...) as conversations; the keys are the names under which files carry their edits and their capture's metadata.

    The chat shape is tried first, then the tree, the tree in a wrapper, and the common shape itself.
    """
    rows = files.withColumn("_v", F.try_parse_json("content"))
    v = F.col("_v")
    text = lambda path: F.try_variant_get(v, path, "string")
    some = lambda path: F.try_variant_get(v, path, "variant").isNotNull()
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit(""))
    chat = kind("$.conversation.id").eqNullSafe("STRING") & kind("$.responses").startswith("ARRAY")
    place = (
        F.when(_is_tree(v, "$"), "$").when((text("$.format") == "original") & _is_tree(v, "$.data"), "$.data").when(_is_tree(v, "$.payload"), "$.payload").when(_is_tree(v, "$.data.payload"), "$.data.payload")
    )
    rows = rows.withColumns({"_chat": chat, "_place": place})
    shape = (
        F.when(v.isNull(), "unreadable").when(F.col("_chat"), "chat").when(F.col("_place") == "$", "tree").when(F.col("_place").isNotNull(), "wrapper").when(text("$.format") == "common", "common").otherwise("unknown")
    )
    rows = rows.withColumn("shape", shape)
    sub = F.when(F.col("_place") == "$", F.col("content"))
    for path in ("$.data", "$.payload", "$.data.payload"):
        sub = F.when(F.col("_place") == path, F.to_json(F.try_variant_get(v, path, "variant"))).otherwise(sub)
    json_at = lambda key: F.coalesce(*(F.when(kind(f"{p}.{key}").startswith("OBJECT"), F.to_json(F.try_variant_get(v, f"{p}.{key}", "variant"))) for p in ("$", "$.data")))
    rows = rows.withColumns({"edits": json_at(edits_key), "capture": json_at(capture_key), "_sub": sub}).drop("_v", "_chat", "_place")

    # one pass: what isn't of a shape is null to that shape's reader
    tree = F.col("shape").isin("tree", "wrapper")
    rows = _tree_steps(rows.withColumn("tree", F.when(tree, F.from_json("_sub", TREE))))
    plain = F.when(F.col("shape") == "common", F.from_json("content", COMMON))
    flat = _row(*(plain[k] for k in ("conversation_id", "title", "llm", "model", "prompt", "response", "reasoning", "reasoning_duration_sec", "created_at", "updated_at")))
    rows = rows.withColumn("_chat", F.when(F.col("shape") == "chat", F.from_json("content", CHAT)))
    rows = rows.withColumn("common", F.when(tree, F.col("common")).when(F.col("shape") == "chat", chat_to_common(F.col("_chat"))).when(F.col("shape") == "common", flat))
    why = (
        F.when(F.col("shape") == "unreadable", "not JSON").when(F.col("shape") == "unknown", "Input does not match a supported translation JSON shape.")
        .when(tree & F.col("common.model").isNull(), "Could not detect model")
    )
    return rows.select(*files.columns, "shape", "edits", "capture", why.alias("error"), *(F.col(f"common.{k}").alias(k) for k in _OUT))
