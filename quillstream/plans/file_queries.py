"""Queries over corpus files, exports, prompts, saved and packed corpora, filters, reports, and what users plug in, made of the driver's tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus, files, patches, playback
from ..operators.rules import error_rows, register_udtf, validate
from ..sources import conversations, corpus_files
from ..sources.json_items import pieces
from . import incremental
from .queries import _BUCKET, _CORPUS, _FILES, _PLAY, _RESPONSES, ORACLES, _table, candidates_view, corpus_view, files_view, query, responses_view, targets_view
from .tables import materialize, shared_folder, write_text
from .workspace import assist

#: Places of a collection that go into one corpus file.
_PLACES = 20_000


def _corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, value): corpus files, each one JSON object of a range of places, with braces and quotes in its texts."""
    s = corpus_view(spark, sf_dir)
    nass = F.concat("nass", F.lit(' {"'), "id", F.lit('"} \\ ]'))
    alt = F.when(F.col("alt_count") > 0, F.transform(F.sequence(F.lit(1), F.col("alt_count")), lambda i: F.struct(i.cast("string").alias("text"))))
    item = F.struct("id", nass.alias("nass"), "text", "translator", F.col("last_updated_at").alias("lastUpdatedAt"), F.struct(alt.alias("alt"), F.when(F.col("patch_type").isNotNull(), F.struct(F.col("patch_type").alias("type"))).alias("patched")).alias("meta"))
    k = F.floor(F.col("idx") / _PLACES)
    rows = s.groupBy(k.alias("k")).agg(
        F.max("idx").alias("most"), *(F.transform(F.array_sort(F.collect_list(F.when(F.col("collection") == c, F.struct("idx", item.alias("item"))))), lambda x: x["item"]).alias(c) for c in corpus.COLLECTIONS)
    )
    whole = F.struct((F.col("k") * 10).alias("createdAt"), "excerpts", F.format_string("%d} {", "k").alias("promptForTranslation"), "headings", F.concat(F.lit("A"), F.col("k").cast("string")).alias("promptId"), "footnotes", F.col("most").alias("lastUpdatedAt"))
    return rows.select("k", F.to_json(whole).alias("value"))


def _written(rows: DataFrame) -> str:
    folder = shared_folder(rows.sparkSession)
    rows.write.partitionBy("k").text(folder)
    return folder


@query(f"""WITH {_CORPUS} SELECT collection, id, nass || ' {{"' || id || '"}} \\ ]' AS nass, text, translator, coalesce(ts, -1) AS last_updated_at, alt_count, patch_type FROM corpus""")
def corpus_file_segments(spark, sf_dir):
    found = corpus_files.segments_of_pieces(pieces(spark, _written(_corpus_files(spark, sf_dir)), "*.txt"))
    return found.select("collection", "id", "nass", "text", "translator", F.coalesce("last_updated_at", F.lit(-1)).alias("last_updated_at"), "alt_count", "patch_type")


@query(f"""WITH {_CORPUS} SELECT (idx // {_PLACES} * 10)::BIGINT AS created_at, max(idx)::BIGINT AS last_updated_at, (idx // {_PLACES}) || '}} {{' AS prompt, 'A' || (idx // {_PLACES}) AS prompt_id FROM corpus GROUP BY idx // {_PLACES}""")
def corpus_file_meta(spark, sf_dir):
    return corpus_files.read_meta(spark, _written(_corpus_files(spark, sf_dir)), glob="*.txt")


@query(f"WITH {_CORPUS} SELECT collection, count(*) AS total, count(*) FILTER (coalesce(length(text), 0) > 0) AS translated, count(*) FILTER (coalesce(length(text), 0) = 0) AS untranslated FROM corpus GROUP BY collection")
def corpus_files_incremental(spark, sf_dir):
    """The first file's facts are kept, and those of the others added when they come."""
    rows = materialize(_corpus_files(spark, sf_dir))
    folder, table = _written(rows.where("k = 0")), shared_folder(spark)
    incremental.kept_facts(spark, folder, table, "*.txt")
    rows.where("k > 0").write.mode("append").partitionBy("k").text(folder)
    return corpus.counts(incremental.merged(incremental.kept_facts(spark, folder, table, "*.txt")))


@query("SELECT 'c' || (conv_id // 2) AS conversation_id, max(conv_id) AS last FROM conversations GROUP BY 1")
def mass_export_files(spark, sf_dir):
    """Export files of many conversations, in which every id comes twice: the last stays."""
    item = F.struct(F.struct(F.concat(F.lit("c"), F.floor(F.col("conv_id") / 2).cast("string")).alias("id"), F.lit('} "').alias("title")).alias("conversation"), F.col("conv_id").alias("last"))
    rows = _table(spark, sf_dir, "conversations").select("conv_id").distinct().groupBy(F.format_string("%09d", F.floor(F.col("conv_id") / 10)).alias("k"))
    rows = rows.agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("conv_id", item.alias("item")))), lambda x: x["item"]).alias("conversations"))).alias("value"))
    found = conversations.mass_export_items(pieces(spark, _written(rows), "*.txt"))
    return found.select("conversation_id", F.get_json_object("content", "$.last").cast("long").alias("last"))


@query("""SELECT replace(n_name, ' ', '_') AS id, array_to_string(list_transform(string_split(replace(lower(n_name), '_', ' '), ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS name, n_nationkey = 3 AS is_chosen,
  'Translate.' || chr(10) || 'As in ' || n_name || ', ' || n_regionkey || '.' AS prompt FROM nation""")
def prompt_library(spark, sf_dir):
    """A prompt file for each nation, beside the master; the one that was saved is chosen by its content."""
    folder = shared_folder(spark)
    write_text(spark, f"{folder}/master.md", " Translate.\n")
    for r in _table(spark, sf_dir, "nation").collect():  # a library of prompts is read by a person
        write_text(spark, f"{folder}/{r['n_name'].lower().replace('_', '-')}.md", f" As in {r['n_name']}, {r['n_regionkey']}.\n")
    found = materialize(corpus_files.read_prompts(spark, folder))
    saved = _table(spark, sf_dir, "nation").where("n_nationkey = 3").select(F.concat(F.lit(" As in "), "n_name", F.lit(", "), F.col("n_regionkey").cast("string"), F.lit(".\n"))).first()[0]
    chosen = corpus_files.select_prompt(found, "NONE", saved).select(F.col("id").alias("chosen"))
    master = found.where("is_master").select(F.col("content").alias("master"))
    rows = found.where("not is_master").join(F.broadcast(chosen)).join(F.broadcast(master))  # one row each
    return rows.select("id", "name", (F.col("id") == F.col("chosen")).alias("is_chosen"), corpus_files.compose_prompt(F.col("master"), F.col("content")).alias("prompt"))


@query(ORACLES["playback_merge"])
def playback_saved(spark, sf_dir):
    """The merged corpus, written as a new version and read again."""
    targets = targets_view(spark, sf_dir)
    merged = playback.merge(targets, playback.classify(candidates_view(spark, sf_dir), targets))
    path = playback.save(merged, shared_folder(spark), "corpus", "2026-01-02T03:04:05Z")
    return spark.read.parquet(path).select("id", "idx", "translator", "last_updated_at", F.size("alt").alias("alts"))


@query(f"""{_PLAY} SELECT id, nth - 1 AS position, path, translator, ts AS last_updated_at FROM ranked WHERE nth > 1""")
def playback_alternatives(spark, sf_dir):
    found = playback.alternatives(playback.classify(candidates_view(spark, sf_dir), targets_view(spark, sf_dir)))
    return found.select("id", F.col("position").cast("long").alias("position"), "path", "translator", "last_updated_at")


_STATS = "count(*) FILTER (coalesce(length(text), 0) > 0)"


@query(f"""{_PLAY}, first AS (SELECT id, translator FROM ranked WHERE nth = 1),
c AS (SELECT count(*) AS candidates, count(*) FILTER (state = 'playable') AS applied, count(*) FILTER (state = 'unknown') AS unknown, count(*) FILTER (state = 'already_translated') AS already, count(*) FILTER (nth = 2) AS duplicate_ids FROM ranked),
b AS (SELECT {_STATS} AS before, count(DISTINCT translator) AS translators_before FROM targets),
a AS (SELECT count(*) FILTER (f.id IS NOT NULL OR coalesce(length(text), 0) > 0) AS after, count(DISTINCT coalesce(f.translator, t.translator)) AS translators_after FROM targets t LEFT JOIN first f USING (id)),
v AS (SELECT count(*) FILTER (c_acctbal >= 0) AS valid_files, count(*) FILTER (c_acctbal < 0) AS invalid_files FROM customer)
SELECT valid_files, invalid_files, candidates, applied, unknown, already, duplicate_ids, false AS blocked, before, after, translators_before, translators_after FROM v, c, b, a""")
def playback_report(spark, sf_dir):
    targets = targets_view(spark, sf_dir)
    found = playback.report(targets, playback.classify(candidates_view(spark, sf_dir), targets), files_view(spark, sf_dir))
    side = lambda c: (F.col(f"stats_{c}.translated_segments").alias(c), F.col(f"stats_{c}.unique_translators").alias(f"translators_{c}"))
    return found.select("valid_files", "invalid_files", "candidates", "applied", "unknown", F.col("already_translated").alias("already"), "duplicate_ids", "blocked", *side("before"), *side("after"))


@query(f"WITH {_CORPUS} SELECT collection, count(*) AS segments, sum(length(text))::BIGINT AS chars, min(id) AS first FROM corpus WHERE text IS NOT NULL GROUP BY collection")
def corpus_packed(spark, sf_dir):
    path = shared_folder(spark)
    playback.pack(corpus_view(spark, sf_dir).where("text is not null"), path)
    return spark.read.parquet(path).groupBy("collection").agg(F.count(F.lit(1)).alias("segments"), F.sum(F.length("text")).alias("chars"), F.min("id").alias("first"))


#: What a user asks for, and what was saved before.
_ASKED = (({"model": " grok-4 ", "status": "odd"}, None), ({"status": "valid"}, {"thinking_time": "10_to_30s"}), ({"model": "all", "status": " ", "thinking_time": "never"}, {"status": "invalid", "model": "gpt-5-4-pro"}))


@query(f"WITH {_FILES} SELECT 0 AS asked, path FROM files WHERE model = 'grok-4' UNION ALL SELECT 1, path FROM files WHERE is_valid AND {_BUCKET} = '10_to_30s' UNION ALL SELECT 2, path FROM files WHERE true")
def file_filters(spark, sf_dir):
    found = [files.matching(files_view(spark, sf_dir), **files.filters(given, saved)).select(F.lit(k).alias("asked"), "path") for k, (given, saved) in enumerate(_ASKED)]
    return found[0].union(found[1]).union(found[2])


@query("""WITH o AS (SELECT doc_id, text, doc_id % 3 AS kind, doc_id % 5 AS a, doc_id % 3 AS gone, doc_id % 4 AS n, 10 + doc_id % 7 AS b FROM documents WHERE text IS NOT NULL),
m AS (SELECT *, n > 0 AND length(text) >= b + 2 AND regexp_matches(substr(text, a + gone + 1, b - a - gone), '^[ \t]+$') AS joined FROM o)
SELECT doc_id, CASE kind WHEN 0 THEN '1-3 a title' WHEN 1 THEN '2-' || (doc_id % 9 + 2) ELSE CASE WHEN joined THEN a || '-' || (b + n - gone + 1) ELSE CASE WHEN n > 0 THEN a || '-' || (a + n) || ',' ELSE '' END || (b + n - gone) || '-' || (b + n - gone + 1) END END AS shown FROM m""")
def highlights_shown(spark, sf_dir):
    """Titled highlights in every third document, ranges in others, and what the patch changed in the rest."""
    rows = _table(spark, sf_dir, "documents").where("text is not null").withColumn("kind", F.col("doc_id") % 3)
    ops = F.expr("array(named_struct('start', int(10 + doc_id % 7), 'end', int(12 + doc_id % 7), 'text', 'Z'), named_struct('start', int(doc_id % 5), 'end', int(doc_id % 5 + doc_id % 3), 'text', repeat('x', int(doc_id % 4))))")
    titled = F.when(F.col("kind") == 0, F.expr("array(named_struct('start', 1, 'end', 3, 'title', 'a title'))"))
    ranges = F.when(F.col("kind") == 1, F.expr("array(named_struct('start', 2, 'end', int(doc_id % 9 + 2)))"))
    rows = rows.withColumn("patched", F.coalesce(patches.apply_patch(F.col("text"), ops), F.lit("")))
    shown = patches.display_highlights(F.col("patched"), ops, titled, ranges)
    return rows.select("doc_id", F.array_join(F.transform(shown, lambda h: F.concat(h["start"].cast("string"), F.lit("-"), h["end"].cast("string"), F.coalesce(F.concat(F.lit(" "), h["title"]), F.lit("")))), ",").alias("shown"))


@query("""WITH m AS (SELECT doc_id, doc_id % 6 AS p, doc_id % 3 AS t, length(text) % 50 - 2 AS a, doc_id % 4 - 1 AS more, doc_id % 5 = 0 AS odd FROM documents WHERE text IS NOT NULL)
SELECT doc_id, p < 5 AND t < 2 AND a >= 0 AND more >= 0 AND NOT odd AS valid FROM m""")
def metadata_checked(spark, sf_dir):
    """Metadata of a patch for every document: unknown providers and tasks, ranges out of order, and titles that are numbers."""
    rows = _table(spark, sf_dir, "documents").where("text is not null")
    provider = F.get(F.array(*map(F.lit, (*patches.PROVIDERS, "another"))), (F.col("doc_id") % 6).cast("int"))
    task = F.get(F.array(*map(F.lit, (*patches.TASKS, "another"))), (F.col("doc_id") % 3).cast("int"))
    start = F.length("text") % 50 - 2
    span = F.struct(start.alias("start"), (start + F.col("doc_id") % 4 - 1).alias("end"))
    title = F.when(F.col("doc_id") % 5 == 0, "5").otherwise('"a title"')
    source = F.to_json(F.struct(F.lit("llm").alias("kind"), F.lit("m").alias("model"), provider.alias("provider"), task.alias("task")))
    value = F.concat(F.lit('{"appliedAt": "2026-01-01", "highlights": [{"range": '), F.to_json(span), F.lit(', "title": '), title, F.lit('}], "source": '), source, F.lit("}"))
    return rows.select("doc_id", patches.metadata_is_valid(F.parse_json(value)).alias("valid"))


class _LongWords:
    """A rule of a user's own: runs of 15 ASCII letters or more."""

    def eval(self, normalized, segments, source):
        for s in segments:
            for m in re.finditer("[A-Za-z]{15,}", s["text"]):
                yield "long_word", f'"{m[0]}" is long', m[0], s["start"] + m.start(), s["start"] + m.end(), s["id"], m.start(), m.end()


@query(f"""WITH {_RESPONSES}, w AS (SELECT doc_id, id, unnest(regexp_extract_all(text, '[A-Za-z]{{15,}}')) AS match FROM seg)
SELECT doc_id, 'long_words' AS rule, id, match, count(*) AS n FROM w GROUP BY ALL UNION ALL SELECT doc_id, 'truncated_segment', id2, t2, 1 FROM resp WHERE k IN (4, 5)""")
def user_rule_errors(spark, sf_dir):
    """A table function's errors beside those of a built-in rule."""
    rule = register_udtf(spark, "long_words", _LongWords)
    found = error_rows(validate(responses_view(spark, sf_dir), rules=["truncated_segment"]), ["doc_id"], user_rules={"long_words": rule})
    return found.groupBy("doc_id", "rule", "id", "match").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT 'f' || (doc_id % 50) AS path, 'P' || doc_id AS id, text, (row_number() OVER (PARTITION BY doc_id % 50 ORDER BY 'P' || doc_id) - 1) // 5 AS request FROM documents WHERE text IS NOT NULL),
s AS (SELECT *, count(*) OVER (PARTITION BY path, request) AS size FROM r) SELECT path, id, size || ' asked' AS replacement FROM s WHERE contains(text, 'e')""")
def corrections_asked(spark, sf_dir):
    """A provider that is asked for five excerpts of a file at a time, and tells how many it was given."""
    rows = _table(spark, sf_dir, "documents").where("text is not null")
    rows = rows.select(F.concat(F.lit("f"), (F.col("doc_id") % 50).cast("string")).alias("path"), F.concat(F.lit("P"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("translation"))
    return assist(rows, lambda part: [{"id": r["id"], "match": "e", "replacement": f"{len(part)} asked"} for r in part if "e" in r["translation"]]).select("path", "id", "replacement")
