"""The calls that users make, over a corpus table and a folder of conversation files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import trim
from ..functions.values import Estimator, estimate_tokens
from ..operators import corpus, corrections, files, packing, patches, playback
from ..operators.rules import Config
from ..sources import conversations, corpus_files
from ..functions.text import normalize, segments
from ..streaming import ingest
from . import edits, validity
from .tables import delete, materialize, read_version, snapshot, write_version


@dataclass
class Workspace:
    """spark, the Parquet table of segments, the folder of conversation files, and the keys of their own edits and metadata.

    What users write goes to tables below state_path: edits and the prompt in versions, and snapshots of statistics.
    """

    spark: SparkSession
    segments_path: str
    conversations_path: str | None = None
    edits_key: str = "__edits"
    capture_key: str = "__capture"
    config: Config = field(default_factory=Config)
    estimate: Estimator = estimate_tokens
    state_path: str | None = None
    _analyses: DataFrame | None = None

    @classmethod
    def from_corpus_file(cls, spark: SparkSession, json_path: str, segments_path: str, **more: object) -> Workspace:
        """Convert a corpus file, or all below a folder, once."""
        rows = corpus_files.read_segments(spark, json_path)
        rows.write.partitionBy("collection").parquet(segments_path)
        return cls(spark, segments_path, **more)

    # ---- the corpus ----

    @property
    def segments(self) -> DataFrame:
        return self.spark.read.parquet(self.segments_path)

    def stats(self, created_at: int | None = None, last_updated_at: int | None = None) -> DataFrame:
        return corpus.stats(self.segments, created_at, last_updated_at)

    def stats_snapshot(self, created_at: int | None = None, last_updated_at: int | None = None) -> DataFrame:
        """stats(), kept until the table of segments is written anew."""
        return snapshot(self.spark, f"{self.state_path}/stats", self.segments_path, lambda: self.stats(created_at, last_updated_at))

    def prompt(self) -> DataFrame | None:
        """(created_at, last_updated_at, prompt, prompt_id) as set last."""
        return read_version(self.spark, f"{self.state_path}/prompt")

    def set_prompt(self, prompts: DataFrame, prompt_id: str, now: int) -> None:
        """Keep one of read_prompts() as the prompt; an unknown id is an error."""
        chosen = prompts.where(F.col("id") == prompt_id).select("content").first()
        if chosen is None:
            raise ValueError(f"no prompt {prompt_id}")
        old = self.prompt()
        old = self.spark.createDataFrame([(None, None, None, None)], "created_at long, last_updated_at long, prompt string, prompt_id string") if old is None else old
        write_version(corpus_files.with_prompt(old, prompt_id, chosen["content"], now), f"{self.state_path}/prompt")

    def facts(self) -> DataFrame:
        """What all statistics read of the corpus, counted: kept until the table of segments is written anew, where there is a state_path."""
        if not self.state_path:
            return corpus.facts(self.segments)
        return snapshot(self.spark, f"{self.state_path}/facts", self.segments_path, lambda: corpus.facts(self.segments))

    def analytics(self) -> dict[str, DataFrame]:
        """The corpus' analytics, of its facts: a snapshot where there is a state_path."""
        s = self.facts()
        return {"timeline": corpus.timeline(s), "translators": corpus.translator_shares(s), "alternatives": corpus.alternatives(s), "patch_types": corpus.patch_types(s), "counts": corpus.counts(s)}

    def untranslated(self, page: int = 1, size: int = packing.PAGE_SIZE) -> DataFrame:
        return packing.page(corpus.untranslated(self.segments), page, size)

    def picker(self, max_ids: int = packing.MAX_IDS, base_tokens: int = 0) -> DataFrame:
        return packing.token_groups(corpus.untranslated(self.segments), base_tokens, self.estimate).where(F.col("position") <= min(max_ids, packing.MAX_MAX_IDS))

    def payload(self, prompt: str = "", max_tokens: int = packing.PAYLOAD_TOKENS, max_items: int = packing.PAYLOAD_ITEMS) -> DataFrame:
        return packing.payload(corpus.untranslated(self.segments), max_tokens, prompt, max_items, self.estimate)

    def shift(self, prompt: str = "", max_tokens: int = packing.PAYLOAD_TOKENS, shifted: DataFrame | None = None) -> DataFrame:
        """The next batch after what was shifted; see streaming.files.shift_in_batches for the checkpoint."""
        return packing.shift(packing.resume(corpus.untranslated(self.segments), shifted), max_tokens, prompt, self.estimate)

    def pack(self, path: str) -> None:
        playback.pack(self.segments, path)

    # ---- conversation files ----

    def read(self) -> DataFrame:
        """The conversations, with the edits that were saved last in place of the files' own."""
        raw = conversations.read_files(self.spark, self.conversations_path)
        rows = conversations.to_common(raw, self.edits_key, self.capture_key)
        saved = read_version(self.spark, f"{self.state_path}/edits") if self.state_path else None
        if saved is None:
            return rows
        saved = saved.select("path", F.struct(F.col("edits").alias("saved")).alias("new"))
        edited = F.when(F.col("new").isNotNull(), F.col("new.saved")).otherwise(F.col("edits"))
        return rows.join(saved, "path", "left").select(*(edited.alias(c) if c == "edits" else c for c in rows.columns))

    def save_edits(self, changes: DataFrame) -> None:
        """Write patches and skips, changes(path, id, ops, metadata, skip), as edits.apply_changes() has them; files without changes keep theirs."""
        known = F.transform(segments(normalize(F.coalesce("prompt", F.lit("")))), lambda s: s["id"])
        rows = self.read().select("path", "edits", known.alias("known"))
        old = read_version(self.spark, f"{self.state_path}/edits")
        paths = changes.select("path") if old is None else changes.select("path").union(old.select("path"))
        rows = materialize(rows.join(paths.distinct(), "path", "left_semi"))
        write_version(edits.apply_changes(rows, changes).select("path", "edits"), f"{self.state_path}/edits")
        self.refresh()

    def delete(self, paths: list[str]) -> int:
        """Delete conversation files; how many there were. Paths that leave the folder are an error before anything is deleted."""
        if bad := [p for p in paths if not files.is_safe(p)]:
            raise ValueError(f"Invalid file path: {bad[0]}")
        gone = sum(delete(self.spark, f"{self.conversations_path.rstrip('/')}/{p}") for p in paths)
        self.refresh()
        return gone

    def ingest(self, events: DataFrame) -> DataFrame:
        """The outcomes of a table of keyed writes; see streaming.ingest."""
        return ingest.ingest_batch(events)

    @property
    def analyses(self) -> DataFrame:
        """The analysis of every file, made once; refresh() forgets it."""
        if self._analyses is None:
            self._analyses = materialize(validity.analyse(materialize(self.read()), self.config))
        return self._analyses

    def refresh(self) -> None:
        self._analyses = None

    def dashboard(self) -> dict[str, DataFrame]:
        rows = validity.file_rows(self.analyses)
        return {"files": files.stats(rows), "models": files.by_model(rows), "thinking_times": files.thinking_times(rows), "corpus": self.stats()}

    def tree(self, model: str = "all", status: str = "all", thinking_time: str = "all") -> DataFrame:
        return files.tree(files.matching(validity.file_rows(self.analyses), model, status, thinking_time))

    def invalid(self) -> DataFrame:
        return validity.invalid_excerpts(self.analyses)

    def validate_all(self) -> DataFrame:
        return self.analyses.select("path", "is_valid", "error", F.size("visible_errors").alias("errors"))

    def review(self, path: str) -> DataFrame:
        return validity.review_rows(self.analyses.where(F.col("path") == path))

    def simulate_playback(self) -> dict[str, DataFrame]:
        found = materialize(playback.classify(validity.candidates(self.analyses), self.segments))
        report = playback.report(self.segments, found, validity.file_rows(self.analyses))
        return {"report": report, "counters": playback.counters(found), "issues": playback.issues(found), "merged": playback.merge(self.segments, found), "duplicates": corpus.duplicate_targets(self.segments)}

    def save_playback(self, folder: str, name: str, stamp: str) -> str:
        """Write the merged corpus as a new version; a corpus with repeated ids is refused."""
        done = self.simulate_playback()
        if not done["duplicates"].isEmpty():
            raise ValueError("the corpus has repeated ids")
        return playback.save(done["merged"], folder, name, stamp)

    def corrected(self, suggested: DataFrame, kind: str = "arabic_leak") -> DataFrame:
        """Invalid rows with their suggested corrections (path, pos, id, match, replacement) applied: fixed.text, issues, highlights and the patch."""
        rows = corrections.attach(validity.fixable(self.invalid(), kind), suggested).where(F.size("corrections") > 0)
        fix, hints = (corrections.fix_arabic_leaks, "leak_hints") if kind == "arabic_leak" else (corrections.fix_all_caps, "caps_hints")
        rows = materialize(rows.withColumn("fixed", fix(F.col("translation"), F.col("corrections"), F.col(hints), F.col("id"))))
        return rows.withColumn("patch", patches.create_patch("base_translation", F.col("fixed.text")))


def assist(rows: DataFrame, ask: Callable[[list[dict]], list[dict]], size: int = 5) -> DataFrame:
    """Corrections from a provider: ask() gets requests of up to size rows (path, id, translation), in order of path and id and all of one file, and gives
    (id, match, replacement). No provider is built in. Replies to ids that the request hasn't are left out; ids that stand twice in a file are an error.
    """
    import pandas as pd

    made = "path string, pos long, id string, match string, replacement string"

    def call(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id", kind="stable")
        if part["id"].duplicated().any():
            raise ValueError(f"{part['path'].iloc[0]} has an id twice in a request")
        known = set(part["id"])
        replies = [c for c in ask(part[["path", "id", "translation"]].to_dict("records")) if c["id"] in known]
        return pd.DataFrame([(part["path"].iloc[0], n, c["id"], c["match"], c["replacement"]) for n, c in enumerate(replies)], columns=["path", "pos", "id", "match", "replacement"])

    numbered = packing.ranks(rows.select("path", "id", "translation"), ["path"], ["id", "translation"], "_n").withColumn("_request", F.floor((F.col("_n") - 1) / size))
    return numbered.groupBy("path", "_request").applyInPandas(lambda part: call(part), made)


def composed_prompt(master: Column, addon: Column) -> Column:
    return F.when(trim(addon) == "", trim(master)).otherwise(corpus_files.compose_prompt(master, addon))
