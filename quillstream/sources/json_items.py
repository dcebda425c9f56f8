"""Large JSON objects whose top-level arrays hold the rows, read by many tasks.

Spark's text reader cuts a file at every closing brace, in splits like any text, from any store that Spark reads. Each split is read where it lies, in order:
whether it begins inside a string and how deep follows from the quotes and brackets of the splits before it, which pass the driver as one row for
each split of a file that has several; so do what array is open where a split begins, and how many items it has had. So one file of any size is as many
tasks as it has splits, and no text is shuffled but the items that lie across the border of two splits.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from itertools import groupby, pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import materialize

_STRING = r'"(?:[^"\\]++|\\.)*+"'
_FLAT = rf'\[(?:[^\[\]{{}}"]++|{_STRING})*+\]'
#: A plain member: a name, and a string, a number, a word or an array of these, at most two arrays deep.
_PAIR = rf'{_STRING}\s*+:\s*+(?:{_STRING}|\[(?:[^\[\]{{}}"]++|{_STRING}|{_FLAT})*+\]|[^\s,\[\]{{}}"]++)'
#: What stands between two top-level arrays: the end of one, plain members, and the name of the next array or object with its bracket.
_HEAD = re.compile(rf'(?s)^\s*+[\]{{]?\s*+,?\s*+((?:{_PAIR})(?:\s*+,\s*+{_PAIR})*+)?+\s*+,?\s*+(?:("(?:[^"\\]++|\\.)*+")\s*+:\s*+([\[{{]))?+'.encode())
_SPACE = b" \t\n\x0b\f\r"
#: Bytes of a zip member that are unpacked at once.
_BLOCK = 1 << 20


def pieces(spark: SparkSession, path: str | list[str], glob: str = "*.json") -> DataFrame:
    """(path, start, row, text, size): the files at a path, or below it, cut after each }, which is left out; start and row are in order, size is the file's."""
    rows = spark.read.option("lineSep", "}").option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    meta = F.col("_metadata")
    return rows.select(meta["file_path"].alias("path"), meta["file_block_start"].alias("start"), F.monotonically_increasing_id().alias("row"), F.col("value").alias("text"), meta["file_size"].alias("size"))


def archive_pieces(spark: SparkSession, folder: str, member: str) -> DataFrame:
    """The same of every member of that name, in any folder, of the zip archives below a folder. Members are unpacked block by block and
    never whole in memory; an archive is, as it is packed (Spark reads up to 2 GB of a binary file)."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with zipfile.ZipFile(io.BytesIO(data)) as archive:
                    for name in archive.namelist():
                        if name.rsplit("/", 1)[-1] == member:
                            yield from blocks(f"{path}!{name}", archive.open(name))

    def blocks(path: str, file) -> Iterator[pa.RecordBatch]:
        number, rest = 0, b""
        while True:
            block = file.read(_BLOCK)
            *whole, rest = (rest + block).split(b"}")
            whole = whole if block else [*whole, rest]
            texts = [x.decode("utf-8", "replace") for x in whole]
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(texts), pa.string()), pa.array([0] * len(texts), pa.int64()), pa.array(list(range(number, number + len(texts))), pa.int64()), pa.array(texts, pa.string())], names=["path", "start", "row", "text"])
            number += len(texts)
            if not block:
                return

    archives = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(folder)
    return archives.select("path", "content").mapInArrow(unpack, "path string, start long, row long, text string").withColumn("size", F.lit(None).cast("long"))


class _State(NamedTuple):
    """How a split begins, whether its file's last piece, if it is there, has no brace behind it, and the section that its first whole item is in."""

    quoted: int
    depth: int
    open: bool
    section: tuple[str | None, bool, int] = (None, False, 0)


#: By path and start, or border: of all splits of files that have several.
_States = dict[tuple[str, int], _State]
_STEP = np.zeros(256, np.int64)
_STEP[[ord("["), ord("{")]], _STEP[[ord("]"), ord("}")]] = 1, -1
_EVENT = _STEP != 0
_EVENT[ord('"')] = True


class _Scan:
    """The brackets of a text outside of strings: their places, bytes, and the depth behind each."""

    def __init__(self, data: bytes, quoted: int, depth: int):
        text = np.frombuffer(data, np.uint8)
        at = np.flatnonzero(_EVENT[text])
        quote = text[at] == ord('"')
        if b"\\" in data:
            slashes = np.flatnonzero(text == ord("\\"))
            begins = np.flatnonzero(np.diff(slashes, prepend=-2) != 1)
            ends = np.append(begins[1:], len(slashes)) - 1
            odd = (ends - begins) % 2 == 0
            quote &= ~np.isin(at, slashes[ends[odd]] + 1)  # a quote behind a run of odd length is escaped
        inside = (np.cumsum(quote) + quoted) & 1
        step = _STEP[text[at]]
        self.other_way = int(step[inside == 1].sum())  # how much deeper the text leads if it begins the other way
        bracket = (inside == 0) & (step != 0)
        self.at, self.kind = at[bracket], text[at[bracket]]
        self.level = depth + np.cumsum(step[bracket])
        self.quoted = int(inside[-1]) if len(at) else quoted
        self.depth = int(self.level[-1]) if len(self.level) else depth
        self.braces = self.kind == ord("}")


class _Reader:
    """Reads a text from the start of a file, or from behind an item, or (not started) from anywhere: then up to the first item's end nothing is known."""

    def __init__(self, depth: int, quoted: int = 0, started: bool = True, section: tuple[str | None, bool, int] = (None, False, 0)):
        self.depth, self.quoted, self.started, self.base, self.section = depth, quoted, started, depth, section
        self.rest: list[bytes] = []  # since the last item's end
        self.low = depth < 2  # whether a top-level member has ended since
        self.topped = False
        self.before = b""  # what stood before the first item's end, if not started
        self.plain: list[bytes] = []
        self.items: list[tuple[str, int, bytes]] = []

    def feed(self, data: bytes) -> None:
        scan = _Scan(data, self.quoted, self.depth)
        self.quoted, self.depth = scan.quoted, scan.depth
        closes = scan.at[scan.braces & (scan.level == 2)] + 1
        lows = scan.at[scan.braces & (scan.level < 2)]
        low = np.diff(np.searchsorted(lows, np.concatenate([[0], closes, [len(data)]]))) > 0
        begin = 0
        for k, end in enumerate(closes.tolist()):
            found = data[begin:end]
            if self.rest:
                found, self.rest = b"".join([*self.rest, found]), []
            if self.started:
                self._item(found, self.low or bool(low[k]))
            else:
                self.started, self.before = True, found
            self.low, self.base, begin = False, 2, end
        self.rest.append(data[begin:])
        self.low |= bool(low[-1])

    def end(self) -> bytes:
        """What is left behind the last item; at the end of a file, ended() reads it."""
        return b"".join(self.rest)

    def ended(self) -> None:
        self._tops(self.end())

    def _item(self, found: bytes, low: bool) -> None:
        own = found.lstrip(_SPACE)
        if low or own[:1] == b"]":
            own = self._tops(found)
        elif own[:1] == b",":
            own = own[1:].lstrip(_SPACE)
        name, listed, count = self.section
        if listed:
            self.items.append((name, count, own))
        self.section = name, listed, count + 1

    def _tops(self, found: bytes) -> bytes:
        """Goes through the top-level members that end or begin in a text; what is behind the last one's head."""
        scan = _Scan(found, 0, self.base)
        braces = scan.at[scan.braces].tolist()
        levels = [self.base, *scan.level[scan.braces].tolist()]
        own = 0
        for begin, end, level in zip([0, *(b + 1 for b in braces)], [*braces, len(found)], levels):
            if level <= 1 or level == 2 and found[begin:end].lstrip(_SPACE)[:1] == b"]":
                head = _HEAD.match(found[begin:end])
                if head[1]:
                    self.plain.append(head[1])
                self.topped, own = True, begin + head.end()
                if begin < len(found):
                    self.section = _text(head[2]), head[3] == b"[", 0
        return found[own:]


def _text(name: bytes | None) -> str | None:
    """A member's name without its quotes and escapes."""
    try:
        return name and json.loads(name).encode("utf-8", "replace").decode()
    except ValueError:
        return None


def _blocks(batches: Iterator[pa.RecordBatch], states: _States) -> Iterator[tuple[tuple[str, int], int | None, Iterator[bytes]]]:
    """(path and start, size of the file, text in blocks with their braces) of each split of a task, in order."""

    def runs():
        for batch in batches:
            paths, starts, texts, sizes = (batch.column(batch.schema.get_field_index(c)) for c in ("path", "start", "text", "size"))
            ends = sorted({0, *pc.run_end_encode(paths).run_ends.to_pylist(), *pc.run_end_encode(starts).run_ends.to_pylist()})
            for i, j in pairwise(ends):
                yield (paths[i].as_py(), starts[i].as_py()), sizes[i].as_py(), b"}".join(texts.slice(i, j - i).cast(pa.binary()).to_pylist())

    def blocks(found, key):
        total = 0
        for _, size, data in found:
            data = b"}" + data if total else data  # the brace of the piece before
            total += len(data) + (not total)
            yield data
        # the last piece of a file has no brace behind it where the bytes of all, with a brace each, are more than it has, and always in archives
        open_ = states[key].open if key in states else size is None or total > size
        yield b"" if open_ else b"}"

    for key, found in groupby(runs(), lambda r: r[0]):
        first = next(found)
        yield key, first[1], blocks(_chain(first, found), key)


def _chain(first, rest):
    yield first
    yield from rest


def _strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).view(pa.string())


def _splits(found: DataFrame) -> _States:
    """How each split of files with several begins. One row for each of them passes the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, size, blocks in _blocks(batches, {}):
            quoted, deep, bytes_ = 0, [0, 0], 0
            for data in blocks:
                scan = _Scan(data, 0, 0)
                deep[quoted] += scan.depth
                deep[1 - quoted] += scan.other_way
                quoted, bytes_ = quoted ^ scan.quoted, bytes_ + len(data)
            yield pa.RecordBatch.from_pylist([{"path": key[0], "start": key[1], "quoted": quoted, "deep": deep[0], "deep_quoted": deep[1], "bytes": bytes_, "size": size}], kinds)

    kinds = pa.schema([("path", pa.string()), *((c, pa.int64()) for c in ("start", "quoted", "deep", "deep_quoted", "bytes", "size"))])
    rows = found.mapInArrow(run, "path string, start long, quoted long, deep long, deep_quoted long, bytes long, size long")
    rows = sorted(rows.where("start > 0 or bytes < size").collect())
    states: _States = {}
    for path, of in groupby(rows, lambda r: r["path"]):
        of, quoted, depth = list(of), 0, 0
        more = sum(r["bytes"] for r in of) > of[0]["size"]
        for r in of:
            states[path, r["start"]] = _State(quoted, depth, more and r is of[-1])
            depth += r["deep_quoted"] if quoted else r["deep"]
            quoted ^= r["quoted"]
    return states


def _read(found: DataFrame, parts: int | None, schema: str, rows: Callable[[str, _Reader], pa.RecordBatch]) -> DataFrame:
    """rows(path, reader) of all files: of what each split holds between its first and last item's end, or of whole files, and of what lies across borders."""
    found = found.select("path", "start", "text", "size")
    states = _splits(found)
    borders = None
    if states:
        states, borders = _joined(found, states, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, _, blocks in _blocks(batches, states):
            state = states.get(key)
            reader = _Reader(state.depth, state.quoted, False, state.section) if state else _Reader(0)
            for data in blocks:
                reader.feed(data)
                yield rows(key[0], reader)
            if not state:
                reader.ended()
                yield rows(key[0], reader)

    out = found.mapInArrow(run, schema)
    return out if borders is None else out.unionByName(borders(schema, rows))


def _joined(found: DataFrame, states: _States, parts: int | None) -> tuple[_States, Callable]:
    """The states with their sections, and what gives the rows of the texts from a split's last item's end to the first in a later one."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, _, blocks in _blocks(batches, states):
            if key in states:
                reader = _Reader(states[key].depth, states[key].quoted, False)
                for data in blocks:
                    reader.feed(data)
                    reader.items, reader.plain = [], []
                before, behind = (reader.before, reader.end()) if reader.started else (reader.end(), b"")
                yield pa.RecordBatch.from_arrays([*map(pa.array, ([key[0]], [key[1]], [reader.started], [reader.topped])), pa.array([reader.section[0]], pa.string()), *map(pa.array, ([reader.section[1]], [reader.section[2]])), _strings([before]), _strings([behind])], names=names)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, border, text in zip(*(batch.column(k) for k in range(3))):
                reader = _Reader(0 if border.as_py() < 0 else 2)
                reader.feed(text.cast(pa.binary()).as_py()), reader.ended()
                yield pa.RecordBatch.from_arrays([*map(pa.array, ([path.as_py()], [border.as_py()], [reader.topped])), pa.array([reader.section[0]], pa.string()), *map(pa.array, ([reader.section[1]], [reader.section[2]]))], names=["path", "border", "topped", "name", "listed", "count"])

    names = ["path", "start", "closed", "topped", "name", "listed", "count", "before", "behind"]
    known = materialize(found.mapInArrow(ends, "path string, start long, closed boolean, topped boolean, name string, listed boolean, count long, before string, behind string"))
    splits, edges = sorted(known.drop("before", "behind").collect(), key=lambda r: (r["path"], r["start"])), []
    for path, of in groupby(splits, lambda r: r["path"]):
        border = -1  # behind which split's last item a text begins; -1: at the file's start
        for r in of:
            edges.append((path, r["start"], border, r["start"] if r["closed"] else None))
            border = r["start"] if r["closed"] else border
    edges = found.sparkSession.createDataFrame(edges, "path string, start long, border long, next long")
    sides = known.join(F.broadcast(edges), ["path", "start"]).select("path", "start", F.explode(F.array(F.struct("border", F.lit(0).alias("side"), F.col("before").alias("text")), F.struct(F.col("next").alias("border"), F.lit(1).alias("side"), F.col("behind").alias("text")))).alias("x"))
    sides = sides.select("path", "start", "x.*").where("border is not null")
    sides = sides.repartition(parts, "path", "border") if parts else sides
    texts = sides.groupBy("path", "border").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "side", "text"))), lambda p: p["text"]), "").alias("text"))
    across = {(r["path"], r["border"]): r for r in texts.mapInArrow(summed, "path string, border long, topped boolean, name string, listed boolean, count long").collect()}

    begins, sectioned = {}, {}
    for path, of in groupby(splits, lambda r: r["path"]):
        section = None, False, 0
        then = lambda r, s: (r["name"], r["listed"], r["count"]) if r["topped"] else (*s[:2], s[2] + r["count"])
        begins[path, -1], section = section, then(across[path, -1], section)
        for r in of:
            sectioned[path, r["start"]] = states[path, r["start"]]._replace(section=section)
            if r["closed"]:
                section = then(r, section)
                begins[path, r["start"]], section = section, then(across[path, r["start"]], section)

    def borders(schema: str, rows: Callable[[str, _Reader], pa.RecordBatch]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for path, border, text in zip(*(batch.column(k) for k in range(3))):
                    path, border = path.as_py(), border.as_py()
                    reader = _Reader(0 if border < 0 else 2, section=begins[path, border])
                    reader.feed(text.cast(pa.binary()).as_py()), reader.ended()
                    yield rows(path, reader)

        return texts.mapInArrow(run, schema)

    return sectioned, borders


def items(found: DataFrame, parts: int | None = None) -> DataFrame:
    """(path, collection, idx, json): the objects of all top-level arrays of the files in pieces(), with their array's name and their place in it, from 0.

    The pieces of a split stand in one task in order, as pieces() and archive_pieces() give them. Top-level arrays of plain values, at most two arrays
    deep, and members that are objects themselves, have no items. An item that a file breaks off in isn't there.
    """

    def rows(path: str, reader: _Reader) -> pa.RecordBatch:
        done, reader.items, reader.plain = reader.items, [], []
        return pa.RecordBatch.from_arrays([pa.array([path] * len(done), pa.string()), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), _strings([d[2] for d in done])], names=["path", "collection", "idx", "json"])

    return _read(found, parts, "path string, collection string, idx long, json string", rows)


def members(found: DataFrame, parts: int | None = None) -> DataFrame:
    """(path, json): for each run of plain top-level members of a file, an object with them."""

    def rows(path: str, reader: _Reader) -> pa.RecordBatch:
        done, reader.items, reader.plain = reader.plain, [], []
        return pa.RecordBatch.from_arrays([pa.array([path] * len(done), pa.string()), _strings([b"{" + d + b"}" for d in done])], names=["path", "json"])

    return _read(found, parts, "path string, json string", rows)
