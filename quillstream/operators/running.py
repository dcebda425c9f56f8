"""Running totals, ranks and neighbours over whole ordered tables and very common keys, without putting either into one task.

Rows are range-partitioned by their order, so one key's many rows and sparse places spread like any others, and written. Each part is
worked out by itself; what the parts before it add up to is one row for each part, which passes the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import materialize

PART = "_part"
#: Rows of one key that a window may hold in one task; those of a more common key go over range partitions.
COMMON = 1_000_000


def parted(df: DataFrame, order: Sequence[str], parts: int | None = None) -> DataFrame:
    """df in range partitions by order, with the number of each row's as _part; as many as spark.sql.shuffle.partitions says, or parts. Written, as numbers must not change."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(parts, *order).withColumn(PART, F.spark_partition_id()))


def _with_offsets(rows: DataFrame, offsets: list[tuple], schema: str, on: list[str]) -> DataFrame:
    """rows joined with a table of one row for each part; nulls among the keys are alike."""
    table = F.broadcast(rows.sparkSession.createDataFrame(offsets, schema)).alias("o")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in on]
    new = [c.split()[0].strip("`") for c in schema.split(", ")]
    return rows.alias("r").join(table, same, "left").select("r.*", *(f"o.{c}" for c in new if c not in on))


def running_sums(df: DataFrame, sums: dict[str, Column], order: Sequence[str], parts: int | None = None) -> DataFrame:
    """df with the sum of each value up to and with each row, in an order without ties. Values are whole numbers; null counts as 0."""
    rows = parted(df.withColumns({f"_{name}": F.coalesce(value.cast("long"), F.lit(0)) for name, value in sums.items()}), order, parts)
    found = sorted(rows.groupBy(PART).agg(*(F.sum(f"_{name}") for name in sums)).collect())
    before = [accumulate([0, *(r[k + 1] for r in found)]) for k in range(len(sums))]
    offsets = [(r[0], *(next(b) for b in before)) for r in found]
    rows = _with_offsets(rows, offsets, f"{PART} int, " + ", ".join(f"`_{name}_before` long" for name in sums), [PART])
    inside = Window.partitionBy(PART).orderBy(*order)
    return rows.select(*df.columns, *((F.sum(f"_{name}").over(inside) + F.col(f"_{name}_before")).alias(name) for name in sums))


def running_sum(df: DataFrame, value: Column, name: str, *, place: str, within: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """df with the sum of value up to and including each row, in the order of within and then place, which is unique for given values of within."""
    return running_sums(df, {name: value}, [*within, place], parts)


def positions(df: DataFrame, name: str = "position", *, place: str, within: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """df with each row's position, from 1."""
    return running_sums(df, {name: F.lit(1)}, [*within, place], parts)


def ranks(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, parts: int | None = None) -> DataFrame:
    """df with each row's rank, from 1, among those of its keys; order has no ties there.

    Keys are counted first. Rows are dealt by key, once and unwritten; only those of very common keys, one key in COMMON rows at most, are ranked over
    range partitions, where a key's rows may fill many parts.
    """
    keys = list(keys)
    common = [tuple(r[k] for k in keys) for r in df.groupBy(*keys).count().where(F.col("count") > COMMON).select(*keys).collect()]
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
    if not common:
        return df.withColumn(name, inside)
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    marked = _with_offsets(df, [(*k, True) for k in common], f"{kinds}, _common boolean", keys)
    rest = marked.where("_common is null").select(*df.columns, inside.alias(name))
    return rest.unionByName(_ranks_by_range(marked.where("_common").select(*df.columns), keys, order, name, parts))


def _ranks_by_range(df: DataFrame, keys: list[str], order: Sequence[str], name: str, parts: int | None) -> DataFrame:
    rows = parted(df, [*keys, *order], parts)
    key = F.struct(*keys)
    ends = sorted(rows.groupBy(PART).agg(F.min(key).alias("first"), F.max(key).alias("last")).collect(), key=lambda r: r[PART])
    # keys that go on in the next part: at most one for each part
    crossing = list({a["last"]: None for a, b in zip(ends, ends[1:]) if a["last"] == b["first"]})
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    offsets = []
    if crossing:
        marked = _with_offsets(rows.select(*keys, PART), [(*k, True) for k in crossing], f"{kinds}, _crosses boolean", keys)
        counts = marked.where("_crosses").groupBy(*keys, PART).count().collect()
        for k in crossing:
            total = 0
            for r in sorted((r for r in counts if tuple(r[: len(keys)]) == tuple(k)), key=lambda r: r[PART]):
                offsets.append((r[PART], *k, total))
                total += r["count"]
    rows = _with_offsets(rows, offsets, f"{PART} int, {kinds}, _before long", [PART, *keys])
    inside = F.row_number().over(Window.partitionBy(PART, *keys).orderBy(*order))
    return rows.select(*df.columns, (inside + F.coalesce("_before", F.lit(0))).alias(name))


def beside(df: DataFrame, value: str, order: Sequence[str], parts: int | None = None) -> DataFrame:
    """df with prev and next: the value of the row before and of the row after, null at the ends; order has no ties."""
    rows = parted(df, order, parts)
    place = F.struct(*order)
    ends = sorted(rows.groupBy(PART).agg(F.min_by(F.struct(value), place).alias("first"), F.max_by(F.struct(value), place).alias("last")).collect(), key=lambda r: r[PART])
    offsets = [(r[PART], ends[k - 1]["last"][0] if k else None, ends[k + 1]["first"][0] if k + 1 < len(ends) else None) for k, r in enumerate(ends)]
    kind = df.schema[value].dataType.simpleString()
    rows = _with_offsets(rows, offsets, f"{PART} int, _before {kind}, _after {kind}", [PART])
    inside = Window.partitionBy(PART).orderBy(*order)
    rows = rows.withColumns({"_prev": F.lag(F.struct(value)).over(inside), "_next": F.lead(F.struct(value)).over(inside)})
    side = lambda own, border: F.when(F.col(own).isNotNull(), F.col(f"{own}.{value}")).otherwise(F.col(border))
    return rows.select(*df.columns, side("_prev", "_before").alias("prev"), side("_next", "_after").alias("next"))
