"""Sharding along a Hilbert curve through several metadata dimensions.

Every dimension is quantised to a small integer. The cell's place on the curve
orders the rows; runs of equal row counts are cut from that order, so a shard
covers a compact region of the metadata space and a reader that filters on any
of the dimensions can skip most files. Built from DataFrame expressions only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmill.llm.common import named, stored

#: Rows of one curve cell are dealt over this many salts, so no task holds a hot cell.
SALTS = 1024


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def _turned(axes: Column, i: int, bit: Column) -> Column:
    """Reflect the first axis if axis ``i`` has the bit, else swap their low bits."""
    low, own, head = bit - 1, F.element_at(axes, i + 1), F.element_at(axes, 1)
    swap = head.bitwiseXOR(own).bitwiseAND(low)
    is_set = own.bitwiseAND(bit) != 0

    def changed(v: Column, j: Column) -> Column:
        reflected = F.when(j == 0, v.bitwiseXOR(low)).otherwise(v)
        return reflected if i == 0 else F.when(is_set, reflected).when(j.isin(0, i), v.bitwiseXOR(swap)).otherwise(v)

    turned = F.transform(axes, lambda v, j: changed(v, j))
    return F.when(is_set, turned).otherwise(axes) if i == 0 else turned


def hilbert_index(levels: list[Column], bits: int) -> Column:
    """Place of a cell on the Hilbert curve; each level is an int in [0, 2**bits).

    Works from the highest bit down: at each bit the coordinates are reflected
    or swapped with the first axis, then Gray-coded and interleaved.
    """
    n = len(levels)
    masks = F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)]) if bits > 1 else F.array().cast("array<bigint>")
    order = F.array(*[F.lit(b) for b in range(bits - 1, -1, -1)])

    def rotate(axes: Column, bit: Column) -> Column:
        for i in range(n):
            axes = _bound(axes, partial(_turned_at, i, bit))
        return axes

    def _turned_at(i: int, bit: Column, axes: Column) -> Column:
        return _turned(axes, i, bit)

    def gray(axes: Column) -> Column:
        steps = F.slice(axes, 2, n - 1)
        return F.aggregate(steps, F.slice(axes, 1, 1), lambda done, v: F.concat(done, F.array(F.element_at(done, -1).bitwiseXOR(v))))

    def interleaved(coded: Column) -> Column:
        last = F.element_at(coded, -1)
        fix = F.aggregate(masks, F.lit(0).cast("long"), lambda acc, bit: F.when(last.bitwiseAND(bit) != 0, acc.bitwiseXOR(bit - 1)).otherwise(acc))
        fixed = _bound(fix, lambda t: F.transform(coded, lambda v: v.bitwiseXOR(t)))
        return _bound(
            fixed,
            lambda x: F.aggregate(order, F.lit(0).cast("long"), lambda acc, b: F.aggregate(x, acc, lambda a, v: a * 2 + F.getbit(v, b).cast("long"))),
        )

    axes = F.aggregate(masks, F.array(*[level.cast("long") for level in levels]), lambda acc, bit: rotate(acc, bit))
    return _bound(_bound(axes, gray), interleaved)


def quantised(column: Column, kind: str, bits: int) -> Column:
    """A level in [0, 2**bits): ``hash`` for names, ``log`` for sizes; nulls are level 0."""
    top = (1 << bits) - 1
    if kind == "hash":
        level = F.pmod(F.xxhash64(column.cast("string")), F.lit(top)) + 1
    elif kind == "log":
        level = F.least(F.lit(top), F.floor(F.log2(F.greatest(column.cast("double"), F.lit(0.0)) + 1) * (top / 32.0)) + 1)
    else:
        raise ValueError(f"unknown kind of dimension: {kind}")
    return F.coalesce(F.when(column.isNotNull(), level), F.lit(0)).cast("long")


def hilbert_shards(docs: DataFrame, dimensions: list[tuple[str, str]], shards: int = 16, bits: int = 5) -> DataFrame:
    """``docs`` with ``hilbert`` (curve index), ``shard`` and ``slot``.

    ``dimensions`` are (column, kind) pairs for ``quantised``; a column that
    ``docs`` lacks counts as null. Ranks follow (curve index, salt, row). Shard
    counts differ by at most one and slots are gapless from 0.

    Rows are counted per (cell, salt), offsets are summed over those bounded
    counts, and ranks inside a (cell, salt) come from a window, so a hot cell is
    spread over ``SALTS`` groups. The rows are first stored, which fixes the
    numbers that tell repeated rows apart. Nulls in any column are legal; empty
    tables give no rows. Columns named ``hilbert``, ``shard`` or ``slot``, in any case, are
    replaced; working columns begin with ``_sm_``.
    """
    levels = [quantised(named(name) if name in docs.columns else F.lit(None), kind, bits) for name, kind in dimensions]
    names = [name for name in docs.columns if name.lower() not in ("hilbert", "shard", "slot")]
    kept = [named(name) for name in names]
    rows = docs.select(*kept, hilbert_index(levels, bits).alias("hilbert"), F.monotonically_increasing_id().alias("_sm_row"))
    rows = stored(rows.withColumn("_sm_salt", F.pmod(F.xxhash64("_sm_row"), F.lit(SALTS)).cast("int")), "hilbert")
    # At most cells x SALTS counts; sums run over cells first, then over one cell's salts.
    counts = rows.groupBy("hilbert", "_sm_salt").agg(F.count(F.lit(1)).alias("_sm_n"))
    inside = counts.withColumn("_sm_in", F.sum("_sm_n").over(W.partitionBy("hilbert").orderBy("_sm_salt")) - F.col("_sm_n"))
    cells = rows.groupBy("hilbert").agg(F.count(F.lit(1)).alias("_sm_cell"))
    ordered = W.orderBy("hilbert").rowsBetween(W.unboundedPreceding, W.currentRow)
    cells = cells.select("hilbert", (F.sum("_sm_cell").over(ordered) - F.col("_sm_cell")).alias("_sm_before"))
    total = rows.groupBy().agg(F.count(F.lit(1)).alias("_sm_total"))
    offsets = inside.join(cells, "hilbert").select("hilbert", "_sm_salt", (F.col("_sm_in") + F.col("_sm_before")).alias("_sm_offset")).crossJoin(F.broadcast(total))
    numbered = rows.withColumn("_sm_at", F.row_number().over(W.partitionBy("hilbert", "_sm_salt").orderBy("_sm_row")) - 1)
    placed = numbered.join(offsets, ["hilbert", "_sm_salt"]).withColumn("_sm_rank", F.col("_sm_at") + F.col("_sm_offset"))
    shard = F.expr(f"_sm_rank * {shards} div _sm_total")
    placed = placed.withColumn("shard", shard.cast("int"))
    first = F.expr(f"(shard * _sm_total + {shards - 1}) div {shards}")
    return placed.select(*kept, "hilbert", "shard", (F.col("_sm_rank") - first).alias("slot"))


def write_shards(sharded: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Parquet files of at most ``rows_per_file`` rows in curve order, a folder per shard."""
    parts = sharded.withColumn("_sm_file", F.floor(F.col("slot") / rows_per_file))
    dealt = parts.repartition("shard", "_sm_file").sortWithinPartitions("shard", "slot")
    dealt.drop("_sm_file").write.partitionBy("shard").option("maxRecordsPerFile", rows_per_file).parquet(path)
