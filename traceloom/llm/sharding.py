"""Hilbert-curve sharding, in DataFrame operations only.

Several metadata columns are quantised, each row gets the index of its cell on a
Hilbert curve through the grid, rows are sorted by that index, and the sorted run
is cut into shards whose row counts differ by one at most. Neighbours on the
curve are neighbours in the grid, so each shard spans a small range of every
column and a reader prunes shards by several columns at once.

Defined results: a null text has no bytes; null metadata fall in the lowest
cell; repeated rows get a slot each; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traceloom.llm.shared import cut

#: Cells of the grid at most: the curve is a table of this many numbers.
MAX_CELLS = 4096


def hilbert_index(point: list[int], bits: int) -> int:
    """Index of a grid point on the Hilbert curve (Skilling, 2004)."""
    x, n, top = list(point), len(point), 1 << (bits - 1)
    q = top
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, top
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    index = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            index = index << 1 | ((v ^ t) >> b & 1)
    return index


def curve(dimensions: int, bits: int) -> list[int]:
    """Curve index of each cell of the grid, cells in row-major order."""
    if dimensions * bits > MAX_CELLS.bit_length() - 1:
        raise ValueError(f"the grid has more than {MAX_CELLS} cells")
    side = 1 << bits
    return [hilbert_index([cell >> bits * (dimensions - 1 - d) & side - 1 for d in range(dimensions)], bits) for cell in range(1 << dimensions * bits)]


def by_hash(name: str, bits: int) -> Column:
    """Cell of a column whose values have no order: its hash; null is cell 0."""
    return F.coalesce(F.pmod(F.xxhash64(F.col(name).cast("string")), F.lit(1 << bits)), F.lit(0)).cast("int")


def by_size(size: Column, bits: int, low: int = 4) -> Column:
    """Cell of a size: its binary logarithm, from 2^low on, in steps of one."""
    return F.least(F.greatest(F.floor(F.log2(size.cast("double") + 1)) - low, F.lit(0)), F.lit((1 << bits) - 1)).cast("int")


def cell_index(cells: list[Column], bits: int) -> Column:
    """Curve index of a row's cells."""
    at: Column = F.lit(0)
    for c in cells:
        at = F.shiftleft(at, bits).bitwiseOR(c)
    return F.element_at(F.array(*(F.lit(i) for i in curve(len(cells), bits))), at + 1)


def ranked(spark: SparkSession, rows: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """rows with rank, their place from 0 in the order of keys, and how many they are.

    The range-sorted rows are written once with their task and place there. What
    is broadcast has one row for each task that wrote any.
    """
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    dealt = cut(spark, dealt, "ranked").withColumn("_task", F.shiftright("_at", 33))
    sizes = dealt.groupBy("_task").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_task", F.coalesce(before, F.lit(0)).alias("_before"))
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.join(F.broadcast(offsets), "_task").withColumn("rank", rank).drop("_at", "_task", "_before"), dealt.count()


def shard(spark: SparkSession, docs: DataFrame, shards: int = 24, bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard, curve_index) of every row.

    The law is "rows": shard s takes the ranks from ceil(s n / shards) on, n rows in all.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = F.octet_length(text).cast("bigint") + 8
    rows = docs.select(
        F.col(id_col).alias("id"),
        size.alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        cell_index([by_hash("lang", bits), by_hash("source", bits), by_size(size, bits)], bits).alias("curve_index"),
    )
    placed, n = ranked(spark, rows, ["curve_index", "text_crc32", "id"])
    s = F.expr(f"cast((rank * {shards}) div {max(n, 1)} as int)")
    start = F.expr(f"((cast((rank * {shards}) div {max(n, 1)} as bigint) * {n}) + {shards - 1}) div {shards}")
    return placed.select(
        "id", "size", "text_crc32", F.lit("rows").alias("law"), s.alias("shard"),
        (F.col("rank") - start).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve_index",
    )
