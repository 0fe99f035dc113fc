"""Null-aware numeric expressions.

A value that is null, NaN or infinite is missing: `blank` makes all three null,
which Spark's aggregates skip. Denominators that can be zero are divided by
try_divide, as ANSI mode raises otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Named = str | Column
INF = float("inf")


def col(x: Named) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_finite(x: Named) -> Column:
    """True for a number, false for null, NaN and infinities."""
    c = col(x)
    return F.coalesce(~F.isnan(c) & (F.abs(c) != INF), F.lit(False))


def blank(x: Named) -> Column:
    """The value if finite, else null."""
    return F.when(is_finite(x), col(x))


def divide(a: Named, b: Named) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(col(a), col(b))


def safe_pearson(x: Named, y: Named) -> Column:
    """Aggregate: Pearson's r over rows where both are finite; null if constant or under two rows."""
    a, b = F.when(is_finite(x) & is_finite(y), col(x)), F.when(is_finite(x) & is_finite(y), col(y))
    # A constant side is told by its range, as rounding can leave it a spread.
    spread = (F.max(a) > F.min(a)) & (F.max(b) > F.min(b))
    r = divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.when(spread & (F.count(a) > 1), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def fisher_z(r: Named, limit: float = 0.999999) -> Column:
    return F.atanh(F.greatest(F.lit(-limit), F.least(F.lit(limit), col(r))))


def array_blank(x: Named) -> Column:
    """array<double> with non-finite elements as null."""
    return F.transform(col(x), lambda v: F.when(~F.isnan(v) & (F.abs(v) != INF), v))


def shifted_pairs(x: Named, lag: int = 1) -> Column:
    """array<struct<a, b>> of elements `lag` apart; shorter than x by lag."""
    c = col(x)
    n = F.greatest(F.size(c) - lag, F.lit(0))
    return F.zip_with(F.slice(c, 1, n), F.slice(c, lag + 1, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def array_diff(x: Named) -> Column:
    """Differences of neighbouring elements; null where one is null."""
    return F.transform(shifted_pairs(x), lambda p: p["b"] - p["a"])


def runs(flags: Named) -> Column:
    """array<struct<start, length>> of the runs of true in array<boolean>; null counts as false."""
    c = col(flags)
    places = F.sequence(F.lit(0), F.size(c) - 1)
    on = lambda i: F.coalesce(F.get(c, i), F.lit(False))
    starts = F.filter(places, lambda i: on(i) & ~on(i - 1))
    ends = F.filter(places, lambda i: on(i) & ~on(i + 1))
    return F.when(F.size(c) > 0, F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e - s + 1).alias("length")))).otherwise(
        F.array().cast("array<struct<start:int,length:int>>")
    )


def running_sums(df, order: str, columns: dict[str, str], by: list[str] | None = None, descending: bool = False, buckets: int = 256):
    """df with running sums, the row's own value included, in the order of one column whose values are distinct.

    columns maps new names to summed columns. Without by, rows are dealt to
    buckets between approximate quantiles of the order column, summed within and
    shifted by the sums of the buckets before, so that no task takes all rows.
    """
    from pyspark.sql import Window

    sign = -F.col(order) if descending else F.col(order)
    if by:
        w = Window.partitionBy(*by).orderBy(sign).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({n: F.sum(c).over(w) for n, c in columns.items()})
    cuts = df.agg(F.percentile_approx(sign, [k / buckets for k in range(1, buckets)], 10_000).alias("c")).first()["c"] or []
    bounds = F.array(*(F.lit(float(c)) for c in sorted(set(cuts)))) if cuts else F.array().cast("array<double>")
    placed = df.withColumn("_bucket", F.size(F.filter(bounds, lambda b: b < sign)))
    w = Window.partitionBy("_bucket").orderBy(sign).rowsBetween(Window.unboundedPreceding, 0)
    inner = placed.withColumns({n: F.sum(c).over(w) for n, c in columns.items()})
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_bucket").agg(*(F.sum(c).alias(f"_t_{n}") for n, c in columns.items()))
    # At most `buckets` rows.
    shifts = totals.select("_bucket", *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in columns))
    out = inner.join(F.broadcast(shifts), "_bucket")
    return out.withColumns({n: F.col(n) + F.col(f"_s_{n}") for n in columns}).drop("_bucket", *(f"_s_{n}" for n in columns))


def pinned(df, **columns: Column):
    """df with columns computed once for each row.

    A column that an array function reads for each element would else be folded
    into that function and computed anew for each; the generator keeps them apart.
    """
    out = df
    for name, c in columns.items():
        out = out.withColumn(name, F.explode(F.array(c)))
    return out


def bh_adjust(df, p: str, out: str = "q", by: list[str] | None = None):
    """Benjamini-Hochberg adjusted p-values within groups, by rank and a running minimum from the largest on."""
    from pyspark.sql import Window

    keys = by or []
    up = Window.partitionBy(*keys).orderBy(F.col(p))
    down = Window.partitionBy(*keys).orderBy(F.col(p).desc()).rangeBetween(Window.unboundedPreceding, 0)
    n = F.count(p).over(Window.partitionBy(*keys))
    # Ties take their largest rank.
    rank = F.count(p).over(up.rangeBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_raw", F.col(p) * n / rank).withColumn(out, F.least(F.lit(1.0), F.min("_raw").over(down))).drop("_raw")


def exact_quantiles(rows, value: Named, probabilities, by: list[str] | None = None):
    """(by, quantiles): interpolated quantiles of the finite values, as an array.

    Equal values are counted first and the counts are summed in order, so that no
    aggregate holds a whole column; without by, the sums run over buckets.
    """
    keys = list(by or [])
    counts = rows.select(*keys, blank(value).alias("_v")).where("_v is not null").groupBy(*keys, "_v").agg(F.count("*").alias("_k"))
    upto = running_sums(counts, "_v", {"_upto": "_k"}, keys)
    total = counts.groupBy(*keys).agg(F.sum("_k").alias("_n"))
    both = upto.join(total, keys) if keys else upto.join(F.broadcast(total))
    out = []
    for p in probabilities:
        at = (F.col("_n") - 1) * float(p)
        # The order statistics at the place and after it, from 0.
        lo, hi = (F.min(F.when(F.col("_upto") > f(at), F.col("_v"))) for f in (F.floor, F.ceil))
        part = F.max(at - F.floor(at))
        out.append(lo + (hi - lo) * part)
    return both.groupBy(*keys).agg(F.array(*out).alias("quantiles"))
