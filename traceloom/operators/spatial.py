"""Channels to channel, region and global values, with coverage, support and flags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.functions.numeric import blank, is_finite


def spatial_units(channel: Column, groups: Mapping[str, Sequence[str]] | None = None, include_global: bool = True) -> Column:
    """array<struct<space, space_kind>> that a channel belongs to; regions replace channels."""
    unit = lambda s, k: F.struct(s.alias("space"), F.lit(k).alias("space_kind"))
    if groups:
        member = [F.when(channel.isin(list(chs)), unit(F.lit(name), "roi")) for name, chs in groups.items()]
        units = F.filter(F.array(*member), lambda u: u.isNotNull())
    else:
        units = F.array(unit(channel, "channel"))
    return F.concat(units, F.array(unit(F.lit("global"), "global"))) if include_global else units


def check_groups(df: DataFrame, groups: Mapping[str, Sequence[str]]) -> None:
    """Raise if a region names a channel that no row has."""
    wanted = {c for chs in groups.values() for c in chs}
    there = {r[0] for r in df.select("channel").where(F.col("channel").isin(sorted(wanted))).distinct().collect()}
    if wanted - there:
        raise KeyError(f"unknown channels: {sorted(wanted - there)}")


def aggregate_space(
    df: DataFrame, keys: Sequence[str], groups: Mapping[str, Sequence[str]] | None = None, include_global: bool = True,
    value: str = "value", coverage: str | None = "coverage", support: str | None = None, flags: Sequence[str] = (),
) -> DataFrame:
    """Mean over the finite members of each spatial unit, in one shuffle.

    Coverage is the members' sum where the value is finite, by the number of
    members, or their mean if none is; support is their mean, a flag their OR.
    """
    units = df.withColumn("_u", F.explode(spatial_units(F.col("channel"), groups, include_global)))
    units = units.withColumns({"space": F.col("_u.space"), "space_kind": F.col("_u.space_kind")})
    out = [F.avg(blank(value)).alias(value)]
    if coverage:
        some = F.max(is_finite(value).cast("int")) == 1
        out.append(F.when(some, F.sum(F.when(is_finite(value), F.col(coverage)).otherwise(0.0)) / F.count("*")).otherwise(F.avg(coverage)).alias(coverage))
    if support:
        out.append(F.avg(support).alias(support))
    out += [F.bool_or(F.coalesce(F.col(f), F.lit(False))).alias(f) for f in flags]
    return units.groupBy(*keys, "space", "space_kind").agg(*out)
