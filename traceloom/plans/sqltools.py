"""Pieces of DuckDB SQL that the catalogue's checks share, and rounding for both sides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.functions.dims import STANDARD_BANDS

DIGITS = 6


def rounded(df: DataFrame, *columns: str, digits: int = DIGITS) -> DataFrame:
    """Columns rounded, without negative zeros."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


def r(expression: str, name: str, digits: int = DIGITS) -> str:
    return f"round({expression}, {digits}) + 0.0e0 AS {name}"


def spatial(per: str, keys: Sequence[str], flags: Sequence[str] = (), digits: int = DIGITS, groups: dict[str, Sequence[str]] | None = None, include_global: bool = True) -> str:
    """SELECT that takes channel cells (value, coverage) to channels or regions, and all."""
    if groups:
        rows = ", ".join(f"('{g}', '{c}')" for g, cs in groups.items() for c in cs)
        units = f"SELECT {per}.*, m.g AS space, 'roi' AS space_kind FROM {per} JOIN (VALUES {rows}) AS m(g, c) ON m.c = {per}.channel"
    else:
        units = f"SELECT *, channel AS space, 'channel' AS space_kind FROM {per}"
    if include_global:
        units += f" UNION ALL SELECT *, 'global', 'global' FROM {per}"
    k = ", ".join(keys)
    extra = "".join(f", bool_or({f}) AS {f}" for f in flags)
    covered = "CASE WHEN count(value) > 0 THEN sum(CASE WHEN value IS NULL THEN 0 ELSE coverage END) / count(*) ELSE avg(coverage) END"
    return f"SELECT {k}, space, space_kind, {r('avg(value)', 'value', digits)}, {r(covered, 'coverage')}{extra} FROM ({units}) GROUP BY {k}, space, space_kind"


def bands_values(bands=STANDARD_BANDS) -> str:
    return "bands(band, fmin, fmax) AS (VALUES " + ", ".join(f"('{b.name}', {b.fmin}e0, {b.fmax}e0)" for b in bands) + ")"


def column(c: Column, digits: int = DIGITS) -> Column:
    return F.round(c, digits) + F.lit(0.0)
