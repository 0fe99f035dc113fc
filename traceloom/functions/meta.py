"""Descriptions of feature columns: thirteen fields, a hash of them, and the name made from both."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from traceloom.functions.dims import Band, Computation, identity, slug

SPACE_KINDS = ("channel", "roi", "global", "pair", "state")
NORMALIZATIONS = ("raw", "log10", "log_ratio", "db", "percent")


@dataclass(frozen=True)
class FeatureMeta:
    """What a feature is: measure, band, place, window, scale, unit, and what computed it."""

    measure: str
    space: str
    space_kind: str
    unit: str
    source: str
    computation: Computation
    band: Band | None = None
    window: str | None = None
    window_bounds: tuple[float, float] | None = None
    normalization: str = "raw"
    freq_resolution_hz: float | None = None
    coupled_bands: tuple[Band, Band] | None = None
    nodes: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        if self.space_kind not in SPACE_KINDS:
            raise ValueError(f"unknown kind of space {self.space_kind!r}")
        if self.normalization not in NORMALIZATIONS:
            raise ValueError(f"unknown normalization {self.normalization!r}")
        if not self.measure.strip() or not self.space.strip():
            raise ValueError("measure and space need a name")

    @property
    def sha256(self) -> str:
        return identity(asdict(self))

    @property
    def feature(self) -> str:
        parts = (self.measure, self.band.name if self.band else "broadband", self.space, self.window or "all", self.normalization)
        return "_".join(["tl", *map(slug, parts), f"p{self.sha256[:12]}"])


def meta_table(spark: SparkSession, metas: Sequence[FeatureMeta]) -> DataFrame:
    """The metadata dimension: a row for each feature; two features of one name are an error."""
    rows = [(m.feature, m.measure, m.band.name if m.band else None, m.space, m.space_kind, m.window, m.normalization, m.unit, m.source, m.sha256) for m in metas]
    if len({r[0] for r in rows}) != len(rows):
        raise ValueError("features repeat")
    columns = "feature measure band space space_kind window normalization unit source sha256".split()
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))
