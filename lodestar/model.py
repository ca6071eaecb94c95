"""Data model: areas, grids, regions and the schemas of canonical tables."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

@dataclass(frozen=True)
class Area:
    """A box in longitude and latitude."""

    west: float
    south: float
    east: float
    north: float
    crs: str = "EPSG:4326"


@dataclass(frozen=True)
class Grid:
    """A regular grid: ``x0``, ``y0`` is the corner of cell (0, 0), centres are half a cell inside."""

    x0: float
    y0: float
    cell: float
    n_rows: int
    n_cols: int
    crs: str = "EPSG:3310"

    @classmethod
    def covering(cls, xmin: float, ymin: float, xmax: float, ymax: float, cell: float, crs: str = "EPSG:3310") -> Grid:
        """The grid aligned to multiples of ``cell`` that covers a box."""
        x0, y0 = math.floor(xmin / cell) * cell, math.floor(ymin / cell) * cell
        return cls(x0, y0, cell, math.ceil((ymax - y0) / cell), math.ceil((xmax - x0) / cell), crs)

    def cells(self, spark: SparkSession) -> DataFrame:
        """A row per cell: ``cell_id``, ``row``, ``col``, ``x``, ``y`` (row-major)."""
        ids = spark.range(self.n_rows * self.n_cols).withColumnRenamed("id", "cell_id")
        ids = ids.withColumns({"row": F.expr(f"cell_id div {self.n_cols}"), "col": F.col("cell_id") % self.n_cols})
        half = self.cell / 2
        return ids.withColumns({"x": self.x0 + F.col("col") * self.cell + half, "y": self.y0 + F.col("row") * self.cell + half})


@dataclass(frozen=True)
class FeatureWeight:
    """How a feature enters a weighted index: ``direct``, ``inverse``, ``boolean``, ``bandpass`` or ``gaussian``."""

    weight: float
    direction: str
    cap: float | None = None
    sigma: float | None = None


@dataclass(frozen=True)
class Region:
    """What a study region consists of: area, grid cell, adapters by kind, classes of deposits by code, pathfinder elements."""

    name: str
    area: Area
    cell: float
    adapters: dict[str, str] = field(default_factory=dict)
    deposit_classes: dict[str, tuple[str, ...]] = field(default_factory=dict)
    pathfinders: tuple[str, ...] = ()


_RING = "array<struct<x:double,y:double>>"
#: Canonical tables as column types; further columns are allowed.
SCHEMAS = {
    "occurrences": dict(x="double", y="double", commodity="string", deposit_codes="array<string>", source="string", raw_record_id="string", year="int"),
    "geochem": dict(x="double", y="double", sample_id="string", source="string", sample_type="string", sample_date="timestamp"),
    "geology_poly": dict(poly_id="bigint", ring=_RING, lith_class="bigint", lith_group="string", source="string", age_ma="double"),
    "fault_line": dict(line_id="bigint", pts=_RING, source="string", fault_type="string"),
    "drillhole": dict(
        x="double", y="double", hole_id="string", source="string", drill_date="timestamp", total_depth_m="double", intersected="boolean",
        max_cu_pct="double", max_mo_pct="double", max_au_gpt="double", max_ag_gpt="double",
    ),
    "hydrology_net": dict(comid="bigint", pts=_RING, arbolate_sum="double", stream_order="int", hydroseq="bigint", slope="double", fcode="int", source="string"),
}


def validate(df: DataFrame, kind: str, types: bool = True) -> DataFrame:
    """``df`` itself if it has the columns (and types) of a canonical table; otherwise ``ValueError`` with all that is wrong."""
    if kind not in SCHEMAS:
        raise KeyError(f"unknown table {kind!r}; known: {', '.join(sorted(SCHEMAS))}")
    have = dict(df.dtypes)
    wrong = [f"{name} is missing" for name in SCHEMAS[kind] if name not in have]
    if types:
        wrong += [f"{name} is {have[name]}, not {kind_}" for name, kind_ in SCHEMAS[kind].items() if name in have and have[name] != kind_]
    if wrong:
        raise ValueError(f"{kind}: {'; '.join(wrong)}")
    return df
