"""Knowledge-driven weighted index: robust normalisation per feature, weights renewed over the features there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import gaussian_falloff
from ..model import FeatureWeight
from ..operators.ranking import percentiles, percentiles_of

# The default features of the placer index.
PLACER = {
    "distance_to_lode_m": FeatureWeight(0.20, "inverse", cap=15_000.0),
    "tertiary_terrace_likelihood": FeatureWeight(0.15, "direct"),
    "paleochannel_likelihood": FeatureWeight(0.18, "direct"),
    "hydraulic_pit_proximity_m": FeatureWeight(0.18, "inverse", cap=5_000.0),
    "catchment_au_hawkes": FeatureWeight(0.13, "direct"),
    "is_quaternary_alluvium": FeatureWeight(0.05, "boolean"),
    "distance_downstream_from_lode_m": FeatureWeight(0.03, "inverse", cap=25_000.0),
    "spi_band": FeatureWeight(0.02, "bandpass"),
    "twi": FeatureWeight(0.03, "direct"),
    "geomorphon_terrace_mask": FeatureWeight(0.02, "boolean"),
    "slope": FeatureWeight(0.01, "inverse"),
}
# Features of the index for older (bench) gravels and of that for modern channels.
TERTIARY = {
    "distance_to_lode_m": FeatureWeight(0.22, "gaussian", sigma=12_000.0),
    "tertiary_terrace_likelihood": FeatureWeight(0.18, "direct"),
    "paleochannel_likelihood": FeatureWeight(0.16, "direct"),
    "hydraulic_pit_proximity_m_buffered": FeatureWeight(0.16, "gaussian", sigma=3_000.0),
    "catchment_au_hawkes": FeatureWeight(0.12, "direct"),
    "is_quaternary_alluvium": FeatureWeight(0.05, "boolean"),
    "distance_to_lithological_contact_m": FeatureWeight(0.05, "gaussian", sigma=2_000.0),
    "twi": FeatureWeight(0.03, "direct"),
    "slope": FeatureWeight(0.03, "inverse"),
}
QUATERNARY = {
    "distance_downstream_from_lode_m": FeatureWeight(0.20, "gaussian", sigma=20_000.0),
    "distance_to_lode_m": FeatureWeight(0.12, "gaussian", sigma=12_000.0),
    "catchment_au_hawkes": FeatureWeight(0.18, "direct"),
    "spi_band": FeatureWeight(0.12, "bandpass"),
    "ksn": FeatureWeight(0.08, "direct"),
    "twi": FeatureWeight(0.06, "direct"),
    "flow_acc": FeatureWeight(0.05, "direct"),
    "paleochannel_likelihood": FeatureWeight(0.08, "direct"),
    "distance_to_lithological_contact_m": FeatureWeight(0.05, "gaussian", sigma=2_000.0),
    "catchment_as_hawkes": FeatureWeight(0.03, "direct"),
    "catchment_sb_hawkes": FeatureWeight(0.03, "direct"),
}
PROXY = FeatureWeight(0.0, "inverse", cap=5_000.0)


def _capped(column: str, spec: FeatureWeight) -> Column:
    c = F.col(column).cast("double")
    return F.when(c.isNotNull(), F.least(c, F.lit(float(spec.cap)))) if spec.direction == "inverse" and spec.cap is not None else c


def normalized(df: DataFrame, column: str, spec: FeatureWeight, ends: list[float | None] | None = None) -> Column:
    """The expression of one feature on a scale of 0 to 1. ``ends``: percentiles 1 and 99 of the (capped) values, else computed here, as two numbers."""
    c = F.col(column).cast("double")
    if spec.direction == "boolean":
        return F.when(c.isNotNull(), (c != 0).cast("double"))
    if spec.direction == "bandpass":
        return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))
    if spec.direction == "gaussian":
        if not spec.sigma or spec.sigma <= 0:
            raise ValueError("gaussian features need a positive sigma")
        return gaussian_falloff(c, spec.sigma)
    if spec.direction not in ("direct", "inverse"):
        raise ValueError(f"unknown direction {spec.direction!r}")
    c = _capped(column, spec)
    lo, hi = percentiles(df.select(c.alias("v")), "v", [0.01, 0.99]) if ends is None else ends
    if lo is None:
        return F.lit(None).cast("double")
    scaled = F.when(c.isNotNull(), (F.least(F.greatest(c, F.lit(lo)), F.lit(hi)) - lo) / (hi - lo) if hi > lo else F.lit(0.0))
    return 1.0 - scaled if spec.direction == "inverse" else scaled


def weighted_index(df: DataFrame, weights: dict[str, FeatureWeight] = PLACER, proxy: str | None = "hydraulic_pit_proximity_m", out: str = "index") -> DataFrame:
    """Append ``out``: the weighted sum over the present features (a missing value adds nothing), scaled robustly once more.

    A paleochannel feature that is absent is replaced by the inverse of ``proxy``. Features that are absent or all null are left out and
    the weights renewed. The percentiles of all features come from one pass.
    """
    have = {n for n in weights if n in df.columns}
    counts = df.agg(*[F.count(n).alias(n) for n in have]).first().asDict() if have else {}
    used = [(name, name, spec, spec.weight) for name, spec in weights.items() if name in have and counts[name]]
    if "paleochannel_likelihood" in weights and "paleochannel_likelihood" not in df.columns and proxy in df.columns:
        used.append(("paleochannel_likelihood", proxy, PROXY, weights["paleochannel_likelihood"].weight))
    total = sum(w for *_, w in used)
    if total <= 0:
        raise ValueError("no usable feature")
    ends = percentiles_of(df, {name: _capped(column, spec) for name, column, spec, _ in used if spec.direction in ("direct", "inverse")}, [0.01, 0.99])
    parts = [F.coalesce(normalized(df, column, spec, ends.get(name)), F.lit(0.0)) * w for name, column, spec, w in used]
    raw = df.withColumn("_raw", sum(parts, F.lit(0.0)) / total)
    return raw.withColumn(out, normalized(raw, "_raw", FeatureWeight(1.0, "direct"))).drop("_raw")


def terrace_likelihood(df: DataFrame, tpi: str = "tpi", slope: str = "slope", alluvium: str = "alluvium", cap: float = 15.0, clip: tuple[float, float] = (0.5, 0.99)) -> DataFrame:
    """Append ``terrace``: the geometric mean of high position, low slope and no alluvium; null where position or slope is."""
    lo, hi = percentiles(df, tpi, list(clip))
    high = (F.least(F.greatest(F.col(tpi), F.lit(lo)), F.lit(hi)) - lo) / (hi - lo) if lo is not None and hi > lo else F.lit(0.0)
    low = F.least(F.greatest(1.0 - F.col(slope) / cap, F.lit(0.0)), F.lit(1.0))
    dry = F.when(F.coalesce(F.col(alluvium).cast("boolean"), F.lit(False)), 0.0).otherwise(1.0)
    value = F.cbrt((high + 1e-6) * (low + 1e-6) * (dry + 1e-6))
    return df.withColumn("terrace", F.when(F.col(tpi).isNotNull() & F.col(slope).isNotNull(), value))
