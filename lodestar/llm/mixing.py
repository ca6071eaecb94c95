"""Mixing sources to target weights: hash-threshold histograms.

Every document has a uniform 36-bit key (md5 of its id). A source's target is met by taking
whole passes over all its documents and, for the rest, the documents whose key lies below a
threshold. The threshold is found from nested histograms of words by (source, 12-bit bucket):
level 1 over all documents, level 2 only over each source's boundary bucket, level 3 only over
its boundary bucket in turn. No document is sorted, no source is gathered in one task: each
level is a partial aggregation to at most 4096 rows a source.

Defined cases: a null text has size 0; null is a source of its own, ordered last; a source
without words has target 0 and takes nothing; documents that share an id (repeated rows) share a
key and are taken or left together within their source; an empty table gives an empty result;
further columns are kept by ``repeat``, whatever their names, and not read by ``mix``.

The totals of sources are ordered in one task: as many rows as there are sources. Sources are a
short list (sites are not meant as sources); a million of them still sort in one task of 100 MB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, free_name, materialize, read, small

#: Production parameters: weights by the rank of the source, repeating; the share of all words
#: that the targets add up to, as a fraction; the most passes over one source.
WEIGHTS, SHARE, PASSES = (3, 1, 2), (3, 2), 2
#: Bits of the key that each histogram level resolves, and levels.
BITS, LEVELS = 12, 3


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; null: 0."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{SPACE}]+", "x")
    return F.char_length(F.translate(squeezed, " \t\n\x0b\x0c\r", "")).cast("long")


def mix_key(doc_id: Column) -> Column:
    """The first 9 hex digits of the md5 of the id: 36 uniform bits, the same in any engine."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), 1, 9), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: tuple = SHARE, passes: int = PASSES) -> DataFrame:
    """``source``, ``source_size``, ``target``: shares by weight, capped at ``passes`` times the source, the excess reshared.

    With the sources in ascending order of size by weight, the capped ones are a prefix; one
    window over the (few) source totals finds it, so there is no loop. Integers up to the last
    division.
    """
    by = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("long")
    by = by.withColumn("w", w).withColumn("ratio", F.col("source_size") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumns({
        "total": F.sum("source_size").over(whole),
        "w_left": F.sum("w").over(whole) - F.coalesce(F.sum("w").over(earlier), F.lit(0)),
        "capped": F.coalesce(F.sum("source_size").over(earlier), F.lit(0)),
    })
    num, den = share
    # what is left for this source and the later ones, times den; the source is capped if its share of that passes its cap
    left = F.col("total") * num - F.col("capped") * (passes * den)
    by = by.withColumn("left", left).withColumn("is_capped", F.col("w") * F.col("left") > F.col("source_size") * passes * F.col("w_left") * den)
    first = by.where("not is_capped").agg(F.min(F.struct("ratio", F.col("source").isNull(), "source", "left", "w_left")).alias("x")).select("x.left", "x.w_left")
    by = by.select("source", "source_size", "w", "is_capped").crossJoin(F.broadcast(first.select(F.col("left").alias("l"), F.col("w_left").alias("wl"))))  # one row
    shared = (F.col("w") * F.col("l")).cast("double") / (F.col("wl") * den).cast("double")
    return by.select("source", "source_size", F.when(F.col("is_capped"), (F.col("source_size") * passes).cast("double")).otherwise(shared).alias("target"))


def thresholds(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """``goals`` with ``whole`` (passes over everything) and ``cut``: keys below it are taken once more.

    The boundary bucket of the last level is taken if that comes nearer to the target.
    """
    top = BITS * LEVELS
    state = goals.withColumns({
        "whole": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"),
    }).withColumns({"need": F.col("target") - F.col("whole") * F.col("source_size"), "base": F.lit(0).cast("long"), "open": F.lit(True)})
    state = materialize(state, "mix-goals")
    for level in range(1, LEVELS + 1):
        shift, width = top - BITS * level, 1 << (top - BITS * (level - 1))
        held = sizes.select(F.col("source").alias("s"), "size", "key").join(
            small(state).where("open and need > 0").select("source", "base"), F.col("s").eqNullSafe(F.col("source"))
        ).where((F.col("key") >= F.col("base")) & (F.col("key") < F.col("base") + F.lit(width)))
        histogram = held.groupBy("source", F.shiftright("key", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        histogram = histogram.withColumn("upto", F.sum("words").over(run)).alias("h")
        goal = state.select(F.col("source").alias("s"), "need")
        past = histogram.join(goal, F.col("s").eqNullSafe(F.col("source"))).where("upto > need")
        edge = past.groupBy("source").agg(F.min_by(F.struct("bucket", "words", "upto"), "bucket").alias("e"))
        edge = edge.select(F.col("source").alias("s"), F.col("e.bucket").alias("bucket"), F.col("e.words").alias("words"), (F.col("e.upto") - F.col("e.words")).alias("before"))
        state = state.join(edge, F.col("s").eqNullSafe(F.col("source")), "left").withColumns({
            "base": F.when(F.col("bucket").isNotNull(), F.shiftleft(F.col("bucket"), shift)).otherwise(F.col("base")),
            "need": F.when(F.col("bucket").isNotNull(), F.col("need") - F.col("before")).otherwise(F.col("need")),
            "open": F.col("open") & F.col("bucket").isNotNull(),
            "last": F.when(F.col("bucket").isNotNull() & (F.col("need") - F.col("before") > F.col("before") + F.col("words") - F.col("need")), 1).otherwise(0),
        }).drop("s", "bucket", "words", "before")
        state = materialize(state if level == LEVELS else state.drop("last"), "mix-goals")
    # a source whose histogram never passes its need is taken whole once more
    full = F.when((F.col("need") > 0) & ~F.col("open"), F.lit(1 << top)).otherwise(F.col("base") + F.col("last"))
    return state.select("source", "source_size", "target", "whole", F.when(F.col("need") > 0, full).otherwise(F.col("base")).alias("cut"))


def goals_of(docs: DataFrame, doc_id: str, text: str, source: str) -> tuple[DataFrame, DataFrame]:
    """``sizes`` (a row per row of ``docs``) and the goals, a row per source.

    The goals are broadcast where their number is small (checked), else joined by a shuffle.
    """
    sizes = materialize(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), mix_key(F.col(doc_id)).alias("key")), "mix-sizes")
    return sizes, small(thresholds(sizes, targets(sizes)).withColumnRenamed("source", "s"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target``, ``taken``, ``copies`` for each row of ``docs``."""
    sizes, goals = goals_of(docs, doc_id, text, source)
    rows = sizes.join(goals, F.col("s").eqNullSafe(F.col("source")))
    copies = F.when(F.col("size") > 0, F.col("whole") + (F.col("key") < F.col("cut")).cast("long")).otherwise(F.lit(0).cast("long"))
    return rows.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def repeat(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Every row of ``docs`` as often as ``mix`` takes it. Each row meets the goals of its own source, so ids may be null or repeated."""
    s, whole, cut, times, n = (free_name(docs.columns, x) for x in ("_s", "_whole", "_cut", "_times", "_n"))
    goals = goals_of(docs, doc_id, text, source)[1].select(F.col("s").alias(s), F.col("whole").alias(whole), F.col("cut").alias(cut))
    rows = docs.where(F.col(text).rlike(f"[^{SPACE}]")).join(goals, F.col(s).eqNullSafe(F.col(source)))
    rows = rows.withColumn(times, F.col(whole) + (mix_key(F.col(doc_id)) < F.col(cut)).cast("long")).where(F.col(times) > 0)
    return rows.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(docs.columns)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents at 3 : 1 : 2, 150 % of all words, two passes at most."""
    return mix(read(spark, sf_dir, "documents")).drop("copies")


#: The same rows in DuckDB: cumulative sums over the sorted keys instead of histograms.
OP5_SQL = """
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 9)) AS BIGINT) AS key
  FROM documents),
by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
weighted AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM by_source),
running AS (
  SELECT *, sum(source_size) OVER () AS total,
    sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_left,
    coalesce(sum(source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped
  FROM weighted),
marked AS (SELECT *, total * 3 - capped * 4 AS l, w * (total * 3 - capped * 4) > source_size * 2 * w_left * 2 AS is_capped FROM running),
level AS (SELECT l, w_left FROM marked WHERE NOT is_capped ORDER BY source_size / w, source NULLS LAST LIMIT 1),
goals AS (
  SELECT m.source, m.source_size,
    CASE WHEN m.is_capped THEN CAST(m.source_size * 2 AS DOUBLE) ELSE CAST(m.w * v.l AS DOUBLE) / CAST(v.w_left * 2 AS DOUBLE) END AS target
  FROM marked m, level v),
need AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM goals),
keyed AS (SELECT source, key, sum(size) AS words FROM sizes GROUP BY source, key),
cum AS (SELECT source, key, words, sum(words) OVER (PARTITION BY source ORDER BY key) AS upto FROM keyed),
cuts AS (
  SELECT n.source, min(CASE WHEN c.upto > n.target - n.whole * n.source_size THEN c.key END) AS edge
  FROM need n JOIN cum c ON n.source IS NOT DISTINCT FROM c.source GROUP BY n.source),
final AS (
  SELECT n.*, n.target - n.whole * n.source_size AS rest, c.edge,
    coalesce(e.upto - (n.target - n.whole * n.source_size) < (n.target - n.whole * n.source_size) - (e.upto - e.words), false) AS more
  FROM need n LEFT JOIN cuts c ON n.source IS NOT DISTINCT FROM c.source
  LEFT JOIN cum e ON e.source IS NOT DISTINCT FROM n.source AND e.key = c.edge)
SELECT s.doc_id, s.size, f.source_size, f.target,
  CAST(s.size * (f.whole + CASE WHEN f.rest > 0 AND (f.edge IS NULL OR s.key < f.edge OR (s.key = f.edge AND f.more)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sizes s JOIN final f ON s.source IS NOT DISTINCT FROM f.source
"""
