"""Filter interaction audit: what each filter removes, in every order that the filters can be applied in.

Every document becomes a mask of the filters it fails. Masks are counted per part; the few cells
(a part has at most two to the number of filters) are unpivoted against the steps of all orders.
A running bit-or window over the steps of a cell and order tells which failures came earlier,
conditional sums turn that into counts, and a window over each filter totals its removals over all
orders.

Exact copies are found by SHA-256. A group of copies is first counted down to one row per part, mask
and labels, so however large it is no task orders it; texts are never shuffled.

Defined cases: a null text is an empty one, a null part the empty string; a null ``doc_id`` is neither
smaller nor larger than another (such a row is no copy, nor makes one); rows that share the
smallest ``doc_id`` of a text are all first ones; labels are true for a ``doc_id`` if any of
its rows says so, and rows without an id have none; every order and step has a row for each part, zeros
included; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, read

#: Bounds of the filters: fewest words, percent of different words, percent of capitals, and the characters that no text may hold.
WORDS, DIFFERENT, CAPITALS, SIGNS = 100, 80, 10, "[#$%&*|]"
#: The name of the filter for copies; the others come from ``failures``.
COPY = "E"


def failures(text: Column) -> dict[str, Column]:
    """For each filter that looks at one text: whether the text fails it."""
    words = F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")
    capitals = F.char_length(text) - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < DIFFERENT * F.size(words),
        "C": 100 * capitals > CAPITALS * F.char_length(text),
        "D": text.rlike(SIGNS),
    }


def cells(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """``part``, ``mask``, ``n``, ``good``, ``toxic``: documents of each part that fail just the filters of the mask (the first filter is its lowest bit), and those of them labelled good and toxic."""
    text = F.coalesce("text", F.lit(""))
    bits = sum((F.when(fails, F.lit(1 << k)).otherwise(0) for k, fails in enumerate(failures(text).values())), F.lit(0))
    rows = docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), bits.alias("mask"))
    rows = rows.groupBy("doc_id", "key", "part", "mask").agg(F.count("*").alias("n"))
    told = labels.where("doc_id is not null").groupBy("doc_id").agg(*(F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False)).alias(c) for c in ("quality", "toxic")))
    # rows without an id are dealt out by their text: they meet no label
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("key")).otherwise(F.lit(0))
    rows = rows.withColumn("spread", spread).join(told.withColumn("spread", F.lit(0).cast("long")), ["doc_id", "spread"], "left")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("quality", "toxic")]
    # per text: a row for each part, mask and labels, with its smallest id and the rows that have it
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.lit(1))))
    groups = rows.select("doc_id", "key", "part", "mask", "n", *flags).groupBy("key", "part", "mask", "quality", "toxic").agg(
        F.sum("n").alias("n"), first["doc_id"].alias("least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), F.min_by("n", "doc_id").alias("at_least"),
    )
    groups = groups.withColumn("text_least", F.min("least").over(Window.partitionBy("key")))
    held = F.coalesce(F.when(F.col("least") == F.col("text_least"), F.col("at_least")).otherwise(0), F.lit(0)) + F.col("nameless")
    copy = 1 << len(failures(text))
    split = groups.select("part", "quality", "toxic", F.explode(F.array(F.struct("mask", held.alias("n")), F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - held).alias("n")))).alias("c"))
    n = F.col("c.n")
    return split.where(n > 0).groupBy("part", F.col("c.mask").alias("mask")).agg(F.sum(n).alias("n"), *(F.sum(F.when(F.col(c), n).otherwise(0)).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))))


def audit(masks: DataFrame, filters: Sequence[str]) -> DataFrame:
    """A row per part, order of ``filters`` (letters) and step, from the cells of ``cells``.

    The rows that are worked on are cells times orders times steps: they don't grow with the documents.
    """
    names = "".join(filters)
    orders = ["".join(p) for p in permutations(names)]
    steps = masks.withColumn("filter_order", F.explode(F.lit(orders))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(names)))))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    steps = steps.withColumn("filter", letter).withColumn("own", F.expr(f"mask & shiftleft(1, instr('{names}', filter) - 1)"))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("earlier", F.coalesce(F.bit_or("own").over(before), F.lit(0)))
    fails, alive = F.col("own") != 0, F.col("earlier") == 0
    total = lambda when, of="n": F.sum(F.when(when, F.col(of)).otherwise(0))
    out = steps.groupBy("part", "filter_order", "step", "filter").agg(
        total(~fails & alive).alias("kept"), total(fails & alive).alias("removed"), total(fails & ~alive).alias("redundant"), total(fails & (F.col("mask") == F.col("own"))).alias("unique_fails"),
        total(fails & alive, "good").alias("good_lost"), total(fails & alive, "toxic").alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


def op11_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of the five filters per language."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return audit(cells(docs, labels), [*failures(F.lit("")), COPY])


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, CASE WHEN len(words) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN least < doc_id THEN 16 ELSE 0 END AS mask FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) t(f, bit)),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS o FROM f a, f b, f c, f d, f e WHERE list_unique([a.f, b.f, c.f, d.f, e.f]) = 5),
s AS (SELECT o, step, f, bit FROM o CROSS JOIN range(1, 6) t(step) JOIN f ON f.f = o[step]),
x AS (SELECT part, o, step, f, mask, n, good, toxic, mask & bit AS own, coalesce(bit_or(mask & bit) OVER (PARTITION BY part, mask, o ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM c CROSS JOIN s),
g AS (SELECT part, o, step, f, coalesce(sum(n) FILTER (own = 0 AND earlier = 0), 0) AS kept, coalesce(sum(n) FILTER (own > 0 AND earlier = 0), 0) AS removed, coalesce(sum(n) FILTER (own > 0 AND earlier > 0), 0) AS redundant,
  coalesce(sum(n) FILTER (own > 0 AND own = mask), 0) AS unique_fails, coalesce(sum(good) FILTER (own > 0 AND earlier = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (own > 0 AND earlier = 0), 0) AS toxic_lost FROM x GROUP BY part, o, step, f)
SELECT part, o AS filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM g
"""
