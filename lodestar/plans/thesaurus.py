"""Fuzzy matching of free text to a small thesaurus, in SQL expressions on distinct texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import pre_clean


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two strings, one row of the usual table at a time."""
    right = F.split(b, "")

    def row(before: Column, sign: Column) -> Column:
        def cell(done: Column, j: Column) -> Column:
            best = F.when(F.element_at(right, j) == sign, F.element_at(before, j) + 1).otherwise(F.greatest(F.element_at(before, j + 1), F.element_at(done, j)))
            return F.concat(done, F.array(best))

        return F.aggregate(F.sequence(F.lit(1), F.char_length(b)), F.array(F.lit(0)), cell)

    table = F.aggregate(F.split(a, ""), F.array_repeat(F.lit(0), F.char_length(b) + 1), row)
    return F.when((a == "") | (b == ""), 0).otherwise(F.element_at(table, -1))


def token_set_ratio(a: Column, b: Column) -> Column:
    """0 to 100: how alike two texts are as sets of words, by insertions and deletions.

    100 if one set holds the other; else the best of the words that only one side has compared
    with each other (the shared words counting as equal), and the shared words with either side.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    x, y = words(a), words(b)
    text = lambda c: F.array_join(F.array_sort(c), " ")
    both, left, right = text(F.array_intersect(x, y)), text(F.array_except(x, y)), text(F.array_except(y, x))
    size, gap = F.char_length(both), (F.char_length(both) > 0).cast("int")
    p, q = F.char_length(left), F.char_length(right)
    rest = p + q - 2 * common_subsequence(left, right)
    ratio = lambda distance, total: F.when(total > 0, 100.0 - 100.0 * distance / total).otherwise(0.0)
    apart = ratio(rest, 2 * (size + gap) + p + q)
    shared = F.greatest(ratio(gap + p, 2 * size + gap + p), ratio(gap + q, 2 * size + gap + q))
    found = F.when((size > 0) & ((p == 0) | (q == 0)), 100.0).when(size > 0, F.greatest(apart, shared)).otherwise(apart)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(found)


def match(df: DataFrame, text: str, terms: list[str], least: float) -> DataFrame:
    """Append ``term`` and ``ratio`` of the best term (null below ``least``; of equal ones the last by code point). Only distinct texts are compared; the result is joined back."""
    own = pre_clean(F.coalesce(F.col(text), F.lit("")))
    best = F.greatest(*[F.struct(F.round(token_set_ratio(own, F.lit(t)), 6).alias("ratio"), F.lit(t).alias("term")) for t in terms], F.struct(F.lit(-1.0).alias("ratio"), F.lit("").alias("term")))
    found = df.select(text).where(F.col(text).isNotNull()).distinct().withColumn("_m", best)
    kept = F.col("_m.ratio") >= least
    return df.join(found.select(text, F.when(kept, F.col("_m.term")).alias("term"), F.when(kept, F.col("_m.ratio")).alias("ratio")), text, "left")
