"""Document fingerprints [native]: canonical exact digest.

The canonical text is NFC-normalised, case-folded, with every run of white space folded to one
space and trimmed; its digest is two independently seeded 64-bit xxhash values (128 bits).
``resolve_buckets`` groups equal digests and compares canonical bytes inside them, so two
different canonical texts never share a fingerprint. Everything is DataFrame functions; Unicode
normalisation and case folding are the ``reflect`` SQL function over ICU classes that Spark itself
ships.

Defined cases: a null text counts as empty; empty and blank texts share one fingerprint;
repeated rows get equal fingerprints; an empty table gives an empty result; further columns are
kept by ``fingerprint`` and ``with_next``, whatever their names, but for those named like their
outputs, which are replaced; rows with equal ids follow each other by the hash of their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, free_name, materialize, read, small

#: Hex digits of a digest.
DIGITS = 32


def _nfc(text: Column) -> Column:
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))


def canonical(text: Column) -> Column:
    """NFC, full case folding, white space folded; null stays null."""
    there = F.coalesce(text, F.lit(""))
    folded = _nfc(F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), _nfc(there), F.lit(True)))
    return F.when(text.isNotNull(), F.trim(F.regexp_replace(folded, r"[\s\p{Z}]+", " ")))


def digest(canon: Column) -> Column:
    """128 bits of xxhash as 32 hex digits."""
    wide = [F.lpad(F.lower(F.hex(h)), 16, "0") for h in (F.xxhash64(canon), F.xxhash64(F.lit(1), canon))]
    return F.left(F.concat(*wide), F.lit(DIGITS))


def resolve_buckets(rows: DataFrame, canon: str, key: str) -> DataFrame | None:
    """Byte comparison inside equal buckets: a row (``key``, ``canon``, ``ordinal``) for each different text of the digests that hold several; None where none does, as practically always."""
    apart = rows.groupBy(key).agg(F.min(canon).alias("lo"), F.max(canon).alias("hi")).where("lo <> hi")
    apart = materialize(apart.select(key), "apart")
    if apart.isEmpty():
        return None
    found = rows.join(small(apart), key, "left_semi").select(key, canon).distinct()
    return materialize(found.withColumn("ordinal", F.row_number().over(Window.partitionBy(key).orderBy(canon))), "buckets")


def repeated(keys: DataFrame, key: str) -> DataFrame:
    """The digests that several rows have: only their texts are compared. Broadcast where they are few (checked)."""
    return small(materialize(keys.groupBy(key).count().where("count > 1").select(key), "repeated"))


def numbered(key: str, ordinal: str = "ordinal") -> Column:
    """The fingerprint: the digest, with an ordinal where different texts share it."""
    return F.when(F.col(ordinal) > 1, F.concat_ws("-", key, ordinal)).otherwise(F.col(key))


def fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Append column ``out``: the digest, with an ordinal where different texts share a digest."""
    base = docs.drop(out)
    canon, key, ordinal = (free_name([*base.columns, text, out], n) for n in ("canon", "digest", "ordinal"))
    rows = base.withColumn(canon, canonical(F.coalesce(docs[text], F.lit(""))) if text == out else canonical(F.coalesce(F.col(text), F.lit(""))))
    rows = rows.withColumn(key, digest(F.col(canon)))
    own = rows.select(canon, key)
    apart = resolve_buckets(own.join(repeated(own, key), key, "left_semi"), canon, key)
    if apart is None:
        return rows.withColumn(out, F.col(key)).drop(canon, key)
    apart = apart.withColumnRenamed("ordinal", ordinal)
    return rows.join(small(apart), [key, canon], "left").withColumn(out, numbered(key, ordinal)).select(*base.columns, out)


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", derived: dict[str, Column] | None = None) -> DataFrame:
    """Append ``derived`` columns, and ``next_`` ones of them and of the text: those of the row with the next ``key``; after the last, the first.

    Rows are dealt to key ranges found by an approximate quantile (the number of ranges is a
    multiple of the shuffle partitions, so the range table is bounded), the first row of each range
    is copied to the range before it, and a window over each range does the rest: texts are
    shuffled once, and derived columns are made behind that shuffle. Null keys come first; equal
    keys are ordered by the hash of their text, and a key that many rows have (or none at all) is cut
    into ranges of that hash.
    """
    derived = derived or {}
    spark = docs.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = [f"next_{c}" for c in (text, *derived)]
    docs = docs.drop(*derived, *out)
    k, h, b, c, to, copy = (free_name([*docs.columns, *derived, *out], x) for x in ("_k", "_h", "_b", "_c", "_to", "_copy"))
    rows = docs.withColumns({k: F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))), h: F.xxhash64(text)})
    found = rows.agg(F.percentile_approx(k, [i / n for i in range(1, n)], 100 * n)).first()[0] or []
    bounds = sorted(set(found))
    hot = {v: found.count(v) for v in bounds if found.count(v) > 1}  # keys of several ranges' rows: cut by the hash, too
    starts = [0]
    for v in bounds:
        starts.append(starts[-1] + 1 + hot.get(v, 0))
    step = max(1, int(len(bounds) ** 0.5))
    fine, coarse = (F.array(*map(F.lit, x)).cast("array<bigint>") for x in (bounds, bounds[step - 1 :: step]))
    below = lambda xs: F.size(F.filter(xs, lambda x: x < F.col(k)))
    rows = rows.withColumn(c, below(coarse) * F.lit(step)).withColumn(b, F.col(c) + below(F.slice(fine, F.col(c) + 1, F.lit(step)))).drop(c)
    if hot:
        cuts = F.create_map(*[F.lit(x) for v, m in hot.items() for x in (v, m)]).cast("map<bigint,int>")
        part = F.coalesce(1 + F.least(F.floor((F.col(h) / float(1 << 64) + 0.5) * F.try_element_at(cuts, F.col(k))), F.try_element_at(cuts, F.col(k)) - 1), F.lit(0))
        rows = rows.withColumn(b, (F.element_at(F.array(*map(F.lit, starts)), F.col(b) + 1) + part).cast("int"))
    firsts = rows.groupBy(b).agg(F.min(F.struct(k, h)).alias(c)).select(b, f"{c}.{k}", f"{c}.{h}")
    ring = Window.orderBy(b)  # one row per range, bounded
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = firsts.select(k, h, F.coalesce(F.lag(b).over(ring), F.last(b).over(whole)).alias(to))
    first_rows = rows.join(F.broadcast(before), [k, h]).groupBy(to).agg(F.first(F.struct(*docs.columns, k, h)).alias(c)).select(to, f"{c}.*")
    copies = first_rows.select(*docs.columns, k, h, F.col(to).alias(b), F.lit(True).alias(copy))
    every = rows.withColumn(copy, F.lit(False)).unionByName(copies).repartition(b).withColumns(derived)
    order = Window.partitionBy(b).orderBy(copy, k, h)
    out_rows = every.withColumns({f"next_{x}": F.lead(x).over(order) for x in (text, *derived)})
    return out_rows.where(~F.col(copy)).drop(k, h, b, copy)


def edited(text: Column, n: Column, follower: Column) -> Column:
    """The last quarter of the code points replaced by the first as many of ``follower``."""
    k = F.floor(n / 4).cast("int")
    return F.concat(F.left(text, n.cast("int") - k), F.left(follower, k))


def with_edited(docs: DataFrame) -> DataFrame:
    """The query's rows from ``doc_id`` and ``text``; likeness is 1.0 where digests and canonical bytes are equal, else 0.0.

    Digests of texts and of edited texts are made once and written with the keys of the rows. Of
    digests that occur several times (in either column), the texts are fetched and their canonical
    bytes compared; both columns are numbered by one table of buckets.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    row = F.xxhash64("doc_id", F.col("doc_id").isNull(), "text")
    rows = with_next(docs, derived={"row": row, "digest": digest(canonical(F.col("text")))})
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    rows = rows.withColumn("edited_text", edited(F.col("text"), F.col("n_chars"), F.col("next_text")))
    rows = rows.withColumn("edited_digest", digest(canonical(F.col("edited_text"))))
    same = lambda fp, text: F.when(F.col("digest") != F.col(fp), 0.0).when(canonical(F.col("text")) == canonical(F.col(text)), 1.0).otherwise(0.0)
    rows = rows.select(
        "doc_id", "row", "next_row", "n_chars", F.sha2(F.col("edited_text"), 256).alias("edited_sha256"), "digest", "edited_digest",
        same("edited_digest", "edited_text").alias("near_edited"), same("next_digest", "next_text").alias("near_next"),
    )
    rows = materialize(rows, "prints")

    # an edited text that is canonically its own text has that text's bytes
    other = rows.where("edited_digest <> digest or near_edited = 0.0").select("row", "next_row", F.col("edited_digest").alias("digest"))
    known = repeated(rows.select("digest").unionAll(other.select("digest")), "digest")
    text_of = docs.select(row.alias("row"), "text")
    own = rows.select("row", "digest").join(known, "digest", "left_semi")
    apart = text_of.join(small(materialize(own.distinct(), "own")), "row").select("digest", canonical(F.col("text")).alias("canon"))
    mixed = materialize(other.join(known, "digest", "left_semi").distinct(), "mixed")
    if not mixed.isEmpty():
        texts = text_of.join(small(mixed), "row").join(small(materialize(text_of.join(small(mixed.select(F.col("next_row").alias("row")).distinct()), "row", "left_semi").select(F.col("row").alias("next_row"), F.col("text").alias("next_text")).distinct(), "next-texts")), "next_row")
        canon = canonical(edited(F.col("text"), F.char_length("text"), F.col("next_text"))).alias("canon")
        mixed = materialize(texts.select("row", "next_row", "digest", canon).distinct(), "mixed-texts")
        apart = apart.unionAll(mixed.select("digest", "canon"))
    buckets = resolve_buckets(apart, "canon", "digest")
    if buckets is None:
        return rows.select("doc_id", "n_chars", "edited_sha256", F.col("digest").alias("fingerprint"), F.col("edited_digest").alias("edited_fingerprint"), "near_edited", "near_next")
    own = text_of.join(small(buckets.select("digest").distinct()).join(rows.select("row", "digest"), "digest").distinct(), "row").select("row", "digest", canonical(F.col("text")).alias("canon"))
    own = materialize(own.join(small(buckets), ["digest", "canon"]).select("row", F.col("ordinal").alias("o")).distinct(), "ordinals")
    theirs = materialize(mixed.join(small(buckets), ["digest", "canon"]).select("row", "next_row", F.col("ordinal").alias("e")).distinct(), "ordinals") if "canon" in mixed.columns else None
    rows = rows.join(small(own), "row", "left")
    rows = rows.join(small(theirs), ["row", "next_row"], "left") if theirs is not None else rows.withColumn("e", F.lit(None).cast("int"))
    rows = rows.withColumn("e", F.when((F.col("edited_digest") == F.col("digest")) & (F.col("near_edited") == 1.0), F.col("o")).otherwise(F.col("e")))
    return rows.select("doc_id", "n_chars", "edited_sha256", numbered("digest", "o").alias("fingerprint"), numbered("edited_digest", "e").alias("edited_fingerprint"), "near_edited", "near_next")


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: code points, digest of the edited text, both fingerprints, likeness to the edited and the next text."""
    return with_edited(read(spark, sf_dir, "documents"))
