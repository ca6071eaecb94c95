"""Vector code compression: product codes in whole numbers, assigned through approximation files.

Vectors become fixed-point integers and are cut into parts; each part has a codebook of a few
dozen entries. To find a part's nearest entry, the entries' coordinates are quantised to a few bits
(a cell per coordinate, with the least and the largest coordinate in it). For each part a look-up
table per coordinate gives the least and the largest squared distance to each cell; their sums are lower and upper
bounds for every entry. Only entries whose lower bound isn't above the smallest upper bound are
refined, by exact integer distances.

Rounds are one pass over the vectors each: tasks send sums and counts per entry (the size of
the codebooks, whatever they have read), Spark adds them up, and the driver holds the codebooks alone.

Defined cases: vectors that are null or hold a null or non-finite component are left out, likewise those of
another length than the smallest id's (they can't be compared); lengths that are no multiple of the parts are filled up with
zeros; components are held to a range in which squared distances fit a long (about 2^20 for 64
components); equal distances go to the lower entry; rows that share an id are rows of their own, those with the smaller vector first,
null ids last; fewer vectors than entries make fewer entries; null labels are one group; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fits, materialize, read, release

#: Parts of a vector, entries of a part's codebook, rounds, units of the fixed point, bits of a coordinate's cell.
PARTS, ENTRIES, ROUNDS, SCALE, BITS = 16, 64, 2, 256, 3
#: Vectors that a task works on at a time.
SLICE = 4096
#: Copies of the table of label sums where it is too large for a broadcast: one label may have a third of the vectors.
SALTS = 32


def usable(embedding: Column) -> Column:
    """Whether a vector has only finite components."""
    return embedding.isNotNull() & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def integers(embeddings: pa.Array, length: int, scale: int, parts: int) -> np.ndarray:
    """Fixed-point components, rows x parts x width."""
    width = max(1, -(-length // parts))
    bound = 2.0 ** ((62 - int(np.ceil(np.log2(parts * width)))) // 2 - 1)
    flat = embeddings.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(embeddings), length)
    out = np.zeros((len(embeddings), parts * width), np.int64)
    out[:, :length] = np.clip(np.floor(np.clip(flat, -2.0**40, 2.0**40) * scale), -bound, bound)
    return out.reshape(len(embeddings), parts, width)


class Approximation:
    """The entries of one part's codebook and their cells."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries, n = entries, 1 << bits
        self.cell = np.empty(entries.shape, np.int64)
        self.low, self.high = np.zeros((entries.shape[1], n)), np.zeros((entries.shape[1], n))
        for j, x in enumerate(entries.T if len(entries) else ()):
            edges = np.quantile(x, np.arange(1, n) / n)
            self.cell[:, j] = np.searchsorted(edges, x, side="right")
            for c in range(n):
                own = x[self.cell[:, j] == c]
                if len(own):
                    self.low[j, c], self.high[j, c] = own.min(), own.max()
        self.low, self.high = self.low.astype(np.int64), self.high.astype(np.int64)

    def candidates(self, points: np.ndarray) -> np.ndarray:
        """Which entries can be the nearest to each point: rows x entries."""
        lower = np.zeros((len(points), len(self.entries)), np.int64)
        upper = np.zeros_like(lower)
        for j, q in enumerate(points.T):
            below, above = self.low[j] - q[:, None], q[:, None] - self.high[j]
            near = np.maximum(np.maximum(below, above), 0)
            far = np.maximum(-below, -above)  # to the farther end of the cell
            lower += (near * near)[:, self.cell[:, j]]
            upper += (far * far)[:, self.cell[:, j]]
        return lower <= upper.min(1, keepdims=True)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each point's nearest entry (the lower of equals) and the squared distance."""
        row, entry = np.nonzero(self.candidates(points))  # in order of rows, then of entries
        step = points[row] - self.entries[entry]
        d = (step * step).sum(1)
        start = np.searchsorted(row, np.arange(len(points)))
        best = np.minimum.reduceat(d, start) if len(row) else d
        hit = np.flatnonzero(d == best[row])
        first = hit[np.concatenate([[True], row[hit][1:] != row[hit][:-1]])] if len(hit) else hit
        return entry[first], best


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            yield batch.slice(start, SLICE)


def _improved(vectors: DataFrame, books: np.ndarray, length: int, scale: int) -> np.ndarray:
    """The codebooks (parts x entries x width) after one round."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    n_parts, n_entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = [Approximation(b) for b in shared.value]
        total = np.zeros((n_parts, n_entries, width + 1), np.int64)
        for batch in _batches(batches):
            points = integers(batch.column("embedding"), length, scale, n_parts)
            for p, file in enumerate(files):
                at, _ = file.nearest(points[:, p])
                np.add.at(total[p], at, np.concatenate([points[:, p], np.ones((len(at), 1), np.int64)], 1))
        place = np.flatnonzero(total.reshape(-1, width + 1)[:, -1])
        rows = total.reshape(-1, width + 1)[place]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(place, width + 1)), pa.array(np.tile(np.arange(width + 1), len(place))), pa.array(rows.ravel())], ["place", "k", "s"])
        release()

    told = vectors.select("embedding").mapInArrow(sums, "place long, k long, s long").groupBy("place", "k").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    total: dict[int, dict[int, int]] = {}
    for r in told.collect():  # no more rows than the codebooks have numbers, and counts
        total.setdefault(r["place"], {})[r["k"]] = int(r["s"])
    flat = books.reshape(-1, width).copy()
    for place, own in total.items():
        flat[place] = [own.get(k, 0) // own[width] for k in range(width)]
    return flat.reshape(books.shape)


def first_vectors(vectors: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows with the smallest ids. Ids are found first, so tasks send ids and few vectors, not ``n`` vectors each."""
    ids = [r[0] for r in vectors.select("vec_id").orderBy(F.asc_nulls_last("vec_id")).limit(n).collect()]
    few = vectors if not ids or ids[-1] is None else vectors.where(F.col("vec_id") <= F.lit(ids[-1]))
    return few.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(n)


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """``vec_id``, ``label``, ``codes`` (array of entry indexes, part by part), ``error`` for each usable vector, and the codebooks (parts x entries x width)."""
    kept = vectors.select("vec_id", "label", "embedding").where(usable(F.col("embedding")))
    first = first_vectors(kept, 1).collect()
    length = len(first[0]["embedding"]) if first else 0
    kept = kept.where(F.size("embedding") == length)
    start = [list(r["embedding"]) for r in first_vectors(kept, entries).collect()]
    books = integers(pa.array(start, pa.list_(pa.float64())), length, scale, parts).transpose(1, 0, 2)
    for _ in range(rounds if start else 0):
        books = _improved(kept, books, length, scale)
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = [Approximation(b) for b in shared.value]
        for batch in _batches(batches):
            points = integers(batch.column("embedding"), length, scale, parts)
            code, error = np.empty((len(points), parts), np.int32), np.zeros(len(points), np.int64)
            for p, file in enumerate(files):
                code[:, p], d = file.nearest(points[:, p])
                error += d
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(points) + 1, dtype=np.int32) * parts), pa.array(code.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), lists, pa.array(error)], ["vec_id", "label", "codes", "error"])

    kinds = dict(kept.dtypes)
    return kept.mapInArrow(codes, f"vec_id {kinds['vec_id']}, label {kinds['label']}, codes array<int>, error long"), books


def decode(coded: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """Append ``decoded``: the vector that the codes stand for (the middle of the fixed-point step)."""
    entries = F.lit([[[(float(x) + 0.5) / scale for x in e] for e in part] for part in books.tolist()])
    return coded.withColumn("decoded", F.flatten(F.transform("codes", lambda c, p: F.get(F.get(entries, p), c))))


def label_errors(coded: DataFrame) -> DataFrame:
    """Append ``label_error``: the errors summed over rows with an equal label, nulls together. ``coded`` is a written table."""
    sums = materialize(coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("sum")), "label-errors")
    sums = sums.select(F.col("label").alias("of"), F.col("sum").try_cast("long").alias("label_error"))
    if fits(sums):
        return coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("of")), "left").drop("of")
    sums = sums.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "codes"), F.lit(SALTS)).cast("int"))
    return salted.join(sums, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("of_salt")), "left").drop("of", "salt", "of_salt")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every vector."""
    coded, books = encode(read(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(str(x) for x in books.ravel().tolist()).encode()).hexdigest()
    out = label_errors(materialize(coded, "codes"))
    code = F.concat_ws("", F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))))
    return out.select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    d = " + ".join(f"(p.q[{i}] - b.c[{i}]) * (p.q[{i}] - b.c[{i}])" for i in (1, 2, 3, 4))
    mean = ", ".join(f"floor(sum(a.q[{i}]) / count(a.q))::BIGINT" for i in (1, 2, 3, 4))
    steps = [
        "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "p AS (SELECT vec_id, p, v[4 * p + 1 : 4 * p + 4] AS q FROM v CROSS JOIN range(16) t(p))",
        "b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, q AS c FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 64))",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"a{k} AS (SELECT p.vec_id, p.p, p.q, min(({d}) * 64 + b.e) AS m FROM p JOIN b{k} b USING (p) GROUP BY ALL)")
        if k < ROUNDS:
            steps.append(f"b{k + 1} AS (SELECT b.p, b.e, CASE WHEN count(a.q) = 0 THEN any_value(b.c) ELSE [{mean}] END AS c FROM b{k} b LEFT JOIN a{k} a ON a.p = b.p AND a.m % 64 = b.e GROUP BY b.p, b.e)")
    steps += [
        f"r AS (SELECT vec_id, string_agg(format('{{:02x}}', m % 64), '' ORDER BY p) AS code, sum(m // 64)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id)",
        f"h AS (SELECT sha256(string_agg(list_aggregate(c, 'string_agg', ','), ',' ORDER BY p, e)) AS h FROM b{ROUNDS})",
    ]
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM r JOIN v USING (vec_id) CROSS JOIN h"


#: For vectors of 64 components, as the tables have.
OP12_SQL = _sql()
