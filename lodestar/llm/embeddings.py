"""Embedding near-dedup: spherical-cap filters.

Filter directions are the words of structured random product codes: each of a few random rotations
cuts the vectors into blocks, each block has a few random unit directions, and a filter is a choice
of one direction per block. (Under one rotation, vectors with most of their length in one block
pass few filters; over several, all pass about as many.) A vector passes a filter if its cosine with the filter's direction exceeds a
bound; the filters it passes are listed by decoding block by block, dropping every partial choice
that can't reach the bound any more, so the many filters are never tried one by one. Vectors are
joined on the filters they pass and verified in double precision.

The number of filters and the bound follow from the largest group of vectors to compare: caps
hold about ``TARGET`` vectors each, and there are so many that a pair at the threshold shares one
with probability 1 - ``MISS``. Equal vectors are collapsed first. The filters of a label are dealt
to parts by their rotation and first words, a part for every ``LARGEST`` vectors of the label; a
vector goes once to each part where it passes a filter, and is joined by filter there. A part
that gets more than ``LARGEST`` vectors (a tight cluster) is cut, and each piece meets each other
piece in a task of its own. Inside a task vectors are compared in blocks of bounded size, and what
is found is added up block by block; where the caps of a part overlap so much that its pairs would
be compared many times over, they are compared once.

Defined cases: a vector links with nothing if its label is null, or it is null, empty, zero, or
holds null or non-finite components; vectors of different lengths don't link; repeated rows and
equal vectors link; rows that share a ``vec_id`` are counted one by one; an empty table gives an
empty result; further columns are not read. Equal vectors are recognised by a 64-bit hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, materialize, read, small

#: The threshold; vectors in a cap; chance to miss a pair at the threshold.
COSINE, TARGET, MISS = 0.93, 64, 1e-4
#: Vectors that one task gets at most (twice as many in a task of two pieces), and numbers in them.
LARGEST, NUMBERS = 16384, 1 << 20
#: Products and pairs that are held at a time; bytes of the table that tells the filters two vectors share.
PRODUCTS, PAIRS, BITS = 1 << 20, 1 << 14, 64 << 20
#: Rotations; words of a block's code at most; seed of rotations and codes.
ROTATIONS, ALPHABET, SEED = 16, 512, 7


class Sphere:
    """Tail of the cosine between a unit vector and a random direction in ``dim`` dimensions."""

    def __init__(self, dim: int):
        self.x = np.linspace(-1, 1, 40001)
        self.density = (1 - self.x**2) ** ((max(dim, 2) - 3) / 2) if dim > 2 else np.ones_like(self.x)
        self.density /= np.trapezoid(self.density, self.x)
        steps = (self.density[1:] + self.density[:-1]) / 2 * np.diff(self.x)
        self.above = np.append(np.cumsum(steps[::-1])[::-1], 0.0)

    def tail(self, t: np.ndarray) -> np.ndarray:
        return np.interp(t, self.x, self.above)

    def bound(self, share: float) -> float:
        """The cosine that a direction exceeds with probability ``share``."""
        return float(np.interp(share, self.above[::-1], self.x[::-1]))


def both_pass(dim: int, t: float, rho: float) -> float:
    """Probability that two unit vectors with cosine ``rho`` both have a cosine above ``t`` with a random direction."""
    sphere, rest = Sphere(dim), Sphere(dim - 1)
    at = (sphere.x > t) & (sphere.x < 1)
    x = sphere.x[at]
    inner = rest.tail((t - rho * x) / (math.sqrt(1 - rho * rho) * np.sqrt(1 - x * x)))
    return float(np.trapezoid(sphere.density[at] * inner, x))


def design(largest: int, dim: int, cosine: float = COSINE) -> tuple[float, int, int]:
    """Bound of a cap, number of blocks and words a block, for groups of ``largest`` vectors."""
    bound = min(Sphere(dim).bound(min(0.05, TARGET / max(largest, 1))), 0.85)  # in few dimensions caps would get smaller than what they look for
    filters = 3 * math.log(1 / MISS) / max(both_pass(dim, bound, cosine), 1e-12) / ROTATIONS  # three times as many: the words of a product code aren't independent
    blocks = min(2, dim)
    while filters ** (1 / blocks) > ALPHABET and blocks < dim:
        blocks += 1
    return bound, blocks, min(ALPHABET, max(2, math.ceil(filters ** (1 / blocks))))


class CapCode:
    def __init__(self, dim: int, bound: float, blocks: int, words: int):
        rng = np.random.default_rng(SEED)
        self.parts = np.array_split(np.arange(dim), blocks)
        self.rotations, self.codes = [], []
        for _ in range(ROTATIONS):
            self.rotations.append(np.linalg.qr(rng.standard_normal((dim, dim)))[0])
            codes = [rng.standard_normal((words, len(p))) for p in self.parts]
            self.codes.append([c / np.linalg.norm(c, axis=1, keepdims=True) for c in codes])
        self.words, self.blocks = words, blocks
        self.bound = bound * math.sqrt(blocks)

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (row, filter) with the row's cosine to the filter above the bound."""
        rows, filters = [], []
        for start in range(0, len(unit), 2048):
            for r in range(ROTATIONS):
                row, code = self._decode(unit[start : start + 2048], r)
                rows.append(row + start)
                filters.append(code)
        return np.concatenate(rows), np.concatenate(filters)

    def _decode(self, unit: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
        turned = unit @ self.rotations[r]
        dots = [turned[:, p] @ c.T for p, c in zip(self.parts, self.codes[r], strict=True)]
        rest = np.cumsum([d.max(1) for d in dots][::-1], axis=0)[::-1]  # the most that block b and the later ones can add
        row, code, total = np.arange(len(unit)), np.full(len(unit), r, np.int64), np.zeros(len(unit))
        for b, d in enumerate(dots):
            best = rest[b + 1] if b + 1 < len(dots) else np.zeros(len(unit))
            sums = total[:, None] + d[row]
            i, w = np.nonzero(sums + best[row][:, None] > self.bound)
            row, code, total = row[i], code[i] * self.words + w, sums[i, w]
        return row, code

    def part(self, code: np.ndarray, parts: int) -> np.ndarray:
        """The part of a filter: as few first words as give each part a few choices."""
        if parts <= 1:
            return np.zeros(len(code), np.int64)
        own = 1
        while own < self.blocks and ROTATIONS * self.words**own < 4 * parts:
            own += 1
        return code // self.words ** (self.blocks - own) % parts


def vectors(rows: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """``vec_id``, ``h`` (null where the vector links with nothing), ``label``, ``dim``, ``e`` (its components)."""
    e = F.col(embedding)
    finite = (F.size(e) > 0) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0)
    valid = F.col(label).isNotNull() & F.coalesce(finite, F.lit(False))
    key = F.when(valid, F.xxhash64(F.col(label).cast("string"), F.transform(e, lambda x: x.cast("double") + F.lit(0.0))))  # -0.0 is 0.0
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), key.alias("h"), F.col(label).cast("string").alias("label"), F.size(e).alias("dim"), e.alias("e"))


def packed(classes: DataFrame) -> DataFrame:
    """The components ``e`` of each class as ``vector``: little-endian floats, doubles where they were no floats."""
    number = np.float32 if dict(classes.dtypes)["e"] == "array<float>" else np.float64
    others = [c for c in classes.columns if c != "e"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [x.values.to_numpy(zero_copy_only=False).astype(number).tobytes() for x in batch.column("e")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(raw, pa.binary())], [*others, "vector"])

    kinds = dict(classes.dtypes)
    return classes.mapInArrow(pack, ", ".join(f"{c} {kinds[c]}" for c in others) + ", vector binary")


def _units(raw: list[bytes], dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(raw)).reshape(-1, dim) if len(raw[0]) == 8 * dim else np.frombuffer(b"".join(raw), np.float32).reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Found:
    """Links counted and components joined, block by block, over the vectors of a task."""

    def __init__(self, x: np.ndarray, m: np.ndarray, piece: np.ndarray, cosine: float):
        self.x, self.m, self.piece, self.cosine = x, m, piece, cosine
        self.links, self.root, self.some = np.zeros(len(x), np.int64), np.arange(len(x)), np.zeros(len(x), bool)
        self.two = len(np.unique(piece)) > 1

    def compare(self, own: np.ndarray, apart: np.ndarray, shared: np.ndarray | None, across: bool) -> None:
        """Compare the vectors ``own``. A pair counts if no bit of ``apart`` is common (it counts elsewhere then), and one of ``shared`` is; ``across``: only between pieces."""
        start = 0
        while start < len(own):
            stop = start + max(1, PRODUCTS // (len(own) - start))
            i, j = np.nonzero(self.x[own[start:stop]] @ self.x[own[start:]].T >= self.cosine - 1e-12)
            keep = i < j
            if across:
                keep &= self.piece[own[start + i]] != self.piece[own[start + j]]
            i, j = i[keep] + start, j[keep] + start
            for k in range(0, len(i), PAIRS):
                self._add(own, i[k : k + PAIRS], j[k : k + PAIRS], apart, shared)
            start = stop

    def _add(self, own, i, j, apart, shared) -> None:
        a, b = own[i], own[j]
        exact = np.einsum("ij,ij->i", self.x[a], self.x[b]) >= self.cosine
        if shared is not None:
            exact &= (shared[i] & shared[j]).any(1)
        a, b, i, j = a[exact], b[exact], i[exact], j[exact]
        self.some[a] = self.some[b] = True
        while True:  # hook roots on smaller ones until both ends of every link agree
            ra, rb = self.root[a], self.root[b]
            if (ra == rb).all():
                break
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]
        first = ~(apart[i] & apart[j]).any(1)
        np.add.at(self.links, a[first], self.m[b[first]])
        np.add.at(self.links, b[first], self.m[a[first]])


def _bits(row: np.ndarray, name: np.ndarray, rows: int) -> np.ndarray:
    """Which of the names (numbers from 0 on) each row has, as bits."""
    out = np.zeros((rows, int(name.max(initial=0)) // 64 + 1), np.uint64)
    np.bitwise_or.at(out, (row, name // 64), np.uint64(1) << (name % 64).astype(np.uint64))
    return out


def join_caps(found: Found, code: CapCode, part: int, parts: int, across: bool) -> None:
    """Compare the vectors of one part that pass a common filter of it; a pair counts at the first filter that both pass, parts in order."""
    row, cap = code.decode(found.x)
    own = code.part(cap, parts)
    by = np.lexsort((row, cap, own))
    row, cap, own = row[by], cap[by], own[by]
    new = np.concatenate(([True], (np.diff(cap) != 0) | (np.diff(own) != 0))) if len(cap) else np.zeros(0, bool)
    name = np.cumsum(new) - 1  # filters in the order in which pairs count
    several = np.bincount(name)[name] > 1 if len(name) else new
    row, name, own = row[several], name[several], own[several]  # a filter that one vector passes joins nothing
    name = np.unique(name, return_inverse=True)[1]
    n, names = len(found.x), int(name.max(initial=-1)) + 1
    mine = own == part
    sizes = np.bincount(name[mine], minlength=names).astype(np.int64)
    if (sizes**2).sum() > n * n and n * (names // 64 + 1) * 8 <= BITS:
        before = own < part
        found.compare(np.arange(n), _bits(row[before], name[before], n), _bits(row[mine], name[mine], n) if parts > 1 else None, across)
        return
    starts = np.searchsorted(name, np.arange(names + 1))
    by_row = np.lexsort((name, row))
    row_at = np.searchsorted(row[by_row], np.arange(n + 1))
    name_of = name[by_row]
    for c in np.flatnonzero(sizes > 1).tolist():
        members = row[starts[c] : starts[c + 1]]
        lists = [name_of[row_at[r] : row_at[r + 1]] for r in members.tolist()]
        lower = [x[x < c] for x in lists]
        flat = np.concatenate(lower)
        local = np.unique(flat, return_inverse=True)[1]
        found.compare(members, _bits(np.repeat(np.arange(len(members)), list(map(len, lower))), local, len(members)), None, across)


def compare(classes: DataFrame, cosine: float) -> DataFrame:
    """``h``, ``links``, ``root`` from each task: how many vectors were newly linked with a class, and an edge that joins it to its component there."""
    spark = classes.sparkSession
    by_label = materialize(classes.groupBy("dim", "label").count(), "label-sizes")
    sizes = {r[0]: r[1] for r in by_label.groupBy("dim").agg(F.max("count")).collect()}  # a row per vector length
    codes = {d: design(n, d, cosine) for d, n in sizes.items()}
    tasks = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, CapCode] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                some = batch.slice(start, 1024)
                dims, parts = some.column("dim").to_numpy(), some.column("parts").to_numpy()
                for d, n in np.unique(np.stack([dims, parts]), axis=1).T.tolist():
                    own = some.filter(pa.array((dims == d) & (parts == n)))
                    if n == 1:
                        row, part = np.arange(own.num_rows), np.zeros(own.num_rows, np.int64)
                    else:
                        code = made.setdefault(d, CapCode(d, *codes[d]))
                        row, cap = code.decode(_units(own.column("vector").to_pylist(), d))
                        row, part = np.unique(np.stack([row, code.part(cap, n)]), axis=1)
                    yield pa.RecordBatch.from_arrays([*(own.column(c).take(pa.array(row)) for c in ("label", "dim", "parts", "h", "m", "vector")), pa.array(part)], ["label", "dim", "parts", "h", "m", "vector", "part"])

    most = F.least(F.lit(LARGEST), F.greatest(F.floor(F.lit(NUMBERS) / F.col("dim")), F.lit(1)))
    rows = classes.join(small(by_label), ["dim", "label"]).withColumn("parts", F.ceil(F.col("count") / most).cast("int"))
    met = rows.select("label", "dim", "parts", "h", "m", "vector").mapInArrow(deal, "label string, dim int, parts int, h long, m long, vector binary, part long")
    key = ["label", "dim", "part"]
    large = materialize(met.where("parts > 1").groupBy(key).count().where(F.col("count") > most).select(*key, F.ceil(F.col("count") / most).cast("int").alias("cuts")), "large-parts")
    if large.isEmpty():
        met = met.withColumns({"p": F.lit(0), "q": F.lit(0), "piece": F.lit(0)})
    else:  # each piece of a large part meets each other piece, and itself, in a task of its own
        met = met.join(small(large), key, "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("h"), "cuts").cast("int"), F.lit(0)))
        met = met.withColumn("o", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("cuts"), F.lit(1)) - 1)))
        met = met.withColumns({"p": F.least("piece", "o"), "q": F.greatest("piece", "o")}).drop("o", "cuts")

    def verify(table: pa.Table) -> pa.Table:
        h, m, piece = (table.column(c).to_numpy() for c in ("h", "m", "piece"))
        part, parts, dim, p, q = (table.column(c)[0].as_py() for c in ("part", "parts", "dim", "p", "q"))
        found = Found(_units(table.column("vector").to_pylist(), dim), m, piece, cosine)
        join_caps(found, CapCode(dim, *codes[dim]), part, parts, p != q)
        some = found.some
        return pa.table({"h": h[some], "links": found.links[some], "root": h[found.root[some]]})

    key += ["p", "q"]
    return met.repartition(tasks, *key).groupBy(*key).applyInArrow(verify, "h long, links long, root long")


def near_duplicates(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` for each row."""
    every = vectors(rows, vec_id, embedding, label)
    classes = every.where("h is not null").groupBy("h").agg(F.count("*").alias("m"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("e").alias("e"))
    classes = materialize(packed(classes), "vectors")
    found = materialize(compare(classes, cosine), "links")
    parts = connected_components(found.select(F.col("h").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "h")
    links = found.groupBy("h").agg(F.sum("links").alias("links"))
    own = classes.select("h", "m").join(links, "h", "left").join(parts, "h", "left")
    own = own.select("h", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "h").alias("c"))
    placed = materialize(every.select("vec_id", "h").join(own, "h", "left").drop("h"), "members")
    lowest = placed.where("c is not null").groupBy("c").agg(F.min("vec_id").alias("low"))
    whole = placed.join(lowest, "c", "left").withColumn("component_id", F.coalesce("low", "vec_id"))
    return whole.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at cosine 0.93."""
    return near_duplicates(read(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a), k AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN k USING (vec_id)
"""
