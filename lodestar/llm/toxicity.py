"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

A document is a vector over a vocabulary of words and word beginnings; all its other words are one
more term, so a vector tells how dense the vocabulary's words are. Term frequencies are parts of a
thousand words, on a log scale; document frequencies are counted over all documents.

Examples are a bounded sample of the labelled documents. Equal vectors are one entry of the index,
with the weights of its toxic and its clean examples. Entries are ordered by their heaviest term and cut
into blocks; for every term the index holds the largest weight in each block, and each block its
postings. A query bounds every block by the maxima of its terms, visits blocks from the highest bound
down and stops where no block can hold a nearer entry: the nearest are exact. They vote by
closeness; a logistic curve fitted on the examples, each judged by the others, makes the vote a probability.

Each text is read into counts once, in a written table. What goes through the driver are the sample
and the vocabulary, both bounded by parameters.

Defined cases: a null text counts as empty; a text without words has no neighbours and gets the share of toxic
ones among all labelled; words are runs of letters in lower case; labels of unknown documents and null labels are left
out, of repeated ones a toxic one counts; rows with a null id are held out, as is every remainder 0;
of rows that share an id, the one with the smallest hash of its text is learned from; ties go to the entry with the earlier vector; repeated rows score
alike; without labels of both classes every document scores the share of toxic ones (0.0 without any);
an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read, release, slices
from .quality import Logistic

#: The bounded sample: labelled documents of each class, about.
PER_CLASS = 3000
#: The vocabulary: terms at most, least chi-square between the classes and documents of one, letters of a beginning.
FEATURES, LEAST_CHI2, LEAST_DOCS, BEGINNINGS = 2000, 20.0, 5, (4, 6)
#: Neighbours that vote, those of them that are given as evidence, entries of a block, and what is added to a distance before it divides a vote.
NEIGHBOURS, EVIDENCE, BLOCK, SOFT = 15, 3, 32, 0.05
#: Words whose terms a worker remembers.
REMEMBERED = 200_000

_LETTERS = re.compile(r"[^\W\d_]+")


def terms(word: str) -> list[str]:
    """The word and its beginnings (``abcd-``)."""
    return [word, *(f"{word[:n]}-" for n in BEGINNINGS if len(word) > n)]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5, F.lit(0)) == 0


def sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """``doc_id``, ``text``, ``toxic`` of about ``PER_CLASS`` documents of each class, by hash, and how many there are of each."""
    told = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = materialize(docs.where(~held_out()).select("doc_id").distinct().join(told, "doc_id"), "labelled")
    counts = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    share = F.lit(0)
    for toxic, n in counts.items():
        share = F.when(F.col("toxic") == toxic, min(1 << 30, (PER_CLASS << 30) // n)).otherwise(share)
    ids = materialize(known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share), "chosen")  # about 2 * PER_CLASS rows
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(ids), "doc_id")
    return materialize(rows.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.max("toxic").alias("toxic")), "sample"), counts


def vocabulary(rows: DataFrame) -> list[str]:
    """The terms that tell the classes of the sample apart best."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            tally: dict[str, list[int]] = {}
            for t, toxic in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic")), strict=True):
                for f in {f for w in set(_LETTERS.findall(t.lower())) for f in terms(w)}:
                    tally.setdefault(f, [0, 0])[toxic] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), *(pa.array([v[k] for v in tally.values()], pa.int64()) for k in (0, 1))], ["f", "clean", "toxic"])

    by = rows.select("text", "toxic").mapInArrow(count, "f string, clean long, toxic long").groupBy("f").agg(F.sum("clean").cast("double").alias("clean"), F.sum("toxic").cast("double").alias("toxic"))
    n = {r[0]: float(r[1]) for r in rows.groupBy("toxic").count().collect()}
    clean, toxic = F.lit(n.get(0, 0.0)), F.lit(n.get(1, 0.0))
    seen, every = F.col("clean") + F.col("toxic"), clean + toxic
    chi2 = every * F.pow(F.col("toxic") * (clean - F.col("clean")) - F.col("clean") * (toxic - F.col("toxic")), 2) / (seen * (every - seen + 0.5) * clean * toxic)
    top = by.where(seen >= LEAST_DOCS).withColumn("chi2", chi2).where(F.col("chi2") >= LEAST_CHI2).orderBy(F.desc("chi2"), "f").limit(FEATURES)
    return sorted(r[0] for r in top.select("f").collect())


def counted(rows: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` (with ``text`` last) with, instead of the text, ``places`` and ``counts`` of the vocabulary's terms (packed), ``others`` (words without any) and ``words``."""
    shared = rows.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)})
    keep = rows.columns[:-1]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value
        known: dict[str, list[int]] = {}
        for batch in slices(batches, "text"):
            out: tuple[list, ...] = ([], [], [], [])
            for t in batch.column("text").to_pylist():
                words = Counter(_LETTERS.findall(t.lower()))
                got: dict[int, int] = {}
                others = total = 0
                for w, n in words.items():
                    at = known.get(w)
                    if at is None:
                        if len(known) > REMEMBERED:
                            known.clear()
                        at = known[w] = [place[f] for f in terms(w) if f in place]
                    total += n
                    if at:
                        for i in at:
                            got[i] = got.get(i, 0) + n
                    else:
                        others += n
                places = sorted(got)
                for column, x in zip(out, (np.array(places, np.int32).tobytes(), np.array([got[i] for i in places], np.int32).tobytes(), others, total), strict=True):
                    column.append(x)
            kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], [*keep, "places", "counts", "others", "words"])

    types = dict(rows.dtypes)
    return rows.mapInArrow(count, ", ".join([*(f"{c} {types[c]}" for c in keep), "places binary, counts binary, others long, words long"]))


def frequencies(table: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """In how many of all documents each term is, and how many documents there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, docs = np.zeros(n, np.int64), 0
        for batch in batches:
            docs += batch.num_rows
            flat = np.frombuffer(b"".join(batch.column("places").to_pylist()), np.int32)
            found += np.bincount(flat, minlength=n)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(found[at], docs))], ["place", "n"])

    got = {r[0]: r[1] for r in table.select("places").mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n")).collect()}
    df = np.zeros(n, np.int64)
    for place, seen in got.items():
        if place >= 0:
            df[place] = seen
    return df, got.get(-1, 0)


class Weights:
    """TF-IDF: unit vectors over the vocabulary and, as the last term, all other words."""

    def __init__(self, df: np.ndarray, docs: int):
        self.idf = np.append(1 + np.log((docs + 1) / (df + 1)), 1.0)

    def vector(self, places: bytes, counts: bytes, others: int, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights; none for a text without words."""
        at, n = np.frombuffer(places, np.int32).astype(np.int64), np.frombuffer(counts, np.int32).astype(np.float64)
        if others:
            at, n = np.append(at, len(self.idf) - 1), np.append(n, float(others))
        w = np.log1p(1000 * n / max(words, 1)) * self.idf[at]
        return at, w / np.sqrt((w * w).sum()) if len(w) else w


class Index:
    """A block-max inverted index over unit vectors."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], columns: int, block: int = BLOCK):
        heaviest = [(int(at[w.argmax()]), -float(w.max())) if len(at) else (columns, 0.0) for at, w in vectors]
        self.order = np.array(sorted(range(len(vectors)), key=lambda i: heaviest[i]), np.int64)
        n = -(-len(vectors) // block)
        self.most = np.zeros((columns, n))  # the largest weight of a term in a block
        self.local = np.full((columns, n), -1, np.int32)  # its row among the block's postings
        self.postings, self.members = [], []
        for b in range(n):
            own = self.order[b * block : (b + 1) * block]
            used = np.unique(np.concatenate([vectors[i][0] for i in own]))
            self.local[used, b] = np.arange(len(used))
            dense = np.zeros((len(used), len(own)))
            for k, i in enumerate(own):
                at, w = vectors[i]
                dense[self.local[at, b], k] = w
            self.most[used, b] = dense.max(1) if len(used) else 0.0
            self.postings.append(dense)
            self.members.append(own)

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray, int]:
        """The ``k`` nearest vectors (of equal ones the earlier) and their cosines, nearest first, and the blocks that were visited."""
        bound = w @ self.most[at]
        found, cosines, least, visited = np.zeros(0, np.int64), np.zeros(0), -1.0, 0
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] < least - 1e-9:
                break
            visited += 1
            rows = self.local[at, b]
            held = rows >= 0
            got = np.round(w[held] @ self.postings[b][rows[held]], 12)
            own = self.members[b]
            pick = (got >= least) & (own != without)
            found, cosines = np.concatenate([found, own[pick]]), np.concatenate([cosines, got[pick]])
            if len(found) > k:
                best = np.lexsort((found, -cosines))[:k]
                found, cosines = found[best], cosines[best]
                least = cosines[-1]
        best = np.lexsort((found, -cosines))
        return found[best], cosines[best], visited


class Model:
    """Examples, their index, and the curve from votes to probabilities."""

    def __init__(self, examples: list, weights: Weights, counts: dict[int, int]):
        self.weights = weights
        self.base = counts.get(1, 0) / max(sum(counts.values()), 1)
        chosen = Counter(r["toxic"] for r in examples)
        each = {c: counts[c] / n for c, n in chosen.items()}  # how many labelled documents an example stands for
        entries: dict[bytes, list] = {}
        for r in sorted(examples, key=lambda r: r["doc_id"]):
            at, w = weights.vector(r["places"], r["counts"], r["others"], r["words"])
            if len(at):
                entry = entries.setdefault(at.tobytes() + np.round(w, 12).tobytes(), [at, w, r["doc_id"], [0, 0]])
                entry[3][r["toxic"]] += 1
        keys = sorted(entries)
        self.ids = [entries[x][2] for x in keys]
        self.count = np.array([entries[x][3] for x in keys], np.float64).reshape(-1, 2)
        self.each = np.array([each.get(0, 0.0), each.get(1, 0.0)])
        vectors = [(entries[x][0], entries[x][1]) for x in keys]
        self.index = Index(vectors, len(weights.idf)) if vectors and len(each) == 2 else None
        self.curve = None
        if self.index:
            odds, toxic, weight = [], [], []
            for i, (at, w) in enumerate(vectors):
                for c in (0, 1):
                    if self.count[i, c]:
                        less = self.count.copy() if self.count[i].sum() > 1 else None
                        if less is not None:
                            less[i, c] -= 1
                        odds.append(self._vote(at, w, less, i if less is None else -1)[0])
                        toxic.append(float(c))
                        weight.append(self.count[i, c] * self.each[c])
            self.curve = Logistic(1, 1e-4).fit(np.array(odds)[:, None], np.array(toxic), np.array(weight), steps=400)

    def _vote(self, at: np.ndarray, w: np.ndarray, count: np.ndarray | None = None, without: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        found, cosines, _ = self.index.nearest(at, w, NEIGHBOURS, without)
        own = (self.count if count is None else count)[found] * self.each / (1 - np.minimum(cosines, 1.0) + SOFT)[:, None]
        clean, toxic = own.sum(0) + 0.5 * np.array([1 - self.base, self.base])  # a little of what is known without neighbours
        return float(np.log(toxic / clean)), found, cosines

    def score(self, places: bytes, counts: bytes, others: int, words: int) -> tuple[float, list[dict]]:
        """Probability of being toxic, and the nearest examples."""
        at, w = self.weights.vector(places, counts, others, words)
        if not self.index or not len(at):
            return self.base, []
        odds, found, cosines = self._vote(at, w)
        p = 1 / (1 + np.exp(-np.clip(self.curve.odds(np.array([[odds]]))[0], -30, 30)))
        share = lambda i: float(self.count[i, 1] / self.count[i].sum())
        return float(p), [{"doc_id": self.ids[i], "toxic": share(i), "cosine": float(c)} for i, c in zip(found[:EVIDENCE].tolist(), cosines.tolist())]


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``evidence`` for each row of ``docs``: the nearest examples (the smallest id of each vector, the share of toxic ones that have it, the cosine)."""
    chosen, counts = sample(docs.select("doc_id", "text"), labels)
    names = vocabulary(chosen) if len(counts) == 2 else []
    text = F.coalesce("text", F.lit(""))
    table = materialize(counted(docs.select("doc_id", held_out().alias("held_out"), text.alias("text")), names), "counted")
    examples = counted(chosen.select("doc_id", "toxic", "text"), names).collect()  # bounded: about 2 * PER_CLASS rows of packed counts
    model = docs.sparkSession.sparkContext.broadcast(Model(examples, Weights(*frequencies(table, len(names))), counts))
    kind = dict(docs.dtypes)["doc_id"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = model.value, {}
        for batch in batches:
            scores, evidence = [], []
            for x in zip(*(batch.column(c).to_pylist() for c in ("places", "counts", "others", "words")), strict=True):
                key = x if x[0] else bool(x[2])  # without the vocabulary's terms all vectors are alike
                got = seen.get(key) if not x[0] else None
                if got is None:
                    got = own.score(*x)
                    if not x[0]:
                        seen[key] = got
                scores.append(got[0])
                evidence.append(got[1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array(evidence, pa.list_(pa.struct([("doc_id", batch.schema.field("doc_id").type), ("toxic", pa.float64()), ("cosine", pa.float64())])))], ["doc_id", "held_out", "score", "evidence"])
        release()

    return table.mapInArrow(judge, f"doc_id {kind}, held_out boolean, score double, evidence array<struct<doc_id:{kind},toxic:double,cosine:double>>")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document and whether it is taken for toxic."""
    scored = score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
