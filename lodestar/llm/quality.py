"""Quality classifier: co-training of a text view and a metadata view.

A document is bad if it is labelled of low quality or toxic. The text view is a logistic
regression over words and word beginnings that are typical of bad documents (chi-square and odds
over the labelled sample, counted in Spark); words typical of good ones are left out, as a long
text has many of them whatever else it says. The metadata view is a logistic regression over what is known without
reading words: source, language, length, layout and shares of kinds of characters. Over some
rounds each view scores all unlabelled documents and labels those it is sure about (and the other
doesn't deny) for the other one to learn from. Each view is then calibrated on labelled documents that were held back, a logistic
regression over both calibrated views and the worse of them combines them, and all documents are
scored.

Only fitting uses a sample, bounded by parameters: labelled documents of each class and
pseudo-labelled ones of each view and label, by hash; each weighs as many as it stands for. Scoring is one pass over all whole texts; the model is a
few thousand weights.

Defined cases: a null text counts as empty, a null source or language as a value of its own;
labels of unknown documents and null labels are left out, repeated labels are good only if all
are; without labels of both classes every document scores 1.0 and is kept; repeated rows score
alike; rows with a null id have no label; of rows that share an id one is learned from; an empty
table gives an empty result; ``score`` keeps further columns (its outputs replace their names),
``filter_good`` keeps all columns as they are, those named like outputs of ``score`` too.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fits, free_name, materialize, read, release, slices

#: The bounded sample: labelled documents of each class, pseudo-labelled ones of each view and label (both about), code points of a labelled document that are learned from at most.
PER_CLASS, UNLABELLED, LEARN_CHARS = 6000, 4000, 100_000
#: The vocabulary, a bound of the model and not of what is scored: words and beginnings kept; least chi-square, documents and odds against the other class of one; letters of a beginning.
FEATURES, LEAST_CHI2, LEAST_DOCS, LEAST_ODDS, BEGINNINGS = 5000, 11.0, 4, 3.0, (4, 5, 7)
#: Rounds of co-training; how sure a pseudo-label must be, and what it weighs against a label.
ROUNDS, SURE, TRUST = 3, 0.97, 0.5
#: Documents with at least this probability of being good are kept.
KEEP = 0.5
#: Buckets for sources and languages.
BUCKETS = 32

_WORD = re.compile(r"[^\W\d_]+")
_SIGNS = "!|%#$&*@<>{}[]_~^=+\\/"
_UPPER = bytes(range(65, 91)) + bytes(x for x in range(0xC0, 0xDF) if x != 0xD7)
_DIGITS = b"0123456789"


def text_features(text: str | None) -> tuple[set[str], int]:
    """The different words and beginnings (``abcd-``) of a text, and its number of words."""
    words = _WORD.findall((text or "").lower())
    own = set(words)
    return own.union(*({f"{w[:n]}-" for w in own if len(w) > n} for n in BEGINNINGS)), len(words)


def metadata(text: str | None, source: str | None, lang: str | None, different: float) -> list[float]:
    """The metadata view as numbers of about 0 to 1. ``different``: share of different words."""
    t = text or ""
    n, raw = max(len(t), 1), t.encode("latin-1", "replace")
    lines = t.count("\n") + 1
    shares = [
        (len(raw) - len(raw.translate(None, _UPPER))) / n,
        (len(raw) - len(raw.translate(None, _DIGITS))) / n,
        sum(map(t.count, _SIGNS)) / n,
        (t.count(".") + t.count(",")) / n,
        t.count("!") / n,
        t.count("|") / n,
        1 - different,
    ]
    out = [np.log1p(len(t)) / 12, np.log1p(lines) / 8, np.log1p(n / lines) / 12, float(not t)]
    for x in shares:
        out += [x, x**0.5, float(x > 0.02), float(x > 0.05), float(x > 0.2), float(x > 0.5), float(x > 0.8)]
    hot = np.zeros(2 * BUCKETS)
    hot[zlib.crc32((source or "\0").encode()) % BUCKETS] = 1
    hot[BUCKETS + zlib.crc32((lang or "\0").encode()) % BUCKETS] = 1
    return [*out, *hot.tolist()]


def _told(labels: DataFrame) -> DataFrame:
    return labels.where("quality is not null or toxic is not null")


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, ``source``, ``lang``, ``bad``, ``share`` (the part of its class that is in the sample)."""
    told = _told(labels).groupBy("doc_id").agg(F.max(F.expr("cast(coalesce(quality, 1) = 0 or coalesce(toxic, 0) = 1 as int)")).alias("bad"))
    known = materialize(docs.select("doc_id").join(told, "doc_id").distinct(), "labelled")
    counts = {r[0]: r[1] for r in known.groupBy("bad").count().collect()}
    most = F.lit(0)
    for bad, n in counts.items():  # a share of the hashes, so no task sends a list of its own firsts
        most = F.when(F.col("bad") == bad, min(1 << 30, (PER_CLASS << 30) // n)).otherwise(most)
    ids = materialize(known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < most), "chosen")  # about 2 * PER_CLASS rows
    share = F.when(F.col("bad") == 1, min(1.0, PER_CLASS / max(counts.get(1, 0), 1))).when(F.col("bad") == 0, min(1.0, PER_CLASS / max(counts.get(0, 0), 1)))
    text = F.substring("text", 1, LEARN_CHARS).alias("text")
    return materialize(docs.select("doc_id", text, "source", "lang").join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"]).withColumn("share", share), "sample")


def vocabulary(told: DataFrame) -> list[str]:
    """The words and beginnings that are most typical of bad documents in the labelled sample."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            tally: dict[str, list[int]] = {}
            for t, bad in zip(*(batch.column(c).to_pylist() for c in ("text", "bad")), strict=True):
                for f in text_features(t)[0]:
                    tally.setdefault(f, [0, 0])[bad] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), *(pa.array([v[k] for v in tally.values()], pa.int64()) for k in (0, 1))], ["f", "good", "bad"])

    by = told.select("text", "bad").mapInArrow(words, "f string, good long, bad long").groupBy("f").agg(F.sum("good").cast("double").alias("good"), F.sum("bad").cast("double").alias("bad"))
    n = {r[0]: float(r[1]) for r in told.groupBy("bad").count().collect()}
    g, b = F.lit(n.get(0, 0.0)), F.lit(n.get(1, 0.0))
    seen, all_ = F.col("good") + F.col("bad"), g + b
    chi2 = all_ * F.pow(F.col("bad") * (g - F.col("good")) - F.col("good") * (b - F.col("bad")), 2) / (seen * (all_ - seen + 0.5) * g * b)
    odds = (F.col("bad") + 0.5) * g / ((F.col("good") + 0.5) * b)
    top = by.where((seen >= LEAST_DOCS) & (odds >= LEAST_ODDS)).withColumn("chi2", chi2).where(F.col("chi2") >= LEAST_CHI2).orderBy(F.desc("chi2"), "f").limit(FEATURES)
    return sorted(r[0] for r in top.select("f").collect())


class Flags:
    """A matrix of zeros and ones, as the places of the ones in each row."""

    __array_ufunc__ = None  # numpy leaves ``vector @ flags`` to us

    def __init__(self, rows: list[list[int]], columns: int):
        self.rows, self.shape = rows, (len(rows), columns)
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.column = np.array([c for r in rows for c in r], np.int64)

    def __getitem__(self, at: np.ndarray) -> Flags:
        return Flags([self.rows[i] for i in (np.flatnonzero(at) if at.dtype == bool else at).tolist()], self.shape[1])

    def __add__(self, other: Flags) -> Flags:
        return Flags(self.rows + other.rows, self.shape[1])

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column], self.shape[0])

    def __rmatmul__(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, v[self.row], self.shape[1])


class Logistic:
    """Logistic regression with weights for rows and an L2 penalty, by scaled gradient ascent; ``least``: bound of the coefficients."""

    def __init__(self, columns: int, penalty: float, least: float = -np.inf):
        self.w, self.b, self.penalty, self.least = np.zeros(columns), 0.0, penalty, least

    def odds(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w + self.b

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 150) -> Logistic:
        self.w, self.b, weight = np.zeros(x.shape[1]), 0.0, weight / max(weight.sum(), 1e-9)
        gw, gb = np.full(x.shape[1], 1e-8), 1e-8
        for i in range(steps):
            error = weight * (y - 1 / (1 + np.exp(-np.clip(self.odds(x), -30, 30))))
            dw, db = error @ x - self.penalty * self.w, error.sum()
            gw, gb = 0.95 * gw + 0.05 * dw**2, 0.95 * gb + 0.05 * db**2
            rate = 0.2 / (1 + i / 30)
            self.w = np.maximum(self.w + rate * dw / np.sqrt(gw), self.least)
            self.b += rate * db / gb**0.5
        return self


def _joined(odds: np.ndarray) -> np.ndarray:
    odds = np.clip(odds, -8, 8)
    return np.concatenate([odds, odds.max(1, keepdims=True)], 1)


def _sure(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def co_train(views: list[Flags | np.ndarray], bad: np.ndarray, weight: np.ndarray, held: np.ndarray, exchange: Callable) -> dict:
    """Both views, their calibration and their combination. ``held``: held back to calibrate on. ``exchange(models, scales)``: for each view, what the other one tells it: rows of the view, labels, weights."""
    known, back = ~held, held
    models = [Logistic(x.shape[1], 1e-4, 0.0 if isinstance(x, Flags) else -np.inf) for x in views]  # signs of bad text don't argue for good
    scales: list[Logistic] = []
    given: list[tuple] = [(), ()]
    for round_ in range(ROUNDS + 1):
        scales = []
        for v, x in enumerate(views):
            rows, y, w = x[np.flatnonzero(known)], bad[known].astype(float), weight[known]
            if given[v]:
                more, labels, weights = given[v]
                rows = rows + more if isinstance(rows, Flags) else np.concatenate([rows, more])
                y, w = np.concatenate([y, labels]), np.concatenate([w, weights])
            models[v].fit(rows, y, w)
            scales.append(Logistic(1, 1e-4).fit(models[v].odds(x[back])[:, None], bad[back].astype(float), weight[back]))
        if round_ < ROUNDS:
            given = exchange(models, scales)
    both = _joined(np.stack([s.odds(m.odds(x)[:, None]) for s, m, x in zip(scales, models, views, strict=True)], 1))
    joint = Logistic(3, 1e-4).fit(both[back], bad[back].astype(float), weight[back])
    return {"text": models[0], "meta": models[1], "scales": scales, "joint": joint, "told": [float(g[2].sum()) if g else 0.0 for g in given]}


def _exchange(pool: DataFrame, names: int, models: list[Logistic], scales: list[Logistic]) -> list[tuple]:
    """Score all documents of ``pool`` by both views; of those that a view is sure about, a hashed sample for the other one, weighed by the inverse of its share."""
    shared = pool.sparkSession.sparkContext.broadcast([(m.w, m.b, s.w, s.b) for m, s in zip(models, scales, strict=True)])

    def sure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, meta = _views(batch.column("found").to_pylist(), batch.column("meta").to_pylist(), names)
            p = [_sure((x @ w + b) * s[0] + c) for x, (w, b, s, c) in zip((found, meta), shared.value, strict=True)]
            for v in (0, 1):
                for label, here, there in ((1.0, p[v], p[1 - v]), (0.0, 1 - p[v], 1 - p[1 - v])):
                    pick = pa.array(np.flatnonzero((here >= SURE) & (there >= 0.2)))
                    n = len(pick)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, 1 - v, np.int32)), pa.array(np.full(n, label)), *(batch.column(c).take(pick) for c in ("h", "found", "meta"))], ["to", "label", "h", "found", "meta"])

    told = pool.mapInArrow(sure, "to int, label double, h long, found binary, meta binary")
    share = {(r[0], r[1]): max(1, min(1 << 30, (UNLABELLED << 30) // r[2])) for r in told.groupBy("to", "label").count().collect()}
    if not share:
        return [(), ()]
    at = F.lit(0)
    for (to, label), most in share.items():
        at = F.when((F.col("to") == to) & (F.col("label") == label), most).otherwise(at)
    got = sorted(told.where(F.pmod("h", F.lit(1 << 30)) < at).collect())  # about 4 * UNLABELLED rows
    out = []
    for v in (0, 1):
        mine = [r for r in got if r["to"] == v]
        x = _views([r["found"] for r in mine], [r["meta"] for r in mine], names)[v] if mine else None
        out.append((x, np.array([r["label"] for r in mine]), np.array([TRUST * (1 << 30) / share[v, r["label"]] for r in mine])) if mine else ())
    return out


def _views(found: list[bytes], meta: list[bytes], names: int) -> tuple[Flags, np.ndarray]:
    columns = len(metadata("", "", "", 0.0))
    return Flags([np.frombuffer(x, np.int32).tolist() for x in found], names), np.array([np.frombuffer(x, np.float32) for x in meta]).reshape(-1, columns)


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """The model; empty where the labels don't hold both classes."""
    rows = sample(docs, labels)
    if {r[0] for r in rows.select("bad").distinct().collect()} != {0, 1}:
        return {}
    names = vocabulary(rows)
    place = {f: i for i, f in enumerate(names)}

    def views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found, meta = [], []
            for t, s, g in zip(*(batch.column(c).to_pylist() for c in ("text", "source", "lang")), strict=True):
                own, n = text_features(t)
                found.append(np.array(sorted(place[f] for f in place.keys() & own), np.int32).tobytes())
                meta.append(np.array(metadata(t, s, g, _different(own, n)), np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("bad"), batch.column("share"), pa.array(found, pa.binary()), pa.array(meta, pa.binary())], ["doc_id", "bad", "share", "found", "meta"])

    kind = "doc_id string, bad int, share double, found binary, meta binary"
    got = rows.withColumn("doc_id", F.col("doc_id").cast("string")).mapInArrow(views, kind).orderBy("doc_id").collect()
    ids = materialize(_told(labels).select(F.col("doc_id").cast("string").alias("doc_id")).distinct(), "told")
    every = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(None).cast("int").alias("bad"), F.lit(None).cast("double").alias("share"), "text", "source", "lang")
    if fits(ids):
        free = every.join(F.broadcast(ids), "doc_id", "left_anti").mapInArrow(views, kind)
    else:  # so many labels that rows are shuffled: features, not texts
        free = every.mapInArrow(views, kind).join(ids, "doc_id", "left_anti")
    pool = materialize(free.select(F.xxhash64("doc_id", "found", "meta").alias("h"), "found", "meta"), "pool")
    x, meta = _views([r["found"] for r in got], [r["meta"] for r in got], len(names))
    bad = np.array([r["bad"] for r in got])
    weight = np.array([1 / (r["share"] or 1.0) for r in got])
    held = np.array([zlib.crc32(r["doc_id"].encode()) % 10 < 3 for r in got])
    for part in (held, ~held):  # too few labels to hold some back: calibrate on what was learned from
        if set(bad[part].tolist()) != {0, 1}:
            held = np.zeros(len(got), bool)
    del got
    exchange = lambda models, scales: _exchange(pool, len(names), models, scales)
    model = co_train([x, meta], bad, weight, held, exchange) if held.any() else _small(x, meta, bad, weight, exchange)
    weights = {f: float(w) for f, w in zip(names, model["text"].w, strict=True) if w}
    release()
    return model | {"weights": weights}


def _small(x: Flags, meta: np.ndarray, bad: np.ndarray, weight: np.ndarray, exchange: Callable) -> dict:
    twice = np.tile(np.arange(len(bad)), 2)
    return co_train([x[twice], meta[twice]], bad[twice], weight[twice], np.arange(len(twice)) >= len(bad), exchange)


def _different(own: set[str], n: int) -> float:
    return sum(1 for f in own if f[-1] != "-") / n if n else 1.0


def _probabilities(docs: DataFrame, labels: DataFrame, doc_id: str) -> Column:
    """A struct ``p_text``, ``p_meta``, ``score`` for each row of ``docs``."""
    told = docs.select(F.col(doc_id).alias("doc_id"), "text", "source", "lang")
    model = docs.sparkSession.sparkContext.broadcast(fit(told, labels))

    @F.pandas_udf("struct<p_text:double,p_meta:double,score:double>")
    def probabilities(texts, sources, langs):
        return pd.DataFrame(apply(model.value, texts, sources, langs), columns=["p_text", "p_meta", "score"])

    return probabilities(*(F.coalesce(F.col(c), F.lit("")) for c in ("text", "source", "lang")))


def apply(model: dict, texts, sources, langs) -> np.ndarray:
    """``p_text``, ``p_meta``, ``score`` of each text."""
    if not model:
        return np.ones((len(texts), 3))
    weights, (a, b) = model["weights"], model["scales"]
    known = weights.keys()
    odds = np.empty((len(texts), 2))
    meta = np.empty((len(texts), len(model["meta"].w)))
    for i, (t, s, g) in enumerate(zip(texts, sources, langs, strict=True)):
        own, n = text_features(t)
        odds[i, 0] = sum(weights[f] for f in sorted(known & own)) + model["text"].b
        meta[i] = metadata(t, s, g, _different(own, n))
    odds[:, 1] = model["meta"].odds(meta)
    odds = np.stack([a.odds(odds[:, :1]), b.odds(odds[:, 1:])], 1)
    return 1 - _sure(np.concatenate([odds, model["joint"].odds(_joined(odds))[:, None]], 1))


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Append ``p_text``, ``p_meta`` (each view's calibrated probability of being good), ``score`` (both views') and ``kept``."""
    outputs = ("p_text", "p_meta", "score", "kept")
    found = free_name([*docs.columns, *outputs], "_p")
    rows = docs.withColumn(found, _probabilities(docs, labels, doc_id)).drop(*outputs)
    return rows.select(*[c for c in rows.columns if c != found], f"{found}.*").withColumn("kept", F.col("score") >= KEEP)


def filter_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Those rows of ``docs`` that score ``KEEP`` or more."""
    found = free_name(docs.columns, "_p")
    return docs.withColumn(found, _probabilities(docs, labels, doc_id)).where(F.col(f"{found}.score") >= KEEP).drop(found)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document and whether it is kept."""
    scored = score(read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), read(spark, sf_dir, "labels"))
    return scored.select("doc_id", "score", "kept", "p_text", "p_meta")
