"""Language ID: a linear-chain conditional random field over the words of code-switched text.

States are the languages. A word's score for a state is the sum of learned weights of its
features: character n-grams of two to four letters with word ends marked (the ones at the ends
are the affixes) and the word itself (the lexicon). Transitions between neighbouring words and
the start are learned with them, by gradient ascent on the conditional likelihood of a bounded
sample of labelled documents. As a labelled document has one language and could only teach never to switch,
stretches of documents of different languages are spliced to further examples. Every whole text is then labelled word by word by forward-backward;
a document's language is the one with the largest share of its words, weighed by probability.

Words of many documents are scored together: each different word of a slice once, all chains
side by side, one numpy step per position.

Defined cases: a null text, or one without letters, is ``und`` with score 0.0, as is every text
where there is nothing to learn from; letters are Unicode's (numbers like one half are none);
ties go to the first language by code point; rows with null languages are predicted but not
learned from; rows with a null id count as held out; repeated rows are predicted alike, and one of
them is learned from; an empty table gives an empty result; further columns are not read by
``identify`` and kept by ``label_words``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read, slices, small

#: The bounded sample to learn from: documents of each language at most, and of all languages together (as many of
#: each as that gives, one at least: no language is left out); code points of a document that are learned from at most.
PER_LANGUAGE, SAMPLE, LEARN_CHARS = 150, 1200, 10_000
#: For the transitions: spliced examples per document, and words of a stretch of one language in them.
SPLICES, STRETCH = 0.5, 25
#: Size of the weight table, width in letters that words are cut to pieces of, steps of the ascent, its rates for
#: weights and for the few transitions (which have further to go), decay.
TABLE, WIDTH, STEPS, RATE, MOVE_RATE, DECAY = 1 << 18, 32, 15, 0.1, 0.4, 1e-6

#: Bytes of text that are labelled at a time.
TEXT = 1 << 22

_LETTERS = re.compile(r"[^\W\d_]+")


def split(text: str | None) -> list[str]:
    """The letters of each word, in lower case; words of over ``WIDTH`` letters in pieces, so that none is cut off."""
    words = _LETTERS.findall((text or "").lower())
    if text and not text.isascii() and not all(map(str.isalpha, words)):  # numbers that are no digits, like one half
        words = [x for w in words for x in "".join(c if c.isalpha() else " " for c in w).split()]
    if any(len(w) > WIDTH for w in words):
        words = [w[i : i + WIDTH] for w in words for i in range(0, len(w), WIDTH)]
    return words


def features(words: np.ndarray) -> np.ndarray:
    """Rows of places in the weight table for an array of different words; place 0 is empty."""
    grid = np.zeros((len(words), WIDTH + 2), np.uint64)
    chars = np.ascontiguousarray(words.astype(f"U{WIDTH}")).view(np.uint32).reshape(len(words), WIDTH)
    grid[:, 1:-1] = chars
    size = (chars > 0).sum(1)
    grid[:, 0] = 2
    grid[np.arange(len(words)), size + 1] = 3
    longest = int(size.max(initial=0)) + 2
    grid = grid[:, :longest]
    out, rolled = [], grid
    for n in range(2, 5):  # n-grams, by rolling on those one letter shorter
        rolled = rolled[:, :-1] * np.uint64(0x9E3779B97F4A7C15) + grid[:, n - 1 :]
        there = grid[:, n - 1 :] > 0
        out.append(np.where(there, 1 + (_mix(rolled + np.uint64(n)) % np.uint64(TABLE - 1)), 0))
    whole = np.zeros(len(words), np.uint64)
    for i in range(longest):
        whole = np.where(grid[:, i] > 0, whole * np.uint64(0xC2B2AE3D27D4EB4F) + grid[:, i], whole)
    out.append((1 + _mix(whole) % np.uint64(TABLE - 1))[:, None])
    return np.concatenate(out, 1).astype(np.int32)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


class Chains:
    """Documents as chains of word numbers, the longest first, laid out position by position."""

    def __init__(self, lengths: np.ndarray):
        self.by = np.argsort(-lengths, kind="stable")
        lengths = lengths[self.by]
        starts = np.concatenate([[0], np.cumsum(lengths)])  # in the new order of documents
        steps = int(lengths[0]) if len(lengths) else 0
        self.active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(steps), side="right")  # documents longer than each position
        self.at = np.concatenate([[0], np.cumsum(self.active)])
        position = np.arange(starts[-1]) - np.repeat(starts[:-1], lengths)
        self.doc = np.repeat(np.arange(len(lengths)), lengths)
        self.place = self.at[position] + self.doc  # where a word (documents in the new order, one after the other) is laid out

    def marginals(self, emit: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of the states of each word, laid out, and expected transitions. ``emit``: positive scores, laid out."""
        forward, backward = np.empty_like(emit), np.empty_like(emit)
        a = None
        for t, n in enumerate(self.active.tolist()):
            e = emit[self.at[t] : self.at[t + 1]]
            a = e * start if a is None else (a[:n] @ move) * e
            a /= a.sum(1, keepdims=True)
            forward[self.at[t] : self.at[t + 1]] = a
        moves = np.zeros_like(move)
        b = np.ones((0, emit.shape[1]), emit.dtype)
        for t in range(len(self.active) - 1, -1, -1):
            n = int(self.active[t])
            own = np.ones((n, emit.shape[1]), emit.dtype)
            if len(b):
                later = b * emit[self.at[t + 1] : self.at[t + 2]]
                back = later @ move.T
                scale = back.sum(1, keepdims=True)
                f = forward[self.at[t] : self.at[t] + len(b)]
                norm = (f * back).sum(1, keepdims=True)
                moves += ((f / norm).T @ later) * move
                own[: len(b)] = back / scale
            backward[self.at[t] : self.at[t + 1]] = own
            b = own
        both = forward * backward
        return both / both.sum(1, keepdims=True), moves


def _scores(weights: np.ndarray, places: np.ndarray) -> np.ndarray:
    out = np.empty((len(places), weights.shape[1]), np.float32)
    for s in range(0, len(places), 8192):
        out[s : s + 8192] = weights[places[s : s + 8192]].sum(1)
    return out


def _positive(scores: np.ndarray) -> np.ndarray:
    return np.exp(np.maximum(scores - scores.max(1, keepdims=True), -30))


def spliced(words: list[list[str]], gold: list[int], share: float = SPLICES, stretch: int = STRETCH) -> tuple[list[list[str]], list[np.ndarray]]:
    """The documents and, for each word, its language; then stretches of documents of different languages, one after the other, as further examples."""
    states = [np.full(len(w), g) for w, g in zip(words, gold, strict=True)]
    if len(set(gold)) < 2:
        return words, states
    rng = np.random.default_rng(len(words))
    more, told = [], []
    for _ in range(int(len(words) * share)):
        chain, state, last = [], [], -1
        for _ in range(int(rng.integers(2, 5))):
            i = int(rng.integers(len(words)))
            if gold[i] == last:
                continue
            last = gold[i]
            at = int(rng.integers(max(1, len(words[i]) - stretch + 1)))
            chain += words[i][at : at + stretch]
            state += [last] * (len(chain) - len(state))
        more.append(chain)
        told.append(np.array(state))
    return words + more, states + told


class Told:
    """Examples to learn from: words with their languages, laid out as chains."""

    def __init__(self, words: list[list[str]], states: list[np.ndarray], k: int):
        self.k, self.n = k, len(words)
        number, different = pd.factorize(np.array([x for w in words for x in w], object))
        self.places = features(np.array(different, str))
        self.chains = Chains(np.array([len(w) for w in words]))
        self.laid = np.empty(len(number), np.int64)
        self.laid[self.chains.place] = _in_order(number, words, self.chains)
        self.own = np.zeros((len(different), k))
        np.add.at(self.own, (number, np.concatenate(states)), 1)
        self.moves, self.begun = np.zeros((k, k)), np.zeros(k)
        for s in states:
            np.add.at(self.moves, (s[:-1], s[1:]), 1)
            self.begun[s[0]] += 1

    def gradient(self, weights: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the conditional log-likelihood: what is there less what is expected."""
        emit = _positive(_scores(weights, self.places))
        p, moves = self.chains.marginals(emit[self.laid].astype(np.float64), np.exp(start), np.exp(move))
        expected = np.stack([np.bincount(self.laid, p[:, j], len(self.own)) for j in range(self.k)], 1)
        more, flat = self.own - expected, self.places.ravel()
        gw = np.stack([np.bincount(flat, np.repeat(more[:, j], self.places.shape[1]), TABLE).astype(np.float32) for j in range(self.k)], 1)
        gw[0] = 0
        return gw, self.begun - p[: self.chains.active[0]].sum(0), self.moves - moves


def fit(texts: list[str], labels: list[str]) -> dict:
    """Weights, start and transitions learned from documents of one language each and from splices of them."""
    names = sorted(set(labels))
    words = [split(t) for t in texts]
    gold = [names.index(x) for x, w in zip(labels, words, strict=True) if w]
    words = [w for w in words if w]
    if not words:
        return {}
    k = len(names)
    told = Told(*spliced(words, gold), k)
    weights, start, move = np.zeros((TABLE, k), np.float32), np.zeros(k), np.zeros((k, k))
    sums = [np.full_like(weights, 1e-12), np.full_like(start, 1e-12), np.full_like(move, 1e-12)]
    for _ in range(STEPS):
        gw, gs, gm = told.gradient(weights, start, move)
        steps = (gw / told.n - DECAY * weights, gs / told.n, gm / told.n)
        for x, grad, s, rate in zip((weights, start, move), steps, sums, (RATE, RATE, MOVE_RATE), strict=True):
            s += grad**2
            x += (rate * grad / np.sqrt(s)).astype(x.dtype)
        move -= move.max()
        start -= start.max()
    used = np.flatnonzero(weights.any(1))
    return {"names": names, "used": used, "weights": weights[used], "start": np.exp(start), "move": np.exp(move)}


def _in_order(number: np.ndarray, words: list[list[str]], chains: Chains) -> np.ndarray:
    """The word numbers of the documents in the order of ``chains``."""
    parts = np.split(number, np.cumsum([len(w) for w in words])[:-1])
    return np.concatenate([parts[i] for i in chains.by])


def label(texts: list[str | None], model: dict, weights: np.ndarray, each: bool = False) -> tuple[list[str], list[float], list[list[tuple]]]:
    """Language and score of each text; with ``each``, also its words' (word, language, probability)."""
    words = [split(t) for t in texts]
    full = [i for i, w in enumerate(words) if w]
    names, scores, labelled = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
    if not full or not model:
        return names, scores, labelled
    words = [words[i] for i in full]
    number, different = pd.factorize(np.array([x for w in words for x in w], object))
    emit = _positive(_scores(weights, features(np.array(different, str)))).astype(np.float32)
    chains = Chains(np.array([len(w) for w in words]))
    laid = np.empty(len(number), np.int64)
    laid[chains.place] = _in_order(number, words, chains)
    p, _ = chains.marginals(emit[laid], model["start"].astype(np.float32), model["move"].astype(np.float32))
    share = np.stack([np.bincount(chains.doc, p[chains.place, j], len(words)) for j in range(p.shape[1])], 1)
    share /= share.sum(1, keepdims=True)
    best = share.argmax(1)
    for rank, i in enumerate(chains.by.tolist()):
        names[full[i]] = model["names"][best[rank]]
        scores[full[i]] = float(min(1.0, share[rank, best[rank]]))
    if each:
        ends = np.cumsum([len(words[i]) for i in chains.by])
        for rank, i in enumerate(chains.by.tolist()):
            own = p[chains.place[ends[rank] - len(words[i]) : ends[rank]]]
            labelled[full[i]] = [(w, model["names"][j], float(x[j])) for w, j, x in zip(words[i], own.argmax(1).tolist(), own, strict=True)]
    return names, scores, labelled


def sample(docs: DataFrame) -> DataFrame:
    """The documents to learn from (``text``, ``lang``): the first ones of each language by the hash of id and text."""
    fit_ = docs.where("lang is not null and not held_out and text is not null")
    fit_ = fit_.select("lang", F.substring("text", 1, LEARN_CHARS).alias("text"), F.xxhash64("doc_id", "text").alias("h"))  # of a long text its beginning teaches
    keys = fit_.select("lang", "h").distinct()
    languages = fit_.select("lang").distinct().count()
    most = max(1, min(PER_LANGUAGE, SAMPLE // max(languages, 1)))
    order = Window.partitionBy("lang").orderBy("h")  # the limit is applied in each task before the shuffle
    chosen = keys.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).drop("r")
    return fit_.join(small(materialize(chosen, "sample")), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"]).select("text", "lang")


def learn(rows: DataFrame) -> dict:
    """The model, from the bounded sample of ``rows`` (``doc_id``, ``text``, ``lang``, ``held_out``)."""
    told = sorted(sample(rows).collect(), key=lambda r: (r["lang"], r["text"]))
    return fit([r["text"] for r in told], [r["lang"] for r in told])


def _table(model: dict) -> np.ndarray | None:
    if not model:
        return None
    out = np.zeros((TABLE, len(model["names"])), np.float32)
    out[model["used"]] = model["weights"]
    return out


def _rows(docs: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    id_ = F.col(doc_id)
    return docs.select(id_.alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), (F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4, F.lit(2)) == 2).alias("held_out"))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` for each row; documents with ``held_out`` are never learned from."""
    rows = _rows(docs, doc_id, text, lang)
    model = docs.sparkSession.sparkContext.broadcast(learn(rows))
    tables: list[np.ndarray] = []

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not tables:
            tables.append(_table(model.value))
        for batch in slices(batches, "text", TEXT):
            names, scores, _ = label(batch.column("text").to_pylist(), model.value, tables[0])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.select("doc_id", "held_out", "text").mapInArrow(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def label_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with ``words``: every word (lower case, letters only) of the text with its language and its probability."""
    model = docs.sparkSession.sparkContext.broadcast(learn(_rows(docs, doc_id, text, lang)))
    tables: list[np.ndarray] = []

    @F.pandas_udf("array<struct<word:string,lang:string,p:double>>")
    def words(texts):
        if not tables:
            tables.append(_table(model.value))
        found = label(texts.tolist(), model.value, tables[0], True)[2]
        return pd.Series([[{"word": w, "lang": g, "p": p} for w, g, p in own] for own in found], index=texts.index)

    return docs.withColumn("words", words(F.coalesce(F.col(text), F.lit(""))))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return identify(read(spark, sf_dir, "documents"))
