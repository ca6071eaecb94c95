"""Best-fit packing: exact-complement hashing.

How pieces can be combined depends on their lengths alone, and there are at most 4096 lengths.
So the plan is made from the histogram of lengths (one bounded aggregation): single, pair and
triple sums of the available lengths are indexed (``SumIndex``); those that fill a gap exactly are
looked up and consumed as many times as the availability counts allow, then what is left is filled best-fit. The plan is a list
of patterns with multiplicities; every piece finds its place from its rank within its length.
Ranks come from windows over (length, salt), so a length that a third of the rows share is
spread over many tasks.

Defined cases: a null text counts as empty and has the final id only; a document longer than a
sequence is cut into full pieces and a rest; repeated rows are packed each on its own; an empty
table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, memory, read, slices

#: Production parameters: tokens in a sequence, the id that ends a document.
SEQUENCE, END = 4096, 1
#: Bytes of parts of texts, and of their ids, that a worker remembers (objects included; twice as many at most); parts encoded at a time; bytes of text in a slice.
REMEMBER, AT_ONCE, TEXT = 64 << 20, 4096, 2 << 20


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: How the tokenizer cuts lower-case Latin-1 text: contractions, letters, single digits, other signs.
_LETTER, _NUMBER, _BLANK = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_BLANK}{_LETTER}{_NUMBER}]+")


class WordEncoder:
    """Ids of whole texts as little-endian bytes, part by part.

    The tokenizer lower-cases, cuts a text into parts and drops white space; a text's ids are
    those of its parts in turn. Parts are encoded many at a time, cut where a token ends a part,
    and remembered within a bound in bytes: when it is reached, only what is asked for again stays. Text beyond Latin-1
    goes word by word (at white space); one with a special token's string or with a character that
    Python, but not the tokenizer, takes for white space is encoded whole. So is every text if the
    tokenizer doesn't work this way, which a set of probes tells.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.before, self.held = Tokenizer.from_file(path), {}, {}, 0
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.by_parts = True
        try:
            self.by_parts = all(self.encode([t])[0] == self._whole(t) for t in PROBES)
        except (ValueError, KeyError):
            self.by_parts = False

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _remember(self, parts: list[str], ids: list[bytes]) -> None:
        self.known.update(zip(parts, ids, strict=True))
        self.held += 250 * len(parts) + sum(map(len, parts)) + sum(map(len, ids))

    def _learn(self, parts: list[str]) -> None:
        for start in range(0, len(parts), AT_ONCE):
            groups = [parts[i : i + 256] for i in range(start, min(start + AT_ONCE, len(parts)), 256)]
            for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                raw, cuts = ids.tobytes(), (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
                self._remember(group, [raw[a:b] for a, b in zip([0, *cuts], cuts)])

    def _learn_words(self, words: list[str]) -> None:
        for start in range(0, len(words), AT_ONCE):
            own = words[start : start + AT_ONCE]
            self._remember(own, [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(own, add_special_tokens=False)])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """``texts``: a slice, as all their new parts are encoded together."""
        cut: list[list[str] | None] = [self._cut(t) for t in texts]
        if self.held > REMEMBER:
            self.known, self.before, self.held = {}, self.known, 0
        new = set().union(*filter(None, cut)).difference(self.known)
        if again := new.intersection(self.before):
            self._remember(list(again), [self.before[p] for p in again])
            new -= again
        words = [p for p in new if p[0] == " "]
        self._learn(list(new.difference(words)))
        self._learn_words(words)
        ids = self.known.__getitem__
        return [self._whole(t) if parts is None else b"".join(map(ids, parts)) for t, parts in zip(texts, cut, strict=True)]

    def _cut(self, text: str | None) -> list[str] | None:
        """The parts of a text; None: to be encoded whole."""
        if not text:
            return []
        if not self.by_parts or "<|" in text:
            return None
        if _latin(text):
            return _PARTS.findall(text.lower())
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return None
        return [f" {w}" for w in text.split()]  # the space tells words from parts


#: Texts that show whether a tokenizer cuts as ``_PARTS`` does.
PROBES = ("", "a", "Don't stop, we'll go-on 12.5 (x2)!", "it's 's ''s rock'n'roll !!'s", "na\xefve \xe9\xe8 \xbd\xb2 \xdfx", "A\tb\r\nc  d\xa0e\x85f", "under_score a_b9 #1 $5.00 50%", "\u041f\u0440\u0438\u0432\u0435\u0442, \u043c\u0438\u0440 9")


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def encoder(path: str) -> WordEncoder:
    kept = memory("packing")
    if path not in kept:
        kept[path] = WordEncoder(path)
    return kept[path]


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """One row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``."""
    path = tokenizer or tokenizer_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END], "<u4").tobytes()
        for batch in slices(batches, "text", TEXT):
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(encoder(path).encode(batch.column("text").to_pylist())):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * sequence)):
                    part = ids[at : at + 4 * sequence]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


class SumIndex:
    """Lengths that are available, indexed by the sums that one, two and three of them make.

    ``have[s]`` pieces of length s are left, ``pairs[s]`` says how many pairs of lengths make s: the
    convolution of the availability vector with itself, counted down when a length runs out or its last
    but one piece goes. ``_pair[s]`` and ``_triple[s]`` hold the largest length of the best pair and triple
    of sum s. Availability only falls, so what is indexed is right until one of its lengths runs out, and
    then the next best lies below: an entry only ever moves down.
    """

    def __init__(self, counts: dict[int, int], sequence: int):
        self.have = np.zeros(sequence + 1, np.int64)
        for k, v in counts.items():
            self.have[k] = v
        there = (self.have > 0).astype(np.int64)
        every = np.rint(np.fft.irfft(np.fft.rfft(there, 4 * sequence) ** 2, 4 * sequence)).astype(np.int64)[: sequence + 1]
        twice = np.zeros(sequence + 1, np.int64)
        twice[::2] = there[: sequence // 2 + 1]
        alone = np.zeros(sequence + 1, np.int64)
        alone[::2] = (self.have == 1)[: sequence // 2 + 1]
        self.pairs = (every + twice) // 2 - alone
        self._pair = np.arange(sequence + 1) - 1
        self._triple = np.arange(sequence + 1) - 2

    def take(self, length: int, n: int = 1) -> None:
        """``n`` pieces of a length are used up."""
        before = int(self.have[length])
        self.have[length] = after = before - n
        room = len(self.have) - length
        if before > 1 >= after and length < room:
            self.pairs[2 * length] -= 1
        if before > 0 >= after:
            others = (self.have[:room] > 0).astype(np.int64)
            self.pairs[length:] -= others

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.have[gap] > 0 else None

    def pair(self, gap: int, but: int = 0) -> tuple[int, ...] | None:
        """Two available lengths that make ``gap``, the larger one as large as can be: it is the harder one to place later. ``but``: a length of which one piece is spoken for."""
        if self.pairs[gap] <= 0:
            return None
        a = np.arange(self._pair[gap], (gap - 1) // 2, -1)
        left, right = self.have[a], self.have[gap - a]
        ok = (left > 0) & (right > 0) & ((2 * a != gap) | (left > 1))
        if not but:
            hit = int(ok.argmax())
            self._pair[gap] = a[hit]
        else:
            need = (a == but).astype(np.int64) + (gap - a == but) + 1
            ok &= ((a != but) | (left >= need)) & ((gap - a != but) | (right >= need))
            hit = int(ok.argmax()) if len(ok) else 0
            if not len(ok) or not ok[hit]:
                return None
        return (int(a[hit]), gap - int(a[hit]))

    def triple(self, gap: int) -> tuple[int, ...] | None:
        """Three available lengths that make ``gap``, the largest one as large as can be: a length and an indexed pair for the rest."""
        low = (gap + 2) // 3
        a = np.arange(self._triple[gap], low - 1, -1)
        for x in a[(self.have[a] > 0) & (self.pairs[gap - a] > 0)].tolist():
            rest = self.pair(gap - x, but=x)
            if rest:
                self._triple[gap] = x
                return (x, *rest)
        self._triple[gap] = min(int(self._triple[gap]), low - 1)
        return None

    def best_fit(self, gap: int) -> tuple[int, ...] | None:
        fits = np.flatnonzero(self.have[1 : gap + 1])
        return (int(fits[-1]) + 1,) if len(fits) else None


def plan(counts: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in a sequence) and how often each is used, from the number of pieces of each length."""
    index = SumIndex(counts, sequence)
    out: list[tuple[tuple[int, ...], int]] = []
    length = sequence
    while length > 0:
        if index.have[length] <= 0:
            length -= 1
            continue
        index.take(length)
        chosen, gap = [length], sequence - length
        while gap > 0:
            take = index.single(gap) or index.pair(gap) or index.triple(gap) or index.best_fit(gap)
            if not take:
                break
            gap -= sum(take)
            for x in take:
                index.take(x)
            chosen += take
        used = {x: chosen.count(x) for x in chosen}
        times = min((int(index.have[x]) + n) // n for x, n in used.items())
        for x, n in used.items():
            index.take(x, n * (times - 1))
        out.append((tuple(chosen), times))
    return out


def place(rows: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """Append ``sequence_id`` and ``offset`` to written ``pieces``.

    The driver gets the histogram of lengths (at most ``sequence`` rows) and sends the plan back;
    the plan's size depends on the number of lengths, not of rows.
    """
    spark = rows.sparkSession
    salts = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    made = plan({r[0]: r[1] for r in rows.groupBy("length").count().collect()}, sequence)
    slots, first = [], 0
    for chosen, times in made:
        at = 0
        for x in chosen:
            slots.append((x, times, first, at))
            at += x
        first += times
    table = np.array(slots or [(0, 0, 0, 0)], np.int64)
    table = table[np.argsort(table[:, 0], kind="stable")]
    ends = np.cumsum(table[:, 1])
    starts = ends - table[:, 1]
    own = np.searchsorted(table[:, 0], np.arange(sequence + 2))  # first slot of each length
    base = np.append(starts, ends[-1:])[own]  # pieces of smaller lengths

    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    by = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    run = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = by.select("length", "salt", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(order) - 1).join(before, ["length", "salt"])
    ranked = ranked.select(*rows.columns, (F.col("rank") + F.col("before")).cast("long").alias("rank"))

    kept = rows.columns

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = base[length] + rank
            slot = np.searchsorted(ends, at, side="right")
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(table[slot, 2] + at - starts[slot]), pa.array(table[slot, 3])],
                [*kept, "sequence_id", "offset"],
            )

    return ranked.mapInArrow(look_up, f"{', '.join(f'{n} {t}' for n, t in rows.dtypes)}, sequence_id long, offset long")


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    return place(materialize(pieces(docs, doc_id, text, tokenizer), "pieces"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return pack(read(spark, sf_dir, "documents"))
