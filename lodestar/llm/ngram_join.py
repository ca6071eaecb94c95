"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

The incidence matrix has a row per different set of 5-word shingles (documents with equal sets
are one row) and a column per shingle. Entries of its product with its transpose are overlap
counts. The product is computed in blocks: consecutive pairs of rows that may link make a row
block of bounded size, which one task gets. There columns are dealt to ``BLOCKS`` column blocks by
their hash; for each block the columns that pairs share are counted in numpy and added up, and
pairs below the bound that follows from the two sizes are discarded before anything is sent on.
Only entries that can reach the threshold are computed:

1. columns are ordered from rare to frequent; of each row only the first ``n - ceil(3n/4) + 1``
   columns are dealt out, as two linked rows must meet there (prefix bound);
2. rows that meet are candidates if their sizes allow it (size bound) and if enough columns are
   left behind the meeting point (position bound);
3. in the second round the product over the dealt columns alone comes first: a pair goes on only
   if that overlap and what is left behind the prefixes can reach the bound;
4. the product over all columns decides.

A column that many rows share does not give all pairs of them. First every row meets only its
columns' leaders, the rows with the fewest rare columns (the originals of groups of near copies):
its dealt columns shared with each are counted, and the ``LEADERS`` with the most are compared.
Then only rows whose components still differ meet, crowded columns in parts. So every link between
different sets is found or is implied by links that were, which is what components need. Columns
known as frequent are salted, so their rows are spread over several tasks.

The frequency order comes from all texts: each task counts the shingles it has seen more than
once, and a bounded number of the most frequent ones is sent to all tasks. It decides the order
of columns alone; any order gives the same links.

Defined cases: a null, empty or blank text has size 0 and is linked with nothing; a text of one
to four words is one shingle; repeated rows and equal texts are linked; rows that share a
``doc_id`` but are no near copies are different documents; a null ``doc_id`` takes part and never
becomes a ``component_id`` unless all ids of its component are null; an empty table gives an empty
result; further columns are not read by ``components`` and kept by ``keep_one``, whatever their
names. ``keep_one`` tells rows apart by id, text and source; rows that agree in all three are one,
blank ones too. Set keys, row keys and shingles are 64-bit hashes (the chance that any two of N
sets collide is N^2 / 2^65).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import connected_components, forget, materialize, most_frequent, read, slices, small

#: Words in a shingle; the threshold as a fraction.
WORDS, NUM, DEN = 5, 75, 100
#: Frequent shingles sent to all tasks (8 bytes each); shingles a task counts at a time; tasks a frequent column is spread over.
FREQUENT, COUNTED, SALTS = 1 << 17, 1 << 20, 16
#: Column blocks of the product; entries and pairs of a row block (a larger row is a block of its own).
BLOCKS, ENTRIES, PAIRS = 4, 1 << 20, 1 << 17
#: Leaders that a row is compared with in the first round; rows of a column that meet in one task of the second round.
LEADERS, CROWD = 2, 2000
#: Bytes of text whose shingles are made at a time.
TEXT = 1 << 20


_U = np.uint64
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD], _U)
#: Bytes of a word that are hashed side by side with other words'.
LETTERS = 48
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(29))


def _words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, one after the other, and how many each text has.

    The bytes of all texts are hashed together, one numpy step per place in a word, over the words
    that are as long; the few longer than ``LETTERS`` one by one.
    """
    raw = b"\n" + b"\n".join(t or b"" for t in texts).lower() + b"\n"  # of bytes: ASCII letters only
    a = np.frombuffer(raw, np.uint8)
    blank = _BLANK[a]
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    sizes = np.flatnonzero(~blank[:-1] & blank[1:]) + 1 - starts
    by = np.argsort(-sizes, kind="stable")
    first, size, h = starts[by], sizes[by], np.zeros(len(by), _U)
    more = len(size) - np.searchsorted(size[::-1], np.arange(LETTERS), side="right")  # words with more letters than each number
    for j, n in enumerate(more.tolist()):
        h[:n] = h[:n] * _MIX[0] + a[first[:n] + j]
    for i in range(int((size > LETTERS).sum())):
        h[i] = xxhash.xxh64_intdigest(raw[first[i] : first[i] + size[i]])
    out = np.empty_like(h)
    out[by] = _mix(h + size.astype(_U) * _MIX[1])
    ends = np.cumsum([1, *(len(t or b"") + 1 for t in texts)])
    return out, np.diff(np.searchsorted(starts, ends))


def shingles(texts: list[bytes | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text (UTF-8)."""
    h, counts = _words(texts)
    n = len(h) - WORDS + 1
    rolled = np.zeros(max(n, 0), _U)
    if n > 0:
        for i in range(WORDS):
            rolled += h[i : i + n] * _MIX[i]
        rolled = _mix(rolled)
    out, at = [], 0
    for x in counts.tolist():
        if x >= WORDS:
            s = np.sort(rolled[at : at + x - WORDS + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        else:
            out.append(_mix((h[at : at + x] * _MIX[:x]).sum(keepdims=True, dtype=_U) + _U(x)) if x else np.zeros(0, _U))
        at += x
    return out


def set_key(s: np.ndarray) -> int:
    raw = s.tobytes()
    return xxhash.xxh64_intdigest(raw) - (1 << 63)


def _long(values) -> pa.Array:
    return pa.array(np.asarray(values, np.int64))


def row_key(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> Column:
    """One 64-bit number for the id, text and source (if there is one) of a row; nulls differ from all values."""
    own = [F.col(c) for c in (doc_id, text, source) if c in docs.columns]
    return F.xxhash64(*own, *(c.isNull() for c in own))


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id``, ``row``, ``text`` as bytes."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), row_key(docs, doc_id, text).alias("row"), F.col(text).cast("binary").alias("text"))


def survey(rows: DataFrame) -> DataFrame:
    """One row per document (``doc_id``, ``row``, ``n``, ``k``), and rows ``token``, ``df`` of shingles that a task met in several sets."""
    names = ["doc_id", "row", "n", "k", "token", "df"]

    def counted(sets: list[np.ndarray]) -> pa.RecordBatch:
        token, df = np.unique(np.concatenate(sets), return_counts=True)
        token, df = token[df > 1], df[df > 1]
        none = pa.nulls(len(token), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(token.view(np.int64)), _long(df)], names)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()
        for batch in slices(batches, "text", TEXT):
            sets = shingles(batch.column("text").to_pylist())
            keys = [set_key(s) for s in sets]
            none = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays([*map(batch.column, ("doc_id", "row")), _long([len(s) for s in sets]), _long(keys), none, none], names)
            for k, s in zip(keys, sets, strict=True):
                if k not in seen and len(s):
                    seen.add(k)
                    held.append(s)
                    size += len(s)
            if size > COUNTED:
                yield counted(held)
                held, size, seen = [], 0, set()
        if held:
            yield counted(held)

    return rows.mapInArrow(look, ", ".join(f"{c} long" for c in names))


def prefixes(rows: DataFrame, frequent: np.ndarray) -> DataFrame:
    """``token``, ``k``, ``n``, ``pos``, ``cold``, ``hot`` for the prefix of each row; ``frequent``: frequent shingles, the rarest first."""
    by = np.argsort(frequent)
    known = frequent[by]
    low = _U((1 << 21) - 1)
    maybe = np.zeros(1 << 21, bool)  # by the last bits: spares most shingles the search
    maybe[known & low] = True

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, "text", TEXT):
            tokens, keys, meta = [], [], []
            for s in shingles(batch.column("text").to_pylist()):
                n = len(s)
                if not n or (k := set_key(s)) in seen:
                    continue
                seen.add(k)
                order, hot = s >> _U(1), np.zeros(n, bool)
                if len(near := np.flatnonzero(maybe[s & low])):
                    at = np.minimum(np.searchsorted(known, s[near]), len(known) - 1)
                    same = known[at] == s[near]
                    hot[near[same]] = True
                    order[near[same]] = _U(1 << 63) + by[at[same]].astype(_U)
                size = n - -(-NUM * n // DEN) + 1
                first = np.argpartition(order, size - 1)[:size] if size < n else np.arange(n)
                first = first[np.argsort(order[first])]
                tokens.append(s[first])
                keys.append(np.full(size, k, np.int64))
                cold = min(int(n - hot.sum()), 1023)
                meta.append((n << 36) | (np.arange(size, dtype=np.int64) << 11) | (cold << 1) | hot[first])
            if len(seen) > 500_000:
                seen.clear()
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(keys)), pa.array(np.concatenate(meta))], ["token", "k", "meta"])

    out = rows.select("text").mapInArrow(deal, "token long, k long, meta long")
    salt = F.when(F.col("meta").bitwiseAND(F.lit(1)) == 1, F.pmod("k", F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    return out.withColumn("salt", salt)


def _n(meta: Column) -> Column:
    return F.shiftright(meta, 36)


def _pos(meta: Column) -> Column:
    return F.shiftright(meta, 11).bitwiseAND(F.lit((1 << 25) - 1))


def _cold(meta: Column) -> Column:
    return F.shiftright(meta, 1).bitwiseAND(F.lit(1023))


def possible(a: Column, b: Column) -> Column:
    """Size bound and position bound of two rows that meet (by their ``meta``)."""
    na, nb = _n(a), _n(b)
    left = F.least(na - _pos(a), nb - _pos(b))
    return (F.least(na, nb) * DEN >= F.greatest(na, nb) * NUM) & (left * (NUM + DEN) >= (na + nb) * NUM)


def _pairs(joined: DataFrame, k: str, meta: str, other: str, other_meta: str) -> DataFrame:
    """``a``, ``b`` and their sizes; ``b`` is the one with fewer rare columns, so a pair has one form only."""
    k, meta, other, other_meta = map(F.col, (k, meta, other, other_meta))
    first, second = F.struct(_cold(meta).alias("cold"), k.alias("k"), _n(meta).alias("n")), F.struct(_cold(other_meta).alias("cold"), other.alias("k"), _n(other_meta).alias("n"))
    out = joined.select(F.greatest(first, second).alias("x"), F.least(first, second).alias("y"))
    return out.select(F.col("x.k").alias("a"), F.col("y.k").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"))


def row_blocks(pairs: DataFrame, entries: int) -> DataFrame:
    """``g``, ``k``, ``n``, ``leads``: the rows of each row block, once each, with the other rows that each is compared with (``b`` of its pairs).

    Pairs in the order of ``b`` are cut where their different rows have ``entries`` entries, or where
    they are ``PAIRS``. A ``b`` with many pairs is cut too, and is in several row blocks.
    """
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, size, held, rows, leads = TaskContext.get().partitionId() << 32, 0, 0, {}, {}

        def block() -> pa.RecordBatch:
            keys = list(rows)
            own = [leads.get(k, []) for k in keys]
            return pa.RecordBatch.from_arrays([_long(np.full(len(keys), g)), _long(keys), _long(list(rows.values())), pa.array(own, pa.list_(pa.int64()))], ["g", "k", "n", "leads"])

        for batch in batches:
            for a, b, na, nb in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "na", "nb")), strict=True):
                more = (a not in rows) * na + (b not in rows) * nb
                if rows and (size + more > entries or held >= PAIRS):
                    yield block()
                    g, size, held, rows, leads = g + 1, 0, 0, {}, {}
                    more = na + nb
                rows[a], rows[b] = na, nb
                leads.setdefault(a, []).append(b)
                size, held = size + more, held + 1
        if rows:
            yield block()

    return pairs.repartitionByRange(parts, "b", "a").sortWithinPartitions("b", "a").mapInArrow(cut, "g long, k long, n long, leads array<long>")


def overlaps(at: np.ndarray, flat: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many columns the rows ``left`` share with the rows ``right`` (in ascending order), added up over the column blocks. Row ``i`` has the columns ``flat[at[i] : at[i + 1]]``."""
    counts = np.zeros(len(left), np.int64)
    block_of, owner = flat.view(np.uint64) % _U(BLOCKS), np.repeat(np.arange(len(at) - 1), np.diff(at))
    ends = np.flatnonzero(np.diff(right)) + 1
    parts = list(zip([0, *ends.tolist()], [*ends.tolist(), len(right)], strict=True)) if len(right) else []
    for block in range(BLOCKS):
        here = block_of == block
        column = np.unique(flat[here], return_inverse=True)[1]
        start = np.searchsorted(owner[here], np.arange(len(at)))  # the entries of each row in this block
        there = np.zeros(int(column.max(initial=0)) + 1, bool)
        for first, last in parts:
            mark = column[start[right[first]] : start[right[first] + 1]]
            there[mark] = True
            rows = left[first:last]
            size = start[rows + 1] - start[rows]
            stop = np.cumsum(size)
            own = column[np.repeat(start[rows] - stop + size, size) + np.arange(size.sum())]  # the entries of all rows, one after the other
            counts[first:last] += np.bincount(np.repeat(np.arange(len(rows)), size), there[own], len(rows)).astype(np.int64)
            there[mark] = False
    return counts


def product(pairs: DataFrame, incidence: DataFrame, bound: Callable, entries: int = ENTRIES) -> DataFrame:
    """``a``, ``b``, ``na``, ``nb`` of the written ``pairs`` for which ``bound(o, na, nb)`` holds, ``o``: their entry of the product of ``incidence`` (``k``, ``columns``) and its transpose."""

    def multiply(entries: pa.Table, rows: pa.Table) -> pa.Table:
        keys, own = np.unique(entries.column("k").to_numpy(), return_index=True)  # rows that were read twice count once
        lists = entries.column("columns").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        k, leads = rows.column("k").to_numpy(), rows.column("leads").to_pylist()

        def places(wanted: np.ndarray) -> np.ndarray:
            """Where the entries of rows are; -1 for one without any."""
            if not len(keys):
                return np.full(len(wanted), -1)
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            return np.where(keys[at] == wanted, own[at], -1)

        n = np.zeros(entries.num_rows + 1, np.int64)
        n[places(k)] = rows.column("n").to_numpy()
        left = places(np.repeat(k, list(map(len, leads))))
        right = places(np.array([x for xs in leads for x in xs], np.int64))
        there = np.flatnonzero((left >= 0) & (right >= 0))
        there = there[np.argsort(right[there], kind="stable")]
        left, right = left[there], right[there]
        if len(left):
            keep = bound(overlaps(lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy(), left, right), n[left], n[right])
            left, right = left[keep], right[keep]
        key = entries.column("k").to_numpy()
        return pa.table({c: pa.array(x, pa.int64()) for c, x in (("a", key[left]), ("b", key[right]), ("na", n[left]), ("nb", n[right]))})

    nodes = materialize(row_blocks(pairs, entries), "row-blocks")
    own = small(nodes.select("g", "k")).select(F.col("g").alias("block"), F.col("k").alias("k"))
    met = incidence.join(own, "k").select("block", "k", "columns")
    return met.groupBy("block").cogroup(nodes.groupBy("g")).applyInArrow(multiply, "a long, b long, na long, nb long")


def promising(pairs: DataFrame, dealt: DataFrame) -> DataFrame:
    """Those of ``pairs`` whose overlap of dealt columns leaves the threshold within reach.

    All columns up to the end of the shorter prefix were dealt out by both rows, so beyond the
    overlap there only what a row has behind its prefix can be shared. ``dealt`` (``token``, ``k``)
    needs the columns that two rows or more have. A row's dealt columns are at most a quarter of it.
    """

    def bound(o, na, nb):
        behind = (np.maximum(na, nb) * NUM + DEN - 1) // DEN - 1  # entries behind the longer prefix
        return (o + behind) * (NUM + DEN) >= (na + nb) * NUM

    return product(pairs, dealt.groupBy("k").agg(F.collect_list("token").alias("columns")), bound, ENTRIES * DEN // (DEN - NUM))


def linked(pairs: DataFrame, rows: DataFrame, members: DataFrame) -> DataFrame:
    """Those of the different ``pairs`` (``a``, ``b``: set keys, and their sizes) that reach the threshold."""

    def incidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", TEXT):
            held = [s.view(np.int64) for s in shingles(batch.column("text").to_pylist())]
            ends = np.cumsum([0, *map(len, held)], dtype=np.int32)
            values = pa.array(np.concatenate(held)) if held else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.ListArray.from_arrays(pa.array(ends), values)], ["k", "columns"])

    def bound(o, na, nb):
        return o * DEN >= (na + nb - o) * NUM

    nodes = pairs.select(F.col("a").alias("k")).union(pairs.select(F.col("b").alias("k"))).distinct()
    own = materialize(members.groupBy("k").agg(F.min("row").alias("row")).join(nodes, "k", "left_semi"), "rows")
    texts = rows.select("row", "text").join(small(own), "row").select("k", "text")
    return product(pairs, texts.mapInArrow(incidence, "k long, columns array<long>"), bound).select("a", "b")


def placed_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id``, ``row`` (``row_key``), ``n`` and ``c`` (the component, where ``n`` is above 0) for each row of ``docs``."""
    rows = _rows(docs, doc_id, text)
    first = materialize(survey(rows), "survey")
    members = first.where("k is not null").select("doc_id", "row", "n", "k")
    counts = materialize(first.where("token is not null").groupBy("token").agg(F.sum("df").alias("df")), "frequent")
    top = most_frequent(counts, "df", "token", FREQUENT).toArrow()
    token, df = (top.column(c).to_numpy() for c in ("token", "df"))
    frequent = token[np.lexsort((token, df))].view(_U)
    forget(counts)

    alike = Window.partitionBy("token", "salt")
    meta, hot = F.col("meta"), F.col("meta").bitwiseAND(F.lit(1)) == 1
    met = prefixes(rows, frequent).withColumns({
        "lo": F.min("k").over(alike), "hi": F.max("k").over(alike), "lead": F.min(F.struct(_cold(meta).alias("cold"), "k", "meta")).over(alike),
    })
    shared = met.where((F.col("lo") < F.col("hi")) | hot).dropDuplicates(["token", "salt", "k"])
    shared = materialize(shared.select("token", "salt", "k", "meta", F.col("lead.k").alias("lead"), F.col("lead.meta").alias("lead_meta")), "columns")

    # first every row and its leader, and the leaders of a salted column and their leader
    stars = _pairs(shared.where("k <> lead").where(possible(meta, F.col("lead_meta"))), "k", "meta", "lead", "lead_meta")
    heads = shared.where("k = lead").where(hot).select("token", "k", "meta")
    tops = heads.groupBy("token").agg(F.min(F.struct(_cold(meta).alias("cold"), "k", "meta")).alias("top")).select("token", F.col("top.k").alias("top"), F.col("top.meta").alias("top_meta"))
    heads = _pairs(heads.join(tops, "token").where("k <> top").where(possible(meta, F.col("top_meta"))), "k", "meta", "top", "top_meta")
    counts = stars.unionAll(heads).groupBy("a", "b", "na", "nb").count()
    most = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("count"), "b"))
    pairs = materialize(counts.withColumn("r", most).where(F.col("r") <= LEADERS).drop("count", "r"), "pairs")
    links = materialize(linked(pairs, rows, members), "links")

    # then rows that meet while their components differ
    parts = materialize(connected_components(links).withColumnRenamed("node", "k"), "parts")
    apart = shared.select("token", "k", "meta").join(small(parts), "k", "left").withColumn("c", F.coalesce("component", "k")).drop("component")
    apart = materialize(apart, "apart")
    mixed = apart.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.ceil(F.count("*") / CROWD).cast("int").alias("cuts")).where("lo < hi").select("token", "cuts")
    apart, whole = materialize(apart.join(small(materialize(mixed, "mixed")), "token"), "apart"), apart
    forget(shared, whole)
    # a row of a crowded column is in one part of it and meets every part
    own = apart.withColumn("part", F.pmod(F.xxhash64("k"), "cuts").cast("int"))
    other = apart.select("token", F.col("k").alias("k2"), F.col("meta").alias("meta2"), F.col("c").alias("c2"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("part"))
    more = own.join(other, (own.token == other.token) & (own.part == other.part) & (F.col("c") < F.col("c2")) & possible(meta, F.col("meta2")))
    more = materialize(_pairs(more, "k", "meta", "k2", "meta2").distinct().join(pairs, ["a", "b"], "left_anti"), "pairs")
    closer = materialize(promising(more, apart), "pairs")
    links = links.unionAll(materialize(linked(closer, rows, members), "links"))

    parts = connected_components(links).withColumnRenamed("node", "k")
    placed = members.join(parts, "k", "left").withColumn("c", F.coalesce("component", "k"))
    placed = materialize(placed.select("doc_id", "row", "n", "c"), "members")
    forget(first, pairs, apart, more, closer)
    return placed


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` for each row of ``docs``."""
    placed = placed_rows(docs, doc_id, text)
    lowest = materialize(placed.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("low")), "lowest")
    whole = placed.join(small(lowest), "c", "left")
    return whole.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id (null is largest). Rows without shingles are linked with nothing."""
    placed = placed_rows(docs, doc_id, text).groupBy("c", "n", "doc_id", "row").agg(F.count("*").alias("copies"))
    first = placed.where("n > 0").groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "copies")).alias("x"))
    kept = materialize(first.select("x.row", "x.copies").unionAll(placed.where("n = 0").select("row", "copies")), "kept")
    own = "_row"
    while own in docs.columns:
        own += "_"
    rows = docs.withColumn(own, row_key(docs, doc_id, text))
    take = lambda which: rows.join(small(kept.where(which).select(F.col("row").alias(own))), own, "left_semi").select(own, *docs.columns)
    out = take("copies = 1")
    if not kept.where("copies > 1").isEmpty():  # only these have rows to drop
        out = out.unionAll(take("copies > 1").dropDuplicates([own]))
    return out.drop(own)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the shingle set and component of every document."""
    return components(read(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] ELSE list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
h AS (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)), l AS (SELECT a, b FROM h UNION ALL SELECT b, a FROM h),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b), c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM c LEFT JOIN n USING (doc_id)
"""
