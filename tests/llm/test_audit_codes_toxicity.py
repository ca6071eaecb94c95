"""Filter interaction audit, vector codes and toxicity against brute-force versions and odd inputs."""

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF, duck_at, same_rows
from pyspark.sql import functions as F

from lodestar.llm import interaction, toxicity, vector_codes
from lodestar.llm.common import read
from lodestar.llm.registry import ORACLE_SQL, QUERIES

DOCS = "doc_id long, text string, lang string"


@pytest.mark.parametrize("name", ["op11_filter_interaction", "op12_vector_codes"])
def test_same_as_sql(spark, name):
    same_rows(QUERIES[name](spark, SF), duck_at(SF).execute(ORACLE_SQL[name]).df())


# ---------------------------------------------------------------- 11 filter interaction


def brute_audit(docs, labels):
    fails = []
    for i, text, lang in docs:
        t = text or ""
        words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", t) if w]
        own = set()
        if len(words) < 100:
            own.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            own.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t):
            own.add("C")
        if any(c in "#$%&*|" for c in t):
            own.add("D")
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs):
            own.add("E")
        told = [(q, x) for j, q, x in labels if i is not None and j == i]
        fails.append((lang or "", own, any(q == 1 for q, _ in told), any(x == 1 for _, x in told)))
    out = {}
    removed_in = Counter()
    for part in {f[0] for f in fails}:
        here = [f for f in fails if f[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = here
            for step, name in enumerate(order, 1):
                hit = [f for f in left if name in f[1]]
                earlier = set(order[: step - 1])
                out[part, order, step] = [
                    len(left) - len(hit), len(hit), sum(name in f[1] and bool(earlier & f[1]) for f in here), sum(f[1] == {name} for f in here), sum(f[2] for f in hit), sum(f[3] for f in hit),
                ]
                removed_in[part, name] += len(hit)
                left = [f for f in left if name not in f[1]]
    return {k: (*v, removed_in[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit_of(spark, docs, labels):
    d = spark.createDataFrame(docs, DOCS).withColumns({"n": F.lit(1), "mask": F.lit("x"), "part": F.lit(3), "key": F.lit(b"k"), "spread": F.lit(9), "toxic": F.lit(2)})
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("q"))
    got = interaction.audit(interaction.cells(d, lab), "ABCDE").collect()
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}


def test_audit_by_brute_force(spark):
    rng = np.random.default_rng(0)
    long = lambda k: " ".join(f"w{rng.integers(k)}" for _ in range(130))
    texts = [None, "", " \t\n", "A B C", "a" * 3000, "x " * 4000, "ÄÖ É", "a b", "#", long(500), long(20), long(10_000) + " $", long(9_000).upper(), "same text", "Same text", "w " * 99, "w " * 100]
    docs = [(int(i), texts[int(rng.integers(len(texts)))], rng.choice(["en", "de", ""]).item() if rng.random() > 0.1 else None) for i in rng.permutation(150)]
    docs += [(None, "same text", "en"), (None, "#", None), (5, "same text", "de"), (5, "same text", "de"), (0, "A B C", "en"), (0, "A B C", "en")]
    labels = [(int(i), *(None if x > 1 else int(x) for x in rng.integers(0, 3, 2))) for i in rng.integers(0, 160, 120)] + [(None, 1, 1)]
    want = brute_audit(docs, labels)
    assert audit_of(spark, docs, labels) == want and len(want) == 600 * 3


def test_audit_of_a_large_group_of_copies(spark):
    docs = [(i, "copy of one text", "en" if i % 2 else "fr") for i in range(3000)]
    got = audit_of(spark, docs, [(i, 1, 0) for i in range(3000)])
    assert got["fr", "EABCD", 1][:2] == (1, 1499) and got["en", "EABCD", 1][:2] == (0, 1500)  # the first is a French one
    assert got["en", "EABCD", 2][1] == 0 and got["fr", "EABCD", 2][1] == 1


def test_audit_of_nothing(spark):
    assert audit_of(spark, [], []) == {}
    assert len(audit_of(spark, [(1, None, None)], [])) == 600


# ---------------------------------------------------------------- 12 vector codes


VECTORS = "vec_id long, embedding array<float>, label int"


def brute_codes(rows, parts=16, entries=64, rounds=2):
    rows = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(rows[0][1]) // parts
    v = [[[int(np.floor(256 * float(np.float32(x)))) for x in r[1][p * width : (p + 1) * width]] for p in range(parts)] for r in rows]
    books = [[list(x[p]) for x in v[:entries]] for p in range(parts)]
    nearest = lambda q, book: min((sum((a - b) ** 2 for a, b in zip(q, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for x in v:
                own.setdefault(nearest(x[p], books[p])[1], []).append(x[p])
            for i, got in own.items():
                books[p][i] = [sum(c) // len(got) for c in zip(*got)]
    coded = [[nearest(x[p], books[p]) for p in range(parts)] for x in v]
    return [(r[0], r[2], [i for _, i in c], sum(d for d, _ in c)) for r, c in zip(rows, coded)], books


def test_codes_by_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.5, 32)], int(rng.integers(3)) if rng.random() > 0.2 else None) for i in rng.permutation(300)]
    rows += [(i, rows[i - 400][1], 7) for i in range(400, 430)]  # repeated vectors: ties between equal entries
    rows += [(3, [0.0] * 32, 1), (None, [0.25] * 32, 1), (500, None, 1), (501, [None] + [0.0] * 31, 1), (502, [float("nan")] * 32, 1), (503, [float("inf")] * 32, None)]
    want, books = brute_codes(list(rows))
    df = spark.createDataFrame(rows, VECTORS).withColumns({"codes": F.lit("mine"), "error": F.lit("x"), "place": F.lit(1)})
    coded, got_books = vector_codes.encode(df.repartition(4))
    assert got_books.tolist() == books
    key = lambda r: (str(r[0]), str(r[1]), r[2], r[3])
    assert sorted(((r.vec_id, r.label, r.codes, r.error) for r in coded.collect()), key=key) == sorted(want, key=key)
    sums = Counter()
    for _, label, _, error in want:
        sums[label] += error
    for limit in (1 << 30, 0):  # by a broadcast and by a salted join
        with pytest.MonkeyPatch.context() as m:
            m.setattr(vector_codes, "fits", lambda _, limit=limit: limit > 0)
            rows_ = vector_codes.label_errors(coded).collect()
        assert len(rows_) == len(want) and all(r.label_error == sums[r.label] for r in rows_)


def test_bounds_hold_the_nearest_entry():
    rng = np.random.default_rng(2)
    for scale in (3, 300, 1 << 26):
        entries = rng.integers(-scale, scale, (64, 4))
        entries[10] = entries[3]
        file = vector_codes.Approximation(entries)
        points = np.concatenate([rng.integers(-2 * scale, 2 * scale, (500, 4)), entries])
        d = ((points[:, None].astype(object) - entries[None]) ** 2).sum(-1)
        at, best = file.nearest(points)
        assert best.tolist() == d.min(1).tolist() and at.tolist() == [row.tolist().index(min(row)) for row in d]
    assert vector_codes.Approximation(rng.integers(-300, 300, (64, 4))).candidates(rng.integers(-300, 300, (500, 4))).mean() < 0.5  # most entries need no exact distance


def test_codes_of_odd_vectors(spark):
    digest = lambda rows: [tuple(r) for r in vector_codes.encode(spark.createDataFrame(rows, VECTORS))[0].collect()]
    assert digest([]) == [] and digest([(1, None, 1)]) == []
    assert digest([(1, [], 1), (2, [1.0], 1)]) == [(1, 1, [0] * 16, 0)]  # another length than the first one's is left out
    (one,) = digest([(1, [0.5, -0.5, 1e30], None)])  # neither 16 parts nor a sane size
    assert one == (1, None, [0] * 16, 0)
    far = digest([(i, [(-1.0) ** i * 1e38] * 64, 0) for i in range(3)])
    assert len(far) == 3 and all(r[3] == 0 for r in far)
    coded, books = vector_codes.encode(spark.createDataFrame([(i, [i / 7.0] * 32, 0) for i in range(9)], VECTORS))
    for r in vector_codes.decode(coded, books).collect():
        assert max(abs(x - r.vec_id / 7) for x in r.decoded) <= 1 / 256


# ---------------------------------------------------------------- 13 toxicity


def test_index_gives_the_exact_nearest():
    rng = np.random.default_rng(3)

    def vector():
        at = np.sort(rng.choice(40, int(rng.integers(1, 9)), replace=False))
        w = rng.random(len(at)).round(1) + 0.1
        return at, w / np.sqrt((w * w).sum())

    vectors = [vector() for _ in range(200)]
    vectors += vectors[:20]  # ties
    index = toxicity.Index(vectors, 40, block=8)
    dense = np.zeros((len(vectors), 40))
    for i, (at, w) in enumerate(vectors):
        dense[i, at] = w
    visited = []
    for q in [vector() for _ in range(60)] + vectors[:30]:
        full = np.zeros(40)
        full[q[0]] = q[1]
        cosines = np.round(dense @ full, 12)
        found, got, blocks = index.nearest(*q, 7)
        visited.append(blocks)
        assert np.allclose(got, np.sort(cosines)[::-1][:7], atol=1e-9)
        assert set(np.flatnonzero(cosines > got[-1] + 1e-9)) <= set(found.tolist())
        without, _, _ = index.nearest(*q, 7, without=int(found[0]))
        assert found[0] not in without
    assert np.mean(visited) < 0.6 * len(index.members)  # bounds spare blocks


def test_counts_and_frequencies_by_brute_force(spark):
    texts = ["", "Stupid STUPID clowns, a1b", "réeuxtion x_y" * 3, "no such word", "clown " * 50_000, "clown"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    names = ["clow-", "clown", "stupid", "stup-", "réeuxt-"]
    table = toxicity.counted(df, names)
    every = []
    for r in table.orderBy("doc_id").collect():
        words = re.findall(r"[^\W\d_]+", texts[r.doc_id].lower())
        tally = Counter(f for w in words for f in toxicity.terms(w) if f in names)
        every.append(tally)
        got = dict(zip((names[i] for i in np.frombuffer(r["places"], np.int32)), np.frombuffer(r["counts"], np.int32).tolist()))
        assert got == tally and r.words == len(words) and r.others == sum(not set(toxicity.terms(w)) & set(names) for w in words)
    df_, n = toxicity.frequencies(table, len(names))
    assert n == len(texts) and df_.tolist() == [sum(f in t for t in every) for f in names]


def test_scores_are_votes_of_the_nearest(spark):
    rng = np.random.default_rng(4)
    plain = [f"{a}{b}" for a in "bcdfg" for b in ("ab", "od", "im", "ul")]
    bad = ["scumbag", "moronic"]

    def text(toxic):
        words = rng.choice(plain, 60).tolist()
        return " ".join(words[:50] + rng.choice(bad, 4).tolist()) if toxic else " ".join(words)

    rows = [(i, text(i % 4 == 0)) for i in range(240)] + [(900, None), (901, " "), (None, text(True)), (902, "MORONIC scumbag!"), (5, "a repeated id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"toxic": F.lit("x"), "words": F.lit("y"), "score": F.lit(7)})
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)] + [(5, None), (77_777, 1), (None, 1), (8, 0)], "doc_id long, toxic int")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.doc_id is not None and r.doc_id < 240 and not (r.doc_id == 5 and r.score < 0.5):
            assert (r.score >= 0.5) == (r.doc_id % 4 == 0)
    by = {r.doc_id: r for r in got}
    assert by[902].score >= 0.5 and by[None].score >= 0.5 and by[900].score == by[901].score < 0.5 and by[900].evidence == []
    assert by[902].evidence[0].toxic == 1.0 and 0 < by[902].evidence[0].cosine <= 1
    assert {r.doc_id: r.score for r in toxicity.score(docs.repartition(7), labels).collect()} == {r.doc_id: r.score for r in got}  # reruns agree


def test_toxicity_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    assert {r.score for r in toxicity.score(docs, spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, toxic int")).collect()} == {1.0}
    assert toxicity.score(docs.limit(0), none).count() == 0


def test_toxicity_on_held_out_rows(spark):
    sf = SF.replace("0.001", "0.01")
    got = QUERIES["op13_toxicity"](spark, sf).join(read(spark, sf, "labels").select("doc_id", "toxic"), "doc_id").where("held_out and toxic is not null").collect()
    hits = sum(r.predicted == 1 and r.toxic == 1 for r in got)
    assert sum(r.toxic for r in got) >= 5 and hits >= 0.6 * sum(r.toxic for r in got)
    assert sum(r.predicted == 1 and r.toxic == 0 for r in got) <= 2
