"""PII: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Kinds ``email``, ``ip``, ``card`` (Luhn) and ``phone`` are the base kinds; ``iban`` (mod-97) is
added by the method. Every whole text is scanned in one pass of Arrow batches; a row never
leaves its partition, so no key is gathered anywhere.

A span's score is raised by a word of its kind's context nearby, on either side, and lowered by a
word against it; the nearer of several words counts, and the more the nearer it is. Whole words
are compared. Base spans stay whatever their score.

Defined cases: a null text counts as empty (no spans); offsets are code points, end exclusive;
spans of different kinds may overlap and all are kept; repeated rows give repeated results; an
empty table gives an empty result; further columns are kept by ``pii_spans`` and ``redact``
(outputs replace columns of the same name); null ids are kept.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, slices

KINDS = ("email", "ip", "card", "phone", "iban")
#: So many of them, the first, are base kinds.
BASE = 4

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits begins, so the lookbehind changes no match; it and
# the possessive runs keep long runs of digits linear.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_DIGIT = re.compile(r"[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")
_WORD = re.compile(r"[^\W_]+")

#: Length of an IBAN by country (the public IBAN registry).
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28,
    "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24,
    "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26,
    "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}

#: Score of a confirmed span; code points on either side that are looked at; what a word right beside the span moves the score by (half of it at the far end).
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9}
NEAR, STEP = 40, 0.2
CONTEXT = {
    "email": "mail email e mails contact write correo courriel kontakt adresse",
    "ip": "ip ipv4 address server host adresse dirección addr",
    "card": "card cards visa mastercard credit debit karte kreditkarte carte tarjeta",
    "phone": "phone phones tel call dial fax telefon telefonnummer téléphone teléfono mobile handy",
    "iban": "iban account bank konto kontonummer compte cuenta transfer",
}
AGAINST = {"email": "example", "ip": "version release build chapter section", "card": "isbn serial order tracking", "phone": "isbn serial order tracking", "iban": "serial"}
#: What moves the score by kind: word -> sign.
_SIGNS = {kind: {w: 1 for w in CONTEXT[kind].split()} | {w: -1 for w in AGAINST[kind].split()} for kind in KINDS}


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # One "@" per match, so the leftmost match of each is the run before it; no text is read twice.
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def context(text: str, start: int, end: int, kind: str) -> float:
    """What the words beside a span move its score by: the nearest word for and the nearest against it."""
    signs, best = _SIGNS[kind], {1: 0.0, -1: 0.0}
    first, last = max(0, start - NEAR), min(len(text), end + NEAR)
    for low, high, side in ((first, start, -1), (end, last, 1)):
        for m in _WORD.finditer(text[low:high].lower()):
            sign = signs.get(m[0])
            if sign is None:
                continue
            a, b = low + m.start(), low + m.end()
            if (side < 0 and a == low and a and text[a - 1].isalnum()) or (side > 0 and b == high and b < len(text) and text[b].isalnum()):
                continue  # the end of a longer word
            gap = start - b if side < 0 else a - end
            best[sign] = max(best[sign], STEP * (1 - gap / (2 * NEAR)))
    return best[1] - best[-1]


def scan(text: str | None) -> list[tuple[int, int, int, float]]:
    """Confirmed spans as (start, index of the kind, end, score), in order."""
    found: list[tuple[int, int, int]] = []
    if not text:
        return []
    if "@" in text:
        found += [(s, 0, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _NO_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_NO_DIGIT.sub("", m[0])) <= 15]
        for m in _IBAN.finditer(text):
            size, end = IBAN_LENGTH.get(m[0][:2], 0), m.start()
            for _ in range(size):
                end += 1 + (text[end : end + 1] == " ")
            if size and end <= m.end() and mod97(text[m.start() : end].replace(" ", "")):
                found.append((m.start(), 4, end))
    found.sort()
    out = []
    for start, kind, end in found:
        score = SCORE[KINDS[kind]] + context(text, start, end, KINDS[kind])
        out.append((start, kind, end, round(min(score, 1.0), 3)))
    return out


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def pii_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Append ``pii``: the spans of each text with their scores."""

    @F.pandas_udf(SPANS)
    def spans(texts):
        return texts.map(lambda t: [{"kind": KINDS[k], "start": s, "end": e, "score": x} for s, k, e, x in scan(t)])

    return docs.withColumn("pii", spans(F.coalesce(F.col(text), F.lit(""))))


def redact(docs: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """Replace every span of a base kind, whatever its score, and those of added kinds that score ``least`` or more by ``<KIND>``; overlapping spans by the first one's mark. Other texts stay as they are."""

    def masked(t):
        if t is None:
            return None
        parts, done = [], 0
        for start, kind, end, score in scan(t):
            if kind < BASE or score >= least:
                if start >= done:
                    parts += [t[done:start], f"<{KINDS[kind].upper()}>"]
                done = max(done, end)
        return "".join([*parts, t[done:]]) if parts else t

    @F.pandas_udf("string")
    def mask(texts):
        return texts.map(masked)

    return docs.withColumn(text, mask(F.col(text)))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the base kinds, the sha256 of their spans, and all spans, per document; ``scores`` lists the scores in the order of ``spans``."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts, hashes, spans, scores = [[], [], [], []], [], [], []
            for text in batch.column("text").to_pylist():
                found = scan(text)
                n = [0] * len(KINDS)
                for x in found:
                    n[x[1]] += 1
                for k in range(4):
                    counts[k].append(n[k])
                named = [(k, f"{KINDS[k]}:{s}:{e}") for s, k, e, _ in found]
                hashes.append(hashlib.sha256(",".join(x for k, x in named if k < 4).encode()).hexdigest())
                spans.append(",".join(x for _, x in named))
                scores.append([x[3] for x in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(hashes, pa.string()), pa.array(spans, pa.string()), pa.array(scores, pa.list_(pa.float64()))],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores"],
            )

    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(digest, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores array<double>")
