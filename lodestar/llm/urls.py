"""URL filter: rules first, else host word segmentation and multinomial naive Bayes.

Names in hosts are split into words by a unigram Viterbi; words of the host and of the path are
the tokens of a multinomial naive Bayes. Word counts come from all page titles, labels from the
rules: every page that a rule judges teaches its verdict. Words that the rules themselves name
are no tokens, as they would only repeat the rule. A short list of words that hosts of the class
``block`` are known for is a prior: each counts as if it had been seen there some times.

Counts, totals and vocabulary are over all pages. Segmentation and scoring are joins, so no model
is held in the driver or a task: each different name in hosts brings its substrings, those that
are title words come back with their counts, and its best split is found from them; each
different url brings its tokens, which meet the table of tokens (frequent ones by a broadcast of
bounded size, the others by a shuffle).

Defined cases: a null url or one without ``://`` has an empty host and path, no rule and no
tokens (``allow``); null titles count nothing; words are up to ``LONGEST`` letters long, the
longest label that a host can have; of splits that cost the same, the one with the earlier last
cut is taken; repeated rows are judged alike (and count each); an empty table gives an empty
result; further columns are kept by ``judge`` (outputs replace their names).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, materialize, most_frequent, read, small

#: Production parameters: rules as (verdict, host, path prefix).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: The prior. Words of hosts that are filtered, and how often each counts as seen there.
SEEDS = {
    50: (
        "adult", "adults", "bet", "bets", "betting", "casino", "cialis", "escort", "gamble", "gambling", "jackpot", "pharmacy", "phish",
        "pill", "pills", "poker", "porn", "replica", "sex", "slots", "spam", "viagra", "warez", "xxx",
    ),
    6: ("ad", "ads", "cheap", "click", "clicks", "farm", "free", "loan", "loans", "seo", "track", "tracker", "tracking", "win", "winner"),
}
#: Odds from which on a url is blocked; title count that a seed has at least; longest word; tokens that are broadcast.
ODDS, KNOWN, LONGEST, FREQUENT = 20.0, 50, 63, 50_000


def host(url: Column) -> Column:
    raw = F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host_: Column, path_: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (like ``net/``) and its verdict; nulls where none does."""
    rule, verdict = F, F
    for says, name, prefix in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host_ == name) | host_.endswith(f".{name}")) & path_.startswith(prefix)
        rule, verdict = rule.when(fits, F.lit(name + prefix)), verdict.when(fits, F.lit(says))
    return rule, verdict


class Segmenter:
    """Unigram Viterbi: the most probable split of a string of letters into words. ``counts``: of the words it can hold at least."""

    def __init__(self, counts: dict[str, int], total: int):
        total = max(total, 1)
        self.cost = {w: -math.log(n / total) for w, n in counts.items()}
        self.unknown = [math.log(total) + k * math.log(20) for k in range(LONGEST + 1)]  # the longer, the less probable

    def split(self, name: str) -> list[str]:
        best, back = [0.0], [0]
        for end in range(1, len(name) + 1):
            choices = []
            for start in range(max(0, end - LONGEST), end):
                word = name[start:end]
                choices.append((best[start] + self.cost.get(word, self.unknown[end - start]), start))
            cost, start = min(choices)
            best.append(cost)
            back.append(start)
        words, end = [], len(name)
        while end:
            words.append(name[back[end] : end])
            end = back[end]
        return words[::-1]


def names_of(host_: Column) -> Column:
    """The runs of letters of a host."""
    return F.regexp_extract_all(host_, F.lit(r"(\p{L}+)"))


def path_tokens(path_: Column) -> Column:
    """Words of the path as ``p:word`` in lower case, numbers as ``p:0``."""
    words = F.regexp_extract_all(F.lower(path_), F.lit(r"([\p{L}\p{N}]+)"))
    return F.transform(words, lambda w: F.when(w.rlike(r"^\p{N}+$"), "p:0").otherwise(F.concat(F.lit("p:"), w)))


def rule_tokens(rules: tuple) -> list[str]:
    """Tokens that only repeat the rules."""
    hosts = {f"h:{w}" for _, h, _ in rules for w in h.lower().split(".")}
    return sorted(hosts | {f"p:{w}" for _, _, p in rules for w in p.lower().split("/") if w})


def word_counts(pages: DataFrame) -> DataFrame:
    """``word``, ``n``: how often each word is in the titles, seeds ``KNOWN`` times at least."""
    title = F.regexp_extract("html", r"(?is)<title[^>]*>([^<]*)", 1)
    words = pages.select(F.explode(F.split(F.lower(title), r"[^\p{L}]+")).alias("word")).where(f"word <> '' and char_length(word) <= {LONGEST}")
    seeds = pages.sparkSession.createDataFrame([(w, KNOWN) for ws in SEEDS.values() for w in ws], "word string, least long")
    counted = words.groupBy("word").agg(F.count("*").alias("n"))
    both = counted.join(F.broadcast(seeds), "word", "left").select("word", F.greatest("n", "least").alias("n"))
    there = counted.join(F.broadcast(seeds), "word", "left_semi").select("word")  # at most as many as there are seeds
    return materialize(both.unionAll(seeds.join(F.broadcast(there), "word", "left_anti").select("word", F.col("least").alias("n"))), "words")


def segment(names: DataFrame, counts: DataFrame) -> DataFrame:
    """``name``, ``words`` of the different ``names``: their most probable splits."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    size = F.char_length("name")
    at = names.withColumn("i", F.explode(F.sequence(F.lit(1), size)))
    at = at.select("name", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST), size - F.col("i") + 1)), lambda k: F.substring(F.col("name"), F.col("i"), k))).alias("word")).distinct()
    held = at.join(small(counts), "word").groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("held"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [Segmenter({x["word"]: x["n"] for x in held or ()}, total).split(name) for name, held in zip(batch.column("name").to_pylist(), batch.column("held").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(out, pa.list_(pa.string()))], ["name", "words"])

    return materialize(names.join(held, "name", "left").mapInArrow(split, "name string, words array<string>"), "segments")


def tokens_of(urls: DataFrame, segments: DataFrame, rules: tuple) -> DataFrame:
    """``id``, ``token`` for each token of ``urls`` (``id``, ``host``, ``path``): ``h:word`` and ``p:word``."""
    names = urls.select("id", F.explode(names_of(F.col("host"))).alias("name")).join(small(segments), "name")
    host_words = names.select("id", F.explode(F.transform("words", lambda w: F.concat(F.lit("h:"), w))).alias("token"))
    both = host_words.unionAll(urls.select("id", F.explode(path_tokens(F.col("path"))).alias("token")))
    return both.where(~F.col("token").isin(rule_tokens(rules)))


def fit(tokens: DataFrame, labelled: DataFrame) -> DataFrame:
    """``token``, ``seen``, ``odds`` (log-odds of block against allow) of all tokens of labelled pages and of the seeds.

    ``labelled``: ``id``, ``block`` and ``allow``, the pages of each url that a rule judges. The classes
    themselves weigh alike, and the mass of the seeds is in both, so that an unknown token says nothing.
    """
    spark = tokens.sparkSession
    seeds = spark.createDataFrame([(f"h:{w}", 0, n) for n, ws in SEEDS.items() for w in ws], "token string, allow long, block long")
    seen = tokens.join(small(labelled), "id").groupBy("token").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
    by = materialize(seen.unionAll(seeds).groupBy("token").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")), "tokens")
    prior = sum(n * len(ws) for n, ws in SEEDS.items())
    allow, block, vocabulary = by.agg(F.sum("allow"), F.sum("block"), F.count("*")).first()
    odds = F.log((F.col("block") + 1.0) / (block + vocabulary)) - F.log((F.col("allow") + 1.0) / (allow + prior + vocabulary))
    return materialize(by.select("token", (F.col("allow") + F.col("block")).alias("seen"), odds.alias("odds")), "odds")


def judge(pages: DataFrame, rules: tuple = RULES, counts: DataFrame | None = None) -> DataFrame:
    """Append ``host``, ``path``, ``rule``, ``verdict`` and ``odds`` (log-odds of block) to ``pages`` (``url``, and ``html`` where ``counts`` isn't given)."""
    counts = word_counts(pages) if counts is None else counts
    outputs = ["host", "path", "rule", "verdict", "odds"]
    rows = pages.drop(*outputs)
    kept = rows.columns
    rule, says = matched_rule(F.col("host"), F.col("path"), rules)
    id_, own = free_name([*kept, *outputs], "_id"), free_name([*kept, *outputs], "_says")
    rows = rows.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))}).withColumns({"rule": rule, own: says})
    rows = rows.withColumn(id_, F.when(F.col("host") != "", F.xxhash64("host", "path")))
    urls = rows.where(F.col(id_).isNotNull()).groupBy(F.col(id_).alias("id")).agg(
        F.first("host").alias("host"), F.first("path").alias("path"), F.count_if(F.col(own) == "block").alias("block"), F.count_if(F.col(own) == "allow").alias("allow")
    )
    urls = materialize(urls, "urls")
    names = materialize(urls.select(F.explode(names_of(F.col("host"))).alias("name")).distinct(), "names")
    tokens = materialize(tokens_of(urls, segment(names, counts), rules), "url-tokens")
    model = fit(tokens, urls.where("block + allow > 0").select("id", "block", "allow"))
    frequent = materialize(most_frequent(model, "seen", "token", FREQUENT).select("token", F.col("odds").alias("known")), "frequent")
    met = tokens.join(F.broadcast(frequent), "token", "left")  # about FREQUENT rows at most; what is left is rare
    rare = met.where("known is null").join(model.select("token", "odds"), "token").select("id", "odds")
    scored = met.where("known is not null").select("id", F.col("known").alias("odds")).unionAll(rare).groupBy(F.col("id").alias(id_)).agg(F.round(F.sum(F.col("odds").cast("decimal(38,12)")).cast("double"), 9).alias("odds"))
    out = rows.join(small(materialize(scored, "url-odds")), id_, "left").withColumn("odds", F.coalesce("odds", F.lit(0.0)))
    return out.withColumn("verdict", F.coalesce(own, F.when(F.col("odds") > math.log(ODDS), "block").otherwise("allow"))).select(*kept, *outputs)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url; ``odds`` is the classifier's log-odds of block."""
    pages = read(spark, sf_dir, "pages")
    judged = judge(pages.select("page_id", "url"), counts=word_counts(pages.select("html")))
    return judged.select("page_id", "host", "path", "rule", "verdict", "odds")
