"""URL filters: rules first, then naive Bayes over segmented names.

A url that a rule fits is decided by the longest such rule. For all others, host names are split into words: of
all ways to cut a name into words, the Viterbi search takes the one with the most likely words under unigram
counts. The counts come from the texts of all pages. They are never sent around: each different name spreads its
substrings, which meet the counts in a join, and brings home the few that are words.

Words of hosts and paths are the tokens of a multinomial naive Bayes model. It learns from the urls that a rule
decides, with the rule's verdict as label, and carries these verdicts on to urls that no rule fits: they are blocked
for words that keep company with blocked ones. A table of seed words can add examples to block.
:func:`held_out_accuracy` tells how well the labels of urls are met that took no part in learning. All counts are
distributed aggregations over the different (host, path) pairs; a host with a third of all pages is segmented once,
and tokens that stand in most urls meet their weights by a broadcast of hot keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .warc import join_one

RULES = {
    "com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block",
}
LONGEST_WORD = 20
SMOOTHING = 1.0
#: One in so many labelled urls, by a hash, is kept out of learning to measure accuracy.
FOLDS = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def rule_for(host: Column, path: Column, rules: Mapping[str, str] = RULES) -> Column:
    """The longest rule that fits, or null. A rule is a host and a path; it fits that host and its subdomains
    where the path starts with the rule's. Rules are a parameter of moderate length, not a table."""
    fits = []
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        name, slash, rest = rule.partition("/")
        same = (host == name) | F.endswith(host, F.lit("." + name))
        fits.append(F.when(same & F.startswith(path, F.lit(slash + rest)), F.lit(rule)))
    return F.coalesce(*fits, F.lit(None).cast("string"))


def unigrams(texts: DataFrame, text: str, seeds: DataFrame | None = None) -> DataFrame:
    """``(word, n)`` of the lower-case runs of a-z of all texts, markup left out, plus those of a table ``seeds``."""
    plain = F.lower(F.regexp_replace(F.col(text), r"<[^>]*>", " "))
    found = texts.select(F.explode(F.split(plain, "[^a-z]+")).alias("word")).where(f"word <> '' AND length(word) <= {LONGEST_WORD}")
    found = found.groupBy("word").agg(F.count("*").alias("n"))
    if seeds is None:
        return found
    return found.unionByName(seeds.select("word", F.col("n").cast("long"))).groupBy("word").agg(F.sum("n").alias("n"))


def best_cut(name: str, words: Mapping[tuple[int, int], int], total: int, longest: int = LONGEST_WORD) -> list[str]:
    """The most likely cut of a name; ``words`` has the counts of its known substrings by start and length.

    A word is as likely as its share of ``total``; an unknown string is less likely than any word, the more so
    the longer it is. Of equally likely cuts the one with the longest last word is taken.
    """
    best, came = [0.0] + [-math.inf] * len(name), [0] * (len(name) + 1)
    for end in range(1, len(name) + 1):
        for start in range(max(0, end - longest), end):
            n = words.get((start, end - start))
            score = best[start] + (math.log(n / total) if n else -math.log(total) - (end - start) * math.log(26))
            if score > best[end]:
                best[end], came[end] = score, start
    out, end = [], len(name)
    while end:
        out.append(name[came[end] : end])
        end = came[end]
    return out[::-1]


def segment(names: DataFrame, counts: DataFrame) -> DataFrame:
    """``(name, words)`` for each different name (runs of a-z) of a one-column table ``name``.

    ``counts`` is :func:`unigrams`' result, as a stored table.
    """
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] + 1
    at = F.explode(F.sequence(F.lit(1), F.length("name"))).alias("at")
    parts = names.distinct().where("name <> ''").select("name", at)
    parts = parts.select("name", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), F.length("name") - F.col("at") + 1))).alias("size"))
    parts = parts.withColumn("word", F.substring("name", F.col("at"), F.col("size")))
    parts = cut_lineage(parts)
    # Every name keeps its first letter, so names without any known word come back too.
    known = join_one(parts, counts, "word").select("name", "at", "size", "n").unionByName(
        parts.where("at = 1 AND size = 1").select("name", "at", "size", F.lit(None).cast("long").alias("n")))
    known = known.groupBy("name").agg(F.collect_list(F.struct("at", "size", "n")).alias("known"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cuts = [best_cut(name, {(r["at"] - 1, r["size"]): int(r["n"]) for r in known if not pd.isna(r["n"])}, total)
                    for name, known in zip(batch["name"], batch["known"], strict=True)]
            yield pd.DataFrame({"name": batch["name"], "words": cuts})

    return known.mapInPandas(cut, "name string, words array<string>")


def tokens(places: DataFrame, counts: DataFrame) -> DataFrame:
    """``(host, path, token, n)`` of a table of different hosts and paths: words of the segmented host and runs of
    letters of the path, marked by where they stand."""
    hosts = places.select("host").distinct()
    names = hosts.select("host", F.posexplode(F.split("host", "[^a-z]+")).alias("place", "name")).where("name <> ''")
    names = cut_lineage(names)
    cuts = cut_lineage(segment(names.select("name"), counts))
    words = names.join(cuts, "name").select("host", F.explode("words").alias("token")).groupBy("host", "token").agg(F.count("*").alias("n"))
    words = cut_lineage(words.groupBy("host").agg(F.collect_list(F.struct("token", "n")).alias("words")))
    of_host = join_one(places, words, "host").select("host", "path", F.explode("words").alias("w")).select("host", "path", "w.token", "w.n")
    of_path = places.select("host", "path", F.explode(F.split(F.lower("path"), r"[^\p{L}]+")).alias("word")).where("word <> ''")
    of_path = of_path.select("host", "path", F.concat(F.lit("/"), "word").alias("token")).groupBy("host", "path", "token").agg(F.count("*").alias("n"))
    return of_host.unionByName(of_path)


def verdict_of(rule: Column, rules: Mapping[str, str] = RULES) -> Column:
    """The verdict that goes with a rule, null without one."""
    return F.coalesce(*[F.when(rule == r, F.lit(v)) for r, v in rules.items()], F.lit(None).cast("string"))


def labelled(tokens: DataFrame, rules: Mapping[str, str] = RULES, seeds: DataFrame | None = None) -> DataFrame:
    """``tokens`` of the urls to learn from, with ``bad``: whether to block.

    A rule's verdict is the label of the urls that it decides. With ``seeds``, a table of words, a url without a rule is
    an example to block if one of its words is a seed.
    """
    verdict = verdict_of(rule_for(F.col("host"), F.col("path"), rules), rules)
    if seeds is None:
        return tokens.withColumn("bad", verdict == "block").where("bad IS NOT NULL")
    seed = seeds.select(F.col("word").alias("_word"), F.lit(True).alias("_seed")).distinct()
    marked = tokens.join(seed, F.ltrim("token", F.lit("/")) == F.col("_word"), "left")
    hit = marked.groupBy("host", "path").agg(F.max(F.coalesce("_seed", F.lit(False))).alias("_hit"))
    return tokens.join(hit, ["host", "path"]).withColumn(
        "bad", F.coalesce(verdict == "block", F.when(F.col("_hit"), F.lit(True)))).where("bad IS NOT NULL").drop("_hit")


def weights(examples: DataFrame, smoothing: float = SMOOTHING) -> tuple[DataFrame, float]:
    """Log odds ``(token, weight)`` of each token of the labelled urls for block against allow, and those of the classes.

    Without examples of both classes there are no weights and all is allowed.
    """
    urls_ = examples.groupBy("host", "path").agg(F.max("bad").alias("bad"))
    n = {r["bad"]: r["count"] for r in urls_.groupBy("bad").count().collect()}
    if len(n) < 2:
        return examples.sparkSession.createDataFrame([], "token string, weight double"), -1.0
    by = lambda bad: F.coalesce(F.sum(F.when(F.col("bad") == bad, F.col("n"))), F.lit(0)).cast("double")
    counted = cut_lineage(examples.groupBy("token").agg(by(True).alias("block"), by(False).alias("allow")))
    sums = counted.agg(F.count("*").alias("v"), F.sum("block").alias("block"), F.sum("allow").alias("allow")).first()
    log = lambda c: F.log(F.col(c) + smoothing) - math.log(sums[c] + smoothing * sums["v"])
    return cut_lineage(counted.select("token", (log("block") - log("allow")).alias("weight"))), math.log(n[True]) - math.log(n[False])


def scored(found: DataFrame, weighed: DataFrame, prior: float) -> DataFrame:
    """``(host, path, score)``: log odds for blocking of every url with a token (a stored table); tokens that no labelled
    url has count nothing."""
    known = join_one(found, weighed, "token").groupBy("host", "path").agg(F.sum(F.col("n") * F.col("weight")).alias("odds"))
    urls_ = found.select("host", "path").distinct()
    return urls_.join(known, ["host", "path"], "left").select(
        "host", "path", F.round(F.coalesce("odds", F.lit(0.0)) + prior, 9).alias("score"))


def held_out_accuracy(
    found: DataFrame, rules: Mapping[str, str] = RULES, seeds: DataFrame | None = None, smoothing: float = SMOOTHING, folds: int = FOLDS,
) -> tuple[int, float]:
    """Labelled urls in one of ``folds`` parts by a hash, and the share of them that a model of the others meets."""
    examples = cut_lineage(labelled(found, rules, seeds).withColumn("fold", F.pmod(F.crc32(F.concat("host", "path").cast("binary")), F.lit(folds))))
    held = cut_lineage(examples.where("fold = 0"))
    scores = scored(held, *weights(examples.where("fold <> 0"), smoothing))
    right = (F.col("score") > 0) == F.col("bad")
    row = scores.join(held.select("host", "path", "bad").distinct(), ["host", "path"]).agg(F.count("*"), F.avg(right.cast("int"))).first()
    return row[0], row[1] if row[0] else 0.0


def judge(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", text: str = "html", rules: Mapping[str, str] = RULES,
    seeds: DataFrame | None = None, smoothing: float = SMOOTHING,
) -> DataFrame:
    """One row per page: ``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``score``, the log odds for
    blocking (null where nothing of the url is a word).

    A null url, or one without ``://``, has an empty host and path; no rule fits it, it has no tokens and is
    allowed. Null texts count no words. A host or path of any length is cut whole; its name spreads at most
    ``LONGEST_WORD`` substrings a letter. Repeated rows are judged alike; null ids are kept; empty tables give no rows.
    ``seeds`` is an optional table ``(word, n)``, see :func:`labelled` and :func:`unigrams`.
    """
    split = cut_lineage(pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")))
    places = cut_lineage(split.select("host", "path").distinct())
    found = cut_lineage(tokens(places, cut_lineage(unigrams(pages, text, seeds))))
    scores = cut_lineage(scored(found, *weights(cut_lineage(labelled(found, rules, seeds)), smoothing)))
    rule = rule_for(F.col("host"), F.col("path"), rules)
    by_model = F.when(F.col("score") > 0, "block").otherwise("allow")
    return split.join(scores, ["host", "path"], "left").withColumn("rule", rule).select(
        "page_id", "host", "path", "rule", F.coalesce(verdict_of(F.col("rule"), rules), by_model).alias("verdict"), "score")
