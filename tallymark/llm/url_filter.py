"""URL filters: rules, and a ratio of character Markov models where no rule decides.

Rules are (verdict, rule) with a rule of host and path. A rule fits its host and all subdomains if the
url's path starts with the rule's; the longest wins (of equal length the longer host, then ``block``).

The urls that a rule accepts or rejects train two Markov models of variable order: the chance of a
character is smoothed from the longest context seen down to order 0 (Witten-Bell), the order 0 by an
alphabet of 256 signs. A url's score is its log-likelihood difference per character. Three quarters of
the labelled urls (by hash) train the models, the rest calibrate the level above which a url is
allowed: the one with the fewest errors per class, in the middle if several are equal.

Everything is DataFrame expressions. Urls are counted once before they are cut up, so a url that makes
up a third of the rows is one row with a weight; chances are computed once per distinct n-gram; both
joins may be broadcast or split by adaptive execution.

Defined results: null urls and urls without ``://`` have empty host and path and are scored as they
stand (null as empty); rules that don't hold both kinds of url leave nothing to learn, and the rest is
allowed unless only rejected urls were seen; repeated rows are judged alike; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.native_grams import exploded
from tallymark.llm.shared import lower_ascii, stored

ORDER = 4
ALPHABET = 256.0
START, END = "\u0002", "\u0003"
BINS = 2000
SPREAD = 8.0

Rules = list[tuple[str, str]]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    full = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return lower_ascii(F.regexp_extract(full, pattern, 1)), F.regexp_extract(full, pattern, 2)


def matched_rule(host: Column, path: Column, rules: Rules) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits; null without one."""
    ranked = sorted(rules, key=lambda r: (-len(r[1]), -len(r[1].split("/")[0]), r[0] != "block"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in reversed(ranked):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def gram_counts(urls: DataFrame) -> DataFrame:
    """(gram, good, bad) of (signs, good, bad): counts of all n-grams up to ORDER + 1."""
    longest = exploded(urls, "signs", ORDER + 1, "gram").groupBy("gram").agg(
        F.sum("good").alias("good"), F.sum("bad").alias("bad")
    )
    ends = F.array(*[F.expr(f"right(gram, {k})") for k in range(1, ORDER + 2)])
    return longest.select(F.explode(ends).alias("gram"), "good", "bad").groupBy("gram").agg(
        F.sum("good").alias("good"), F.sum("bad").alias("bad")
    )


def gram_ratios(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """(gram, ratio) of distinct n-grams of the longest order: log chance of the last character given
    those before it, accepted less rejected."""
    contexts = counts.groupBy(F.expr("left(gram, length(gram) - 1)").alias("context")).agg(
        F.sum("good").alias("good_all"),
        F.count_if(F.col("good") > 0).alias("good_kinds"),
        F.sum("bad").alias("bad_all"),
        F.count_if(F.col("bad") > 0).alias("bad_kinds"),
    )
    tail = F.explode(F.sequence(F.lit(1), F.lit(ORDER + 1)))
    asked = grams.select("gram", tail.alias("k")).select(
        "gram",
        "k",
        F.expr("right(gram, k)").alias("end"),
        F.expr("left(right(gram, k), k - 1)").alias("context"),
    )
    seen = asked.join(counts.withColumnRenamed("gram", "end"), "end", "left").join(contexts, "context", "left")
    steps = seen.groupBy("gram").agg(
        F.array_sort(
            F.collect_list(
                F.struct("k", "good", "good_all", "good_kinds", "bad", "bad_all", "bad_kinds")
            )
        ).alias("steps")
    )

    def chance(kind: str) -> Column:
        def step(p, s):
            n, kinds = F.coalesce(s[f"{kind}_all"], F.lit(0)), s[f"{kind}_kinds"]
            return F.when(n > 0, (F.coalesce(s[kind], F.lit(0)) + kinds * p) / (n + kinds)).otherwise(p)

        return F.aggregate("steps", F.lit(1 / ALPHABET), step)

    return steps.select("gram", (F.log(chance("good")) - F.log(chance("bad"))).alias("ratio"))


def calibrated_level(scored: DataFrame) -> float | None:
    """Level for (score, good, bad) with the fewest errors per class; None without both kinds."""
    place = F.floor((F.least(F.greatest("score", F.lit(-SPREAD)), F.lit(SPREAD)) + SPREAD) / (2 * SPREAD) * BINS)
    bins = scored.groupBy(place.cast("int").alias("bin")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    every = Window.partitionBy(F.lit(0))
    below = every.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    rows = bins.select(
        "bin",
        (F.coalesce(F.sum("good").over(below), zero) / F.sum("good").over(every)).alias("lost"),
        (1 - F.coalesce(F.sum("bad").over(below), zero) / F.sum("bad").over(every)).alias("passed"),
        F.lag("bin").over(every.orderBy("bin")).alias("before"),
    )
    best = rows.select(F.round(F.col("lost") + F.col("passed"), 9).alias("wrong"), "bin", "before")
    found = best.where("wrong is not null").orderBy("wrong", "bin").first()
    if found is None:
        return None
    low = found["bin"] if found["before"] is None else (found["before"] + 1 + found["bin"]) / 2
    return low / BINS * 2 * SPREAD - SPREAD


def judge(pages: DataFrame, rules: Rules) -> DataFrame:
    """Each row of ``pages``: page_id, host, path, rule, verdict, score (null where a rule decides)."""
    host, path = host_and_path(F.col("url"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url").withColumns({"host": host, "path": path})
    own = own.withColumns({"rule": rule, "ruled": verdict})

    urls = own.groupBy("url").agg(F.count("*").alias("n"), F.first("ruled").alias("ruled"))
    said = lower_ascii(F.regexp_replace(F.coalesce("url", F.lit("")), r"(?s)^.*?://", ""))
    urls = stored(
        urls.select(
            "url",
            "ruled",
            F.concat(F.lit(START * ORDER), said, F.lit(END)).alias("signs"),
            F.when(F.col("ruled") == "allow", F.col("n")).otherwise(0).alias("good"),
            F.when(F.col("ruled") == "block", F.col("n")).otherwise(0).alias("bad"),
            (F.crc32(F.coalesce("url", F.lit("")).cast("binary")) % 4 == 0).alias("apart"),
        ),
        "urls",
    )
    kinds = urls.agg(F.sum("good"), F.sum("bad")).first()
    if not kinds[0] or not kinds[1]:
        otherwise = "block" if kinds[1] else "allow"
        return own.select(
            "page_id", "host", "path", "rule", F.coalesce("ruled", F.lit(otherwise)).alias("verdict"),
            F.lit(None).cast("double").alias("score"),
        )
    asked = urls.where("ruled is null or apart")
    grams = exploded(asked.select("url", "signs", "good", "bad"), "signs", ORDER + 1, "gram")
    counts = stored(gram_counts(urls.where("ruled is not null and not apart")), "url-grams")
    ratios = gram_ratios(grams.select("gram").distinct(), counts)
    scored = stored(
        grams.join(ratios, "gram").groupBy("url").agg(
            F.avg("ratio").alias("score"), F.first("good").alias("good"), F.first("bad").alias("bad")
        ),
        "url-scores",
    )
    level = calibrated_level(scored.where("good + bad > 0"))
    level = 0.0 if level is None else level
    rest = scored.where("good + bad = 0").select(F.col("url").alias("scored_url"), "score")
    both = own.join(rest, F.col("url").eqNullSafe(F.col("scored_url")), "left")
    learned = F.when(F.col("score") >= level, "allow").otherwise("block")
    return both.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("ruled", learned).alias("verdict"),
        F.when(F.col("ruled").isNull(), F.col("score") - level).alias("score"),
    )
