"""Quality rules combined by weak supervision, in DataFrame functions alone.

Each rule votes good (1), bad (-1) or abstains (0). Expectation-maximisation
over the counts of vote patterns (at most 3 to the number of rules, whatever
the input) estimates how often each rule says good of good and bad of bad
texts; a text's posterior probability of being good decides.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, need, written

SPACE = r"[\x20\x09-\x0D]+"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_distinct", "n_marks")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """How many words lie in a 3-word window that the text has twice or more.

    Windows are sorted by hash with their places, so equal ones are neighbours;
    the places of repeated ones, sorted, cover up to three words each.
    """

    def covered(places: Column) -> Column:
        ends = F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1), p + 3) - p))
        return F.aggregate(ends, F.lit(0).cast("long"), lambda a, x: a + x)

    def among(sorted_: Column) -> Column:
        hit = F.filter(sorted_, lambda x, k: (F.get(sorted_, k - 1)["h"] == x["h"]) | (F.get(sorted_, k + 1)["h"] == x["h"]))
        return let(F.sort_array(F.transform(hit, lambda x: x["i"])), covered)

    def within(w: Column) -> Column:
        hashed = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

        def all_of(h: Column) -> Column:
            pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
            return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(F.sort_array(pairs), among))

        return F.when(F.size(w) >= 3, let(hashed, all_of)).otherwise(F.lit(0).cast("long"))

    return within(words)


def measure(text: Column) -> Column:
    """The measures of one text as a struct of longs; null counts as empty."""
    text = F.coalesce(text, F.lit(""))

    def count(pattern: str) -> Column:
        return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))

    def of_words(w: Column) -> Column:
        def of_lines(lines: Column) -> Column:
            values = [
                F.size(w), F.length(F.array_join(w, "")), count(r"[#*$%&|<>]"), F.size(lines) - F.size(F.array_distinct(lines)), repeated_words(w),
                F.size(lines), count(r"\p{Lu}"), count(r"\p{L}"), F.size(F.array_distinct(w)), count(r"[.,;:]"),
            ]
            return F.struct(*[v.cast("long").alias(n) for v, n in zip(values, MEASURES, strict=True)])

        return let(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), of_lines)

    return let(F.array_remove(F.split(text, SPACE, -1), ""), of_words)


def rules() -> dict[str, tuple[Column, Column]]:
    """name -> (when it votes good, when it votes bad), over the measures."""
    c = F.col
    words, chars, letters = F.greatest(c("n_words"), F.lit(1)), F.greatest(c("word_chars"), F.lit(1)), F.greatest(c("n_letters"), F.lit(1))
    lines = F.greatest(c("n_lines"), F.lit(1))
    return {
        "word_length": ((chars >= 3 * words) & (chars <= 10 * words), (chars < 2 * words) | (chars > 14 * words)),
        "symbols": (100 * c("n_symbols") <= chars, 20 * c("n_symbols") >= chars),
        "symbols_by_word": (100 * c("n_symbols") <= 5 * words, 100 * c("n_symbols") >= 20 * words),
        "letters": (100 * c("n_letters") >= 90 * chars, 100 * c("n_letters") < 86 * chars),
        "lines": (10 * c("n_dup_lines") <= lines, 10 * c("n_dup_lines") > 3 * lines),
        "repeats": (10 * c("n_repeat_words") <= 2 * words, 10 * c("n_repeat_words") > 4 * words),
        "capitals": (10 * c("n_upper") <= 2 * letters, 10 * c("n_upper") > 5 * letters),
        "variety": (10 * c("n_distinct") >= 3 * words, 10 * c("n_distinct") < words),
    }


def votes() -> list[Column]:
    return [F.when(bad, -1).when(good, 1).otherwise(0).cast("byte").alias(f"vote_{n}") for n, (good, bad) in rules().items()]


def odds(model: dict) -> Column:
    """Log odds of good given the votes."""
    total = F.lit(math.log(model["good"] / (1 - model["good"])))
    for name, (sure_good, sure_bad) in model["rates"].items():
        vote = F.col(f"vote_{name}")
        total = total + F.when(vote == 1, math.log(sure_good / (1 - sure_bad))).when(vote == -1, math.log((1 - sure_good) / sure_bad)).otherwise(0.0)
    return total


def fit(patterns: DataFrame, rounds: int = 30, prior: float = 20.0) -> dict:
    """Expectation-maximisation over ``vote_*`` patterns with counts ``n``.

    ``patterns`` has at most 3 ** rules rows (6,561), so its rows come to the
    driver, where a round is a few sums. The start says that most texts are
    good and that rules are right nine times of ten; ``prior`` pseudo-counts
    keep rates from 0 and 1, and a rule is never taken to be wrong more often
    than right. No rows: the start is returned.
    """
    names = [c.removeprefix("vote_") for c in patterns.columns if c.startswith("vote_")]
    rows = sorted((tuple(r[f"vote_{k}"] for k in names), r["n"]) for r in patterns.collect())
    model = {"good": 0.8, "rates": {n: (0.95, 0.8) for n in names}}
    for _ in range(rounds if rows else 0):
        seen = {k: {1: [0.0, 0.0], -1: [0.0, 0.0], 0: [0.0, 0.0]} for k in names}
        good = total = 0.0
        for pattern, n in rows:
            lift = math.log(model["good"] / (1 - model["good"]))
            for k, vote in zip(names, pattern, strict=True):
                sure_good, sure_bad = model["rates"][k]
                lift += {1: math.log(sure_good / (1 - sure_bad)), -1: math.log((1 - sure_good) / sure_bad), 0: 0.0}[vote]
            p = 1 / (1 + math.exp(-lift))
            good, total = good + n * p, total + n
            for k, vote in zip(names, pattern, strict=True):
                seen[k][vote][0] += n * p
                seen[k][vote][1] += n * (1 - p)
        rates = {}
        for k, by_vote in seen.items():
            sure_good = (by_vote[1][0] + 0.95 * prior) / (by_vote[1][0] + by_vote[-1][0] + prior)
            sure_bad = (by_vote[-1][1] + 0.8 * prior) / (by_vote[-1][1] + by_vote[1][1] + prior)
            sure_good = min(0.999, max(0.5, sure_good))
            rates[k] = (sure_good, min(0.999, max(sure_bad, 1.02 - sure_good)))
        model = {"good": min(0.99, max(0.3, (good + 0.8 * prior) / (total + prior))), "rates": rates}
    return model


def failed() -> Column:
    """Base: under 50 words, or more than half of the words in repeated 3-word windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame) -> DataFrame:
    """``doc_id``, the measures, votes, ``p_good``, ``base_failed`` and ``kept``
    of each row of ``docs``.

    Base: under 50 words, or more than half of the words in repeated 3-word
    windows, fails. Otherwise a text is kept if its posterior is at least one
    half. Null and empty texts have all measures 0 and fail; repeated and null
    keys give a row each; extra columns are ignored; an empty table gives none.
    """
    measured = need(docs, "doc_id", "text").select("doc_id", measure(F.col("text")).alias("m")).select("doc_id", "m.*")
    measured = written(measured.select("*", *votes()), "quality")
    names = [c for c in measured.columns if c.startswith("vote_")]
    patterns = written(measured.groupBy(*names).agg(F.count("*").alias("n")), "vote-patterns")
    p = 1 / (1 + F.exp(-odds(fit(patterns))))
    return measured.withColumn("p_good", p).withColumn("base_failed", failed()).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns.

    Texts are measured once for the counts of vote patterns and once more for
    the filter: writing them with their votes would save half of the time, but
    that copy of all texts would have to stay as long as the result is read.
    Null, empty and short texts go; repeated and null keys are rows of their
    own; columns of any name stay as they are; an empty table stays empty.
    """
    measured = docs.select(measure(F.col("`text`")).alias("m")).select("m.*").select(*votes())
    patterns = written(measured.groupBy(*measured.columns).agg(F.count("*").alias("n")), "vote-patterns")
    model = fit(patterns)
    discard(docs.sparkSession, patterns)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    marked = docs.select(row, measure(F.col("`text`")).alias("__m")).select("__row", "__m.*").select("__row", failed().alias("__failed"), *votes())
    return marked.where(~F.col("__failed") & (odds(model) >= 0)).select("__row.*")
