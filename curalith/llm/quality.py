"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a rejecting predicate on a text's statistics.  A small random
sample tells what each costs and which rows it rejects; the rules then stand in
order of rejections per second, each counted behind those before it, in one CASE, so that a text which an early rule
rejects never pays for the later ones.  The verdict is the same in any order.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The ASCII white space of the contract, for trim().
SPACE = " \t\n\x0b\f\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` evaluated once: a lambda's variable is never expanded by the optimiser."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Maximal runs outside ``[\\x20\\x09-\\x0D]``; empty for a null text."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def word_chars(text: Column) -> Column:
    return F.length(F.translate(F.coalesce(text, F.lit("")), SPACE, "")).cast("bigint")


def n_symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^#*$%&|<>]+", "")).cast("bigint")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x, F.lit(SPACE)) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint")


def n_repeat_words(w: Column) -> Column:
    """Words in windows of three words that the text holds twice or more, the first occurrence included.

    Windows are told apart by a 64-bit hash.  They are sorted with their
    positions, those with an equal neighbour keep theirs, and the union of
    [p, p + 2] over the sorted positions is a sum of min(3, gap).
    """
    zero = F.lit(0).cast("bigint")

    def windows(w: Column) -> Column:
        shifted = F.arrays_zip(F.slice(w, 1, F.size(w) - 2).alias("a"), F.slice(w, 2, F.size(w) - 2).alias("b"), F.slice(w, 3, F.size(w) - 2).alias("c"))
        return F.transform(shifted, lambda t: F.xxhash64(t["a"], t["b"], t["c"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.when(i == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get(p, i - 1))))
        return F.aggregate(gaps, zero, lambda a, g: a + g)

    def repeated(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return let(
            pairs,
            lambda s: let(
                F.sort_array(F.transform(F.filter(s, lambda e, i: (e["h"] == F.get(s, i - 1)["h"]) | (e["h"] == F.get(s, i + 1)["h"])), lambda e: e["p"])),
                covered,
            ),
        )

    # most texts repeat no window; counting the distinct hashes tells so without a sort of pairs
    found = let(windows(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), zero).otherwise(F.coalesce(repeated(h), zero)))
    return F.when(F.size(w) < 3, zero).otherwise(found)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, text, the words and the base statistics of every row."""
    found = docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").withColumn("words", words(F.col("text")))
    return found.select(
        "doc_id",
        "text",
        "words",
        F.size("words").cast("bigint").alias("n_words"),
        word_chars(F.col("text")).alias("word_chars"),
        n_symbols(F.col("text")).alias("n_symbols"),
        n_dup_lines(F.col("text")).alias("n_dup_lines"),
        n_repeat_words(F.col("words")).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """``rejects`` reads text, words and the base statistics; null counts as no rejection."""

    name: str
    rejects: Callable[[], Column]


def _lines() -> Column:
    return F.filter(F.split(F.col("text"), "\n"), lambda x: F.trim(x, F.lit(SPACE)) != "")


#: Thresholds in the spirit of the published web-corpus heuristics, wide enough to leave ordinary prose alone.
RULES = [
    Rule("mean_word_length", lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 14 * F.col("n_words"))),
    Rule("symbols", lambda: 10 * F.col("n_symbols") > F.col("n_words")),
    Rule("dup_lines", lambda: let(F.size(_lines()), lambda n: (n >= 4) & (100 * F.col("n_dup_lines") > 50 * n))),
    Rule("no_letters", lambda: 100 * F.length(F.regexp_replace("text", r"[^\p{L}]+", "")) < 50 * F.col("word_chars")),
    Rule("vocabulary", lambda: let(F.size(F.array_distinct(F.col("words"))), lambda n: 100 * n < 8 * F.least(F.col("n_words"), F.lit(1000)))),
    Rule("bullets", lambda: let(_lines(), lambda x: (F.size(x) >= 4) & (100 * F.size(F.filter(x, lambda y: y.rlike(r"^\s*[-*•]"))) > 90 * F.size(x)))),
    Rule("long_word", lambda: F.exists("words", lambda w: F.length(w) > 1000)),
]


#: Each sampled row is evaluated so often when a rule is timed, and the better of two timings counts.
REPEATS = 24


def measure(docs: DataFrame, rules: list[Rule], *, sample_rows: int = 256) -> tuple[list[float], list[list[bool]]]:
    """(seconds of each rule, for each sampled row which rules reject it).

    The sample is drawn at random from the whole table, ``sample_rows`` rows on
    average, of which those that fail the base rules are left out.  A rule's
    seconds are those of a job that evaluates it, less those of one that
    evaluates nothing.  Only the order of evaluation depends on the sample,
    never a verdict.
    """
    n = docs.count()
    drawn = docs.sample(False, min(1.0, sample_rows / n), seed=11) if n else docs
    sample = statistics(drawn).where(~base_failed()).cache()
    try:
        hits = sample.select(F.array(*[F.coalesce(r.rejects(), F.lit(False)) for r in rules]).alias("hits")).collect()
        if not hits:
            return [0.0] * len(rules), []
        many = sample.crossJoin(docs.sparkSession.range(REPEATS))

        def seconds(rejects: Column) -> float:
            times = []
            for _ in range(2):
                began = time.perf_counter()
                many.agg(F.count_if(F.coalesce(rejects, F.col("id") < 0))).collect()
                times.append(time.perf_counter() - began)
            return min(times)

        idle = seconds(F.col("n_words") + F.col("id") < 0)
        return [max(seconds(r.rejects()) - idle, 1e-4) for r in rules], [h["hits"] for h in hits]
    finally:
        sample.unpersist()


def ordered(rules: list, seconds: list[float], hits: list[list[bool]]) -> list:
    """Greedily by rejections per second among the sampled rows that the rules before let pass; the cheapest first where none rejects."""
    left, order, rows = list(range(len(rules))), [], hits
    while left:
        best = min(left, key=lambda k: (-sum(h[k] for h in rows) / max(seconds[k], 1e-9), seconds[k], k))
        order.append(rules[best])
        left.remove(best)
        rows = [h for h in rows if not h[best]]
    return order


def verdict(rules: list[Rule]) -> Column:
    """True if no rule rejects.  CASE stops at the first that does."""
    out = None
    for rule in rules:
        hit = F.coalesce(rule.rejects(), F.lit(False))
        out = F.when(hit, F.lit(False)) if out is None else out.when(hit, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def apply_rules(docs: DataFrame, rules: list[Rule] = RULES, *, sample_rows: int = 256) -> DataFrame:
    """One row per row of ``docs``: the statistics, base_failed and kept.

    A null or empty text has no words, fails the base rules and isn't kept.
    Runs in one pass over the rows without a shuffle.
    """
    order = ordered(rules, *measure(docs, rules, sample_rows=sample_rows))
    found = statistics(docs).withColumn("base_failed", base_failed())
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(order))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))
