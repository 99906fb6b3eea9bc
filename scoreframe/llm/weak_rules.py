"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes good (1) or bad (-1) or abstains (0). Expectation-maximisation treats the
true quality as hidden: it estimates the share of good rows and, for each rule and class,
how often a vote of the rule is right, from the counts of vote patterns (at most
3 ** rules rows, whatever the input). A row's posterior probability of being good replaces
the demand that every rule be passed.

The rows' counts are written to the shared folder once; the posterior is an expression
over them, so nothing is joined back.

Defined results: a missing text is empty: it has no word, no rule votes but the length
rule, and ``base_failed`` holds; equal rows get equal results; an empty table gives an empty
result; a missing id is kept; other columns are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreframe.llm.text import whole, words_of
from scoreframe.session import cut_lineage

SYMBOLS = "[#*$%&|<>]"
#: Function words of the languages at hand; at least one is expected in a dozen words of prose.
FUNCTION_WORDS = """
a and as at be by for from in is it of on or that the this to was with
au des du en est et la le les pour que qui un une
das der die ein eine für im ist mit nicht und von zu
como con de del el es las los para por se su y
""".split()

GOOD, BAD, NONE = 1, -1, 0
BELIEF = 20.0


def _count(text: Column, pattern: str) -> Column:
    """Code points of the text that the pattern of single characters takes."""
    return (F.length(text) - F.length(F.regexp_replace(text, f"{pattern}+", ""))).cast("long")


def counts(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Per row the counts the rules look at, from the whole text."""
    text = F.col("t")
    rows = docs.select(F.col(id_column).alias(id_column), whole().alias("t"))
    rows = rows.select(
        id_column, "t", words_of(text).alias("w"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    words, lines = F.col("w"), F.col("lines")
    rows = rows.select(
        id_column, F.size(words).alias("n"),
        _count(text, r"[^\x20\x09-\x0D]").alias("word_chars"), _count(text, SYMBOLS).alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(lines).cast("long").alias("n_lines"),
        _count(text, r"\p{L}").alias("n_letters"), _count(text, r"\p{Lu}").alias("n_upper"),
        F.size(F.array_intersect(words, F.array(*map(F.lit, FUNCTION_WORDS)))).alias("n_function"),
        F.when(F.size(words) >= 3, F.transform(
            F.sequence(F.lit(0), F.size(words) - 3),
            lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).alias("h"))
    # Windows in order of their hash; equal ones stand side by side. Rows without any are left alone.
    own = F.col("h")
    rows = rows.withColumn("s", F.when(
        F.size(F.array_distinct(own)) < F.size(own),
        F.sort_array(F.transform(own, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    s = F.col("s")
    rows = rows.withColumn("p", F.sort_array(F.filter(
        F.transform(s, lambda e, k: F.when(
            (e["h"] == F.get(s, k + 1)["h"]) | ((k > 0) & (e["h"] == F.get(s, F.greatest(k - 1, F.lit(0)))["h"])),
            e["i"]).otherwise(-1)),
        lambda i: i >= 0)))
    p = F.col("p")
    covered = F.aggregate(
        F.transform(p, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - i, F.lit(3)))),
        F.lit(0).cast("long"), lambda total, width: total + width)
    return rows.select(
        id_column, F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        "n_lines", "n_letters", "n_upper", F.col("n_function").cast("long").alias("n_function"))


def _vote(bad: str, good: str) -> str:
    return f"case when {bad} then {BAD} when {good} then {GOOD} else {NONE} end"


RULES = {
    "symbols": _vote("n_words > 0 and 10 * n_symbols > n_words", "n_words >= 10 and 50 * n_symbols <= n_words"),
    "repetition": _vote("n_words >= 10 and 10 * n_repeat_words > 3 * n_words",
                        "n_words >= 20 and 20 * n_repeat_words <= 3 * n_words"),
    "lines": _vote("n_lines >= 4 and 10 * n_dup_lines > 3 * n_lines", "n_lines >= 4 and n_dup_lines = 0"),
    "word_length": _vote("n_words >= 10 and (word_chars < 3 * n_words or word_chars > 10 * n_words)",
                         "n_words >= 10 and word_chars between 4 * n_words and 8 * n_words"),
    "upper": _vote("n_letters >= 20 and 10 * n_upper > 3 * n_letters", "n_letters >= 20 and 8 * n_upper <= n_letters"),
    "letters": _vote("n_words >= 10 and 10 * n_letters < 7 * word_chars", "n_words >= 10 and 10 * n_letters >= 9 * word_chars"),
    "function_words": _vote("n_words >= 30 and n_function = 0", "n_words >= 10 and n_function >= 3"),
    "length": _vote("n_words < 5", "n_words >= 50"),
}


@dataclass
class Accuracies:
    """Share of good rows, and per rule the probability of a good vote on good and on bad rows."""

    prior: float
    good: list[float]
    bad: list[float]

    def log_odds(self, votes) -> float:
        out = math.log(self.prior / (1 - self.prior))
        for vote, g, b in zip(votes, self.good, self.bad, strict=True):
            if vote:
                out += math.log(g / b) if vote == GOOD else math.log((1 - g) / (1 - b))
        return out


def estimate(patterns: list[tuple[tuple[int, ...], int]], rules: int, steps: int = 200, tolerance: float = 1e-9) -> Accuracies:
    """Expectation-maximisation over vote patterns and their counts, until nothing moves.

    It starts from the belief that prose seldom gets a bad vote and that bad text, of which
    there are many kinds, passes every second rule. Each estimate carries ``BELIEF`` rows of
    it, so a rule that never votes stays where it was.
    """
    start_prior, start_good, start_bad = 0.8, 0.99, 0.5
    model = Accuracies(start_prior, [start_good] * rules, [start_bad] * rules)
    for _ in range(steps):
        share = []
        for votes, n in patterns:
            odds = max(-500.0, min(500.0, model.log_odds(votes)))
            share.append((votes, n, 1 / (1 + math.exp(-odds))))
        total = sum(n for _, n, _ in share)
        prior = (sum(n * p for _, n, p in share) + BELIEF * start_prior) / (total + BELIEF)
        good, bad = [], []
        for j in range(rules):
            up_good = sum(n * p for v, n, p in share if v[j] == GOOD)
            any_good = sum(n * p for v, n, p in share if v[j])
            up_bad = sum(n * (1 - p) for v, n, p in share if v[j] == GOOD)
            any_bad = sum(n * (1 - p) for v, n, p in share if v[j])
            good.append((up_good + BELIEF * start_good) / (any_good + BELIEF))
            bad.append((up_bad + BELIEF * start_bad) / (any_bad + BELIEF))
        new = Accuracies(prior, good, bad)
        moved = max(abs(a - b) for a, b in zip([prior, *good, *bad], [model.prior, *model.good, *model.bad], strict=True))
        model = new
        if moved < tolerance:
            break
    return model


def judge(docs: DataFrame, id_column: str = "doc_id", rules: dict[str, str] | None = None, cut: float = 0.5) -> DataFrame:
    """Counts, votes (``vote_<rule>``), ``base_failed``, ``posterior`` and ``kept`` of each row."""
    rules = RULES if rules is None else rules
    rows = cut_lineage(counts(docs, id_column)).withColumns({f"vote_{k}": F.expr(v) for k, v in rules.items()})
    votes = [f"vote_{k}" for k in rules]
    patterns = [(tuple(r[:-1]), r[-1]) for r in rows.groupBy(*votes).count().orderBy(*votes).collect()]
    model = estimate(patterns, len(votes))
    odds = F.lit(math.log(model.prior / (1 - model.prior)))
    for name, g, b in zip(votes, model.good, model.bad, strict=True):
        odds = odds + F.when(F.col(name) == GOOD, math.log(g / b)).when(F.col(name) == BAD, math.log((1 - g) / (1 - b))).otherwise(0.0)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("posterior", 1 / (1 + F.exp(-odds))).withColumn(
        "kept", ~F.col("base_failed") & (F.col("posterior") >= cut))
