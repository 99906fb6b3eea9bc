"""URL filter: host and path rules, and a character language-model ratio for the rest.

URLs a rule accepts or rejects teach two variable-order Markov models over characters. A
model's probability of a character after a context of up to ``ORDER`` characters is the
Witten-Bell mixture of the counts at that context and of the probability at the context one
character shorter, down to an even chance over all characters. A URL's score is the mean,
over its characters and its end, of the log ratio rejected to accepted. A fifth of the rule
URLs, dealt by hash, is kept out of the counts; the scores of its accepted and rejected URLs
give a mean each and a common variance, and with them the cut where rejection becomes
likelier. DataFrame functions only; counts cover every URL, equal ones are read once with
their number. Character windows are counted and joined by key; no table is forced to be
broadcast, so the session's size limit decides.

Defined results: a missing URL and one without ``://`` have empty host and path and fit no
rule; a missing one is scored as an empty text; if rules accept or reject nothing, every
other URL is allowed; equal rows get equal results; an empty table gives an empty result;
extra columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreframe.llm.text import ascii_lower
from scoreframe.session import cut_lineage

ORDER = 4
START, END = "\x02", "\x03"
ALLOW, BLOCK = "allow", "block"
Rule = tuple[str, str, str]
SYMBOLS = 256.0  # the even chance at the bottom


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def by_rules(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """(rule, verdict) of the longest rule that fits, or NULL. Rules are (verdict, host, path)."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, of_host, of_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == of_host) | host.endswith("." + of_host)) & path.startswith(of_path)
        out = F.when(fits, F.struct(F.lit(of_host + of_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def windows(urls: DataFrame, *keep: str) -> DataFrame:
    """One row for each character and the end: the character with its context before it."""
    padded = F.split(F.concat(F.lit(START * ORDER), F.col("text"), F.lit(END)), "")
    # a column of its own, used twice, so that it is split once and not for every character
    chars = urls.select(*(F.col(c).alias(f"own_{c}") for c in keep), padded.alias("chars"))
    grams = F.transform("chars", lambda _, i: F.when(
        i >= ORDER, F.array_join(F.slice("chars", F.greatest(i - ORDER + 1, F.lit(1)), ORDER + 1), "")))
    return chars.select(*(F.col(f"own_{c}").alias(c) for c in keep), F.explode(grams).alias("gram")).where("gram is not null")


def log_ratios(grams: DataFrame) -> DataFrame:
    """(gram, ratio) from (gram, yes, no): counts in accepted and rejected URLs."""
    below = None
    for order in range(ORDER + 1):
        counts = grams.select(F.expr(f"substr(gram, {ORDER + 1 - order})").alias("gram"), "yes", "no").groupBy("gram").agg(
            F.sum("yes").alias("yes"), F.sum("no").alias("no"))
        counts = cut_lineage(counts.withColumn("context", F.expr(f"substr(gram, 1, {order})")))
        context = counts.groupBy("context").agg(*(
            x.alias(f"{c}_{n}") for c in ("yes", "no")
            for n, x in (("all", F.sum(c)), ("kinds", F.sum((F.col(c) > 0).cast("long"))))))
        table = counts.join(context, "context")
        if below is None:
            table = table.withColumns({f"p_{c}": F.lit(1.0 / SYMBOLS) for c in ("yes", "no")})
        else:
            table = table.withColumn("shorter", F.expr("substr(gram, 2)")).join(
                below.select(F.col("gram").alias("shorter"), F.col("q_yes").alias("p_yes"), F.col("q_no").alias("p_no")), "shorter")
        for c in ("yes", "no"):
            every, kinds = F.col(f"{c}_all"), F.col(f"{c}_kinds")
            mixed = (F.col(c) + kinds * F.col(f"p_{c}")) / (every + kinds)
            table = table.withColumn(f"q_{c}", F.when(every > 0, mixed).otherwise(F.col(f"p_{c}")))
        below = table.select("gram", "q_yes", "q_no")
    return below.select("gram", (F.log("q_no") - F.log("q_yes")).alias("ratio"))


def cut_of(accepted: tuple, rejected: tuple) -> float:
    """Where rejection becomes likelier: means, common variance and numbers of both sides."""
    (n1, m1, v1), (n0, m0, v0) = accepted, rejected
    if not n1 or not n0 or m0 <= m1:
        return math.inf
    variance = max((n1 * v1 + n0 * v0) / (n1 + n0), 1e-9)
    return (m1 + m0) / 2 + variance * math.log(n1 / n0) / (m0 - m1)


def judge(pages: DataFrame, rules: Sequence[Rule], id_column: str = "page_id", url: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, score, cut) of each row."""
    rows = pages.select(F.col(id_column).alias(id_column), F.coalesce(F.col(url), F.lit("")).alias("text"))
    urls = rows.groupBy("text").agg(F.count("*").alias("n"))
    urls = urls.withColumn("host", host_of(F.col("text"))).withColumn("path", path_of(F.col("text")))
    urls = cut_lineage(urls.withColumn("by_rule", by_rules(rules, F.col("host"), F.col("path"))).select(
        F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(7), "text").alias("k2"), "text", "n", "host", "path", "by_rule.*", (F.pmod(F.xxhash64("text"), F.lit(5)) == 0).alias("held")))

    key = ["k1", "k2"]  # stands for the URL on each of its windows, however long it is

    def counted(verdict: str) -> Column:
        own = F.coalesce((F.col("verdict") == verdict) & ~F.col("held"), F.lit(False))
        return F.sum(F.when(own, F.col("n")).otherwise(0))

    grams = cut_lineage(windows(urls, "n", "verdict", "held").groupBy("gram").agg(
        counted(ALLOW).alias("yes"), counted(BLOCK).alias("no")))
    ratios = cut_lineage(log_ratios(grams))
    scores = cut_lineage(windows(urls, *key).join(ratios, "gram").groupBy(*key).agg(F.avg("ratio").alias("score")))
    scored = cut_lineage(urls.join(scores, key))
    sides = {(r["verdict"], r["held"]): (r["n"], r["m"], r["v"]) for r in scored.where("verdict is not null")
             .groupBy("verdict", "held").agg(F.sum("n").alias("n"), F.avg("score").alias("m"), F.var_pop("score").alias("v")).collect()}
    none = (0, 0.0, 0.0)
    held = {v: sides.get((v, True), sides.get((v, False), none)) for v in (ALLOW, BLOCK)}
    cut = cut_of(held[ALLOW], held[BLOCK])
    by_model = F.when(F.col("score") > cut, BLOCK).otherwise(ALLOW)
    verdicts = scored.select("text", "host", "path", "rule", F.coalesce("verdict", by_model).alias("verdict"), "score")
    return rows.join(verdicts, "text").select(id_column, "host", "path", "rule", "verdict", "score", F.lit(cut).alias("cut"))
