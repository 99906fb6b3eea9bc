"""Mixing sources to target weights by a splitting tree of block quotas, in DataFrame functions.

1. Targets: sources share all words by weight; a target stops at ``most`` times its source,
   the excess is shared again by weight. Solved in closed form: in the order of
   ``most * size / weight`` the first sources are full, the rest share one level.
2. Documents fall into blocks of up to ``block`` words. Every pass over a source permutes
   its blocks by a seeded hash. Running sums of the words give each block its place; the
   blocks that start before the target are drawn, the last one only as far as needed. The
   numbers of drawn blocks are the exact quotas of the sources.
3. Quotas are dealt to the output shards by a tree: each node halves its shards and draws
   how many blocks of each source go left from the multivariate hypergeometric law, source
   after source, each draw by inversion with a seeded uniform number. Leaves hold quotas.
4. A shard takes the blocks of each source at its own range of places: ranges are disjoint,
   and together they are all drawn blocks. Inside a shard the order is a seeded hash.

No window holds a source: running sums are taken over hash slices of about ``SLICE`` blocks,
as counted, over the totals of ``SLICE`` slices, and over those of such runs. The table of sources has one row for each source and the tree
one array of them; both grow with the number of sources, not of documents.

Defined results: a missing text has size 0 and is never drawn; missing sources are one
source, the last; a source without words has target 0; equal rows are documents
of their own, so each may be drawn differently; an empty table gives empty results; extra columns are not looked at. Reruns
agree, with any split of the table into files and partitions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from scoreframe.llm.text import n_words, whole
from scoreframe.session import cut_lineage

SLICE = 4_096
COPIES = 4_096
TINY = 1e-9


def sized(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(row, key, id, source, size), written once.

    ``key`` seeds the draws. It comes from the id, the text and a number among equal rows, so it is the
    same however the table is split into files and partitions; which of equal rows has which number does
    not show. Equal rows are counted first and told apart again in runs of ``COPIES``, dealt to all tasks.
    ``row`` numbers the written rows for joins.
    """
    text = whole()
    rows = docs.select(F.col(id_column).alias("id"), F.col("source").alias("source"), n_words(text).alias("size"),
                       F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b"))
    runs = rows.groupBy("id", "source", "size", "a", "b").agg(F.count("*").alias("copies")).select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {COPIES}"))).alias("run"))
    last = F.least(F.col("copies") - F.col("run") * COPIES, F.lit(COPIES).cast("long")) - 1
    copies = runs.repartition("a", "run", "id").select(
        "id", "source", "size", "a", "b", "run", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("copy"))
    own = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("id", "source")]
    seed = F.xxhash64(*own, "a", "b", "run", "copy")
    return cut_lineage(copies.select(seed.alias("key"), "id", "source", "size").withColumn("row", F.monotonically_increasing_id()))


def targets(rows: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), most: float = 3.0) -> DataFrame:
    """(source, rank, source_size, weight, target) of each source; one row a source."""
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.orderBy(F.col("source").isNull(), F.col("source"))
    rank = F.row_number().over(every)
    table = by_source.withColumn("rank", rank)
    table = table.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), 1 + (F.col("rank") - 1) % len(weights)))
    full = Window.orderBy(F.lit(most) * F.col("source_size") / F.col("weight"), "rank")
    before, after = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(0, Window.unboundedFollowing)
    table = table.withColumns({
        "total": F.sum("source_size").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        "used": F.coalesce(F.sum(F.lit(most) * F.col("source_size")).over(before), F.lit(0.0)),
        "left": F.sum("weight").over(after)})
    level = (F.col("total") - F.col("used")) / F.col("left")
    # The level is the largest one offered: once a source is not full, none after it is.
    table = table.withColumn("fits", level * F.col("weight") <= F.lit(most) * F.col("source_size"))
    table = table.withColumn("level", F.first(F.when(F.col("fits"), level), ignorenulls=True).over(
        full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.lit(most) * F.col("source_size"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight"))
    return table.select("source", "rank", "source_size", "weight", F.coalesce(target, F.lit(0.0)).cast("double").alias("target"))


def _uniform(*of: Column) -> Column:
    """A number in (0, 1) that depends on the given values alone."""
    return (F.pmod(F.xxhash64(*of), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def _before(totals: DataFrame) -> DataFrame:
    """Adds ``words_before`` and ``blocks_before``: sums over a source's earlier slices, and passes.

    Slices are summed up by runs of ``SLICE`` first, so a window holds that many rows at most, or a row for each run.
    """
    totals = totals.withColumn("run", F.expr(f"slice div {SLICE}"))
    runs = totals.groupBy("rank", "pass", "run").agg(F.sum("words").alias("w"), F.sum("blocks").alias("b"))

    def earlier(column: str, window: WindowSpec) -> Column:
        return F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    every, inside = Window.partitionBy("rank").orderBy("pass", "run"), Window.partitionBy("rank", "pass", "run").orderBy("slice")
    runs = runs.select("rank", "pass", "run", earlier("w", every).alias("w"), earlier("b", every).alias("b"))
    return totals.select("rank", "pass", "run", "slice", earlier("words", inside).alias("words_in"), earlier("blocks", inside).alias("blocks_in")).join(
        runs, ["rank", "pass", "run"]).select(
        "rank", "pass", "slice", (F.col("w") + F.col("words_in")).alias("words_before"), (F.col("b") + F.col("blocks_in")).alias("blocks_before"))


def drawn_blocks(rows: DataFrame, table: DataFrame, block: int = 128, seed: int = 1, most: float = 3.0) -> DataFrame:
    """(row, id, rank, place, words): each drawn block with its place among its source's draws."""
    pieces_of = F.expr(f"(size + {block - 1}) div {block}")
    blocks = rows.where("size > 0").groupBy(F.col("source").alias("of")).agg(F.sum(pieces_of).alias("n_blocks"))
    goal = table.select("source", "rank", "source_size", F.round("target").cast("long").alias("goal")).where("goal > 0")
    goal = cut_lineage(goal.join(blocks, F.expr("of <=> source")).drop("of"))
    owned = rows.where("size > 0").withColumnRenamed("source", "own").join(goal, F.expr("own <=> source"))
    last_pass = F.least(F.lit(math.ceil(most) - 1), F.expr("(goal - 1) div source_size")).cast("int")
    pieces = owned.select(
        "row", "key", "id", "rank", "n_blocks", "goal", "size",
        F.explode(F.sequence(F.lit(0), last_pass)).alias("pass")).select(
        "row", "key", "id", "rank", "n_blocks", "goal", "size", "pass",
        F.explode(F.sequence(F.lit(0), F.expr(f"cast((size - 1) div {block} as int)"))).alias("piece"))
    words = F.least(F.lit(block).cast("long"), F.col("size") - F.col("piece") * F.lit(block))
    pieces = pieces.select("row", "key", "piece", "id", "rank", "n_blocks", "goal", "pass", words.alias("words"),
                           F.xxhash64(F.lit(seed), "key", "piece", "pass").alias("h"))
    n_slices = F.expr(f"(n_blocks + {SLICE - 1}) div {SLICE}")
    # slices follow the hash order: the upper bits of the hash, scaled to the number of slices
    upper = (F.shiftright("h", 32) + F.lit(1 << 31)).cast("double") / float(1 << 32)
    pieces = pieces.withColumn("slice", F.floor(upper * n_slices).cast("long")).drop("n_blocks")
    totals = _before(pieces.groupBy("rank", "pass", "slice").agg(F.sum("words").alias("words"), F.count("*").alias("blocks")))
    inside = Window.partitionBy("rank", "pass", "slice").orderBy("h", "key", "piece").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.select(
        "*", F.coalesce(F.sum("words").over(inside), F.lit(0)).alias("w"),
        F.count("words").over(inside).alias("b")).join(totals, ["rank", "pass", "slice"])
    start = F.col("words_before") + F.col("w")
    return placed.where(start < F.col("goal")).select(
        "row", "id", "rank", (F.col("blocks_before") + F.col("b")).alias("place"),
        F.least(F.col("words"), F.col("goal") - start).alias("words"))


def _hypergeometric(good: Column, rest: Column, draws: Column, uniform: Column) -> Column:
    """How many of ``draws`` blocks come from ``good`` of ``good + rest``, by inversion.

    The weights of the counts within ten deviations of the mean follow from one another;
    one pass adds them up, another stops at the uniform share of the sum.
    """
    total = good + rest
    mean = draws * good / F.greatest(total, F.lit(1.0))
    deviation = F.sqrt(F.greatest(mean * rest / F.greatest(total, F.lit(1.0)) * (total - draws) / F.greatest(total - 1, F.lit(1.0)), F.lit(0.0)))
    low = F.greatest(draws - rest, F.lit(0.0), F.floor(mean - 10 * deviation - 10).cast("double"))
    high = F.least(good, draws, F.ceil(mean + 10 * deviation + 10).cast("double"))
    steps = F.sequence(F.lit(0).cast("long"), F.greatest(high - low, F.lit(0.0)).cast("long"))

    def ratio(x: Column) -> Column:
        """Weight of x + 1 over weight of x."""
        return (good - x) * (draws - x) / F.greatest((x + 1) * (rest - draws + x + 1), F.lit(TINY))

    start = F.struct(F.lit(1.0).alias("weight"), F.lit(0.0).alias("sum"))
    summed = F.aggregate(steps, start, lambda a, k: F.struct(
        (a["weight"] * ratio(low + k.cast("double"))).alias("weight"), (a["sum"] + a["weight"]).alias("sum")), lambda a: a["sum"])
    begin = F.struct(F.lit(1.0).alias("weight"), (uniform * summed).alias("left"), low.alias("at"))
    return F.aggregate(steps, begin, lambda a, k: F.struct(
        (a["weight"] * ratio(low + k.cast("double"))).alias("weight"), (a["left"] - a["weight"]).alias("left"),
        F.when(a["left"] > a["weight"], low + k.cast("double") + 1).otherwise(a["at"]).alias("at")),
        lambda a: F.greatest(low, F.least(a["at"], high)))


def _splitter(seed: int, width: int):
    """The step over a node's sources: draw how many of the source's blocks go left."""

    def split(state: Column, source: Column) -> Column:
        rest = state["rest"] - source["quota"]
        uniform = _uniform(F.lit(seed), F.lit(width), F.col("node"), source["rank"])
        drawn = F.array(_hypergeometric(source["quota"], rest, state["draws"], uniform))
        return F.transform(drawn, lambda n: F.struct(
            rest.alias("rest"), (state["draws"] - n).alias("draws"),
            F.concat(state["left"], F.array(F.struct(source["rank"].alias("rank"), n.alias("quota")))).alias("left")))[0]

    return split


def shard_quotas(quotas: DataFrame, shards: int = 16, seed: int = 1) -> DataFrame:
    """(rank, shard, begin, quota): the splitting tree over ``quotas`` (rank, quota).

    A level is one projection over its nodes, written before the next.
    """
    if shards < 1 or shards & (shards - 1):
        raise ValueError("the number of shards must be a power of two")
    node = quotas.agg(F.sort_array(F.collect_list(F.struct("rank", F.col("quota").cast("double").alias("quota")))).alias("own"))
    node = node.where(F.size("own") > 0).select(F.lit(0).alias("node"), "own")
    width = shards
    while width > 1:
        width //= 2
        size = F.aggregate("own", F.lit(0.0), lambda a, x: a + x["quota"])
        node = cut_lineage(node.withColumn("rest", size).withColumn("draws", F.floor(F.col("rest") / 2).cast("double")))
        begin = F.struct(F.col("rest").alias("rest"), F.col("draws").alias("draws"),
                         F.expr("cast(array() as array<struct<rank:int,quota:double>>)").alias("left"))

        halves = cut_lineage(node.select("node", "own", F.aggregate("own", begin, _splitter(seed, width), lambda a: a["left"]).alias("left")))
        right = F.zip_with("own", "left", lambda o, x: F.struct(o["rank"].alias("rank"), (o["quota"] - x["quota"]).alias("quota")))
        node = halves.select(F.explode(F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("own")),
            F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("own")))).alias("half")).select("half.*")
    leaves = node.select(F.col("node").alias("shard"), F.explode("own").alias("x")).select(
        "shard", F.col("x.rank").alias("rank"), F.col("x.quota").cast("long").alias("quota"))
    before = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return leaves.withColumn("begin", F.coalesce(F.sum("quota").over(before), F.lit(0)))


def mix(docs: DataFrame, id_column: str = "doc_id", weights: Sequence[float] = (5.0, 2.0, 1.0), most: float = 3.0,
        block: int = 128, shards: int = 16, seed: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The written rows with sizes, the sources' table, and the drawn blocks by shard and order."""
    rows = sized(docs, id_column)
    table = cut_lineage(targets(rows, weights, most))
    drawn = cut_lineage(drawn_blocks(rows, table, block, seed, most))
    quotas = drawn.groupBy("rank").agg(F.count("*").alias("quota"))
    ranges = cut_lineage(shard_quotas(quotas, shards, seed).groupBy("rank").agg(
        F.sort_array(F.collect_list(F.struct("begin", "shard", "quota"))).alias("ranges")))
    # the last range that begins at or before the place; empty ranges share their begin with the next
    shard = F.element_at(F.filter("ranges", lambda r: (r["begin"] <= F.col("place")) & (F.col("place") < r["begin"] + r["quota"])), 1)["shard"]
    laid = drawn.join(ranges, "rank").select(
        "row", "id", "rank", "place", "words", shard.alias("shard"),
        F.xxhash64(F.lit(seed), F.lit("order"), "rank", "place").alias("order"))
    return rows, table, laid


def taken_words(docs: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """(id, size, source, source_size, target, taken) of each row."""
    rows, table, laid = mix(docs, id_column, **options)
    taken = laid.groupBy("row").agg(F.sum("words").alias("taken"), F.count("*").alias("n_blocks"), F.countDistinct("shard").alias("n_shards"))
    facts = table.select(F.col("source").alias("of"), "source_size", "target")
    return rows.join(taken, "row", "left").join(facts, F.expr("source <=> of")).select(
        F.col("id").alias(id_column), "size", "source", "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"),
        F.coalesce("n_shards", F.lit(0)).cast("long").alias("n_shards"))
