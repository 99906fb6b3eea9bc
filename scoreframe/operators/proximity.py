"""Random-forest proximity of people, for the pairs that are asked for.

Two people are close when they land in the same leaf in many trees. Listing all
pairs of a leaf is quadratic, and the rating table needs only (rater, ratee)
pairs: each pair looks up its two leaf vectors and counts equal entries.
"""

from __future__ import annotations

import math

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreframe.functions.missing import as_col
from scoreframe.operators.joins import left_on
from scoreframe.operators.ordered import number_within
from scoreframe.operators.reshape import to_long
from scoreframe.session import cut_lineage


def shuffled_columns(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Rows with the same values per column but no link between columns.

    All columns are permuted by one distributed sort on a hash of (column, id).
    """
    long = to_long(df.select(id_col, *[as_col(c).cast("string").alias(c) for c in columns]),
                   columns, "column", "value")
    mixed = long.withColumn("__h", F.xxhash64("column", id_col))
    placed = number_within(mixed, ["column"], ["__h", id_col], "place")
    wide = placed.groupBy("place").agg(
        *[F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in columns]
    )
    types = dict(df.dtypes)
    return wide.select(*[as_col(c).cast(types[c]).alias(c) for c in columns])


def bag_count(key: Column, tree: int, seed: int) -> Column:
    """How often a row is in a tree's bag: Poisson with mean 1, from a hash of the key alone."""
    share = F.pmod(F.xxhash64(key, F.lit(tree), F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    below, count = 0.0, F.lit(0)
    for k in range(16):
        below += math.exp(-1) / math.factorial(k)
        count = count + (share >= F.lit(below)).cast("int")
    return count


def bagged_leaves(df: DataFrame, id_col: str, nominal: list[str], numeric: list[str],
                  trees: int = 500, depth: int = 5, seed: int = 7) -> DataFrame:
    """(id, leaves, bags): per tree the leaf, and how often the person was in the bag that grew it.

    Each tree tells real from shuffled rows, tries a square root of the features at a node and weighs
    rows by their bag counts. The counts come from hashes of ids, and sums of whole weights are exact, so
    the partitions of the input do not matter as long as Spark bins a numeric column from all of
    its rows (10,000 or fewer). Trees are grown one after the other, each as a distributed job over a
    table of coded features that is written once.
    """
    columns = [*nominal, *numeric]
    real = df.select(id_col, *columns)
    fake = shuffled_columns(df, id_col, columns).withColumn(id_col, F.lit(None).cast(dict(df.dtypes)[id_col]))
    key = F.concat_ws("\x1f", *[F.coalesce(as_col(c).cast("string"), F.lit("")) for c in columns])
    both = real.withColumns({"__real": F.lit(1.0), "__key": as_col(id_col).cast("string")}).unionByName(
        fake.withColumns({"__real": F.lit(0.0), "__key": key}))
    hot = [f"__v_{c}" for c in nominal]
    coding = Pipeline(stages=[
        StringIndexer(inputCols=nominal, outputCols=[f"__i_{c}" for c in nominal], handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=[f"__i_{c}" for c in nominal], outputCols=hot, dropLast=False),
        VectorAssembler(inputCols=[*hot, *numeric], outputCol="__x"),
    ])
    coded = cut_lineage(coding.fit(both).transform(both).select(id_col, "__x", "__real", "__key"))
    people = coded.filter("__real = 1")
    leaves = []
    for t in range(trees):
        forest = RandomForestClassifier(featuresCol="__x", labelCol="__real", weightCol="__w", leafCol=f"__leaf_{t}", numTrees=1,
                                        bootstrap=False, featureSubsetStrategy="sqrt", maxDepth=depth, seed=seed + t)
        model = forest.fit(coded.withColumn("__w", bag_count(F.concat("__real", "__key"), t, seed).cast("double")).filter("__w > 0"))
        model.setPredictionCol("").setRawPredictionCol("").setProbabilityCol("")
        people = model.transform(people)
        leaves.append(F.get(vector_to_array(f"__leaf_{t}"), F.lit(0)))
    bags = [bag_count(F.concat("__real", "__key"), t, seed) for t in range(trees)]
    return people.select(id_col, F.array(*leaves).alias("leaves"), F.array(*bags).alias("bags"))


def out_of_bag_proximity(pairs: DataFrame, leaves: DataFrame, left: str, right: str, id_col: str) -> DataFrame:
    """Per pair: trees whose bag has neither end, those of them in which the two meet, and the share.

    NULL proximity if no tree leaves both out, or if an end has no leaves; self pairs are dropped.
    """
    out = pairs.filter(as_col(left) != as_col(right)).select(left, right).distinct()
    vector = F.struct("leaves", "bags")
    known = cut_lineage(leaves.select(id_col, "leaves", "bags"))
    for end, name in ((left, "__a"), (right, "__b")):
        out = left_on(out, known.select(id_col, vector.alias(name)), [(end, id_col)])
    free = F.zip_with("__a.bags", "__b.bags", lambda a, b: (a == 0) & (b == 0))
    met = F.zip_with("__a.leaves", "__b.leaves", lambda a, b: a == b)
    both = F.zip_with(free, met, lambda f, m: f & m)
    counted = {name: F.coalesce(F.size(F.filter(flags, lambda v: v)), F.lit(0)) for name, flags in (("n_free", free), ("n_met", both))}
    counted = {name: F.greatest(c, F.lit(0)) for name, c in counted.items()}
    out = out.withColumns(counted).drop("__a", "__b")
    return out.withColumn("proximity", F.try_divide("n_met", "n_free"))


def leaf_vectors(df: DataFrame, id_col: str, nominal: list[str], numeric: list[str],
                 trees: int = 50, depth: int = 5, seed: int = 7) -> DataFrame:
    """(id, leaves): leaf number per tree of a forest that tells real from shuffled rows."""
    columns = [*nominal, *numeric]
    real = df.select(id_col, *columns)
    fake = shuffled_columns(df, id_col, columns).withColumn(id_col, F.lit(None).cast(dict(df.dtypes)[id_col]))
    both = real.withColumn("__real", F.lit(1.0)).unionByName(fake.withColumn("__real", F.lit(0.0)))
    coded = [f"__i_{c}" for c in nominal]
    hot = [f"__v_{c}" for c in nominal]
    stages = [
        StringIndexer(inputCols=nominal, outputCols=coded, handleInvalid="keep",
                      stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=coded, outputCols=hot, dropLast=False),
        VectorAssembler(inputCols=[*hot, *numeric], outputCol="__x"),
        RandomForestClassifier(featuresCol="__x", labelCol="__real", leafCol="__leaf",
                               numTrees=trees, maxDepth=depth, seed=seed),
    ]
    model = Pipeline(stages=stages).fit(both)
    return model.transform(real).select(id_col, vector_to_array("__leaf").alias("leaves"))


def pair_proximity(pairs: DataFrame, leaves: DataFrame, left: str, right: str, id_col: str) -> DataFrame:
    """Share of trees in which the two ends of a pair meet; self pairs are dropped."""
    out = pairs.filter(as_col(left) != as_col(right)).select(left, right).distinct()
    out = left_on(out, leaves.withColumnRenamed("leaves", "__a"), [(left, id_col)])
    out = left_on(out, leaves.withColumnRenamed("leaves", "__b"), [(right, id_col)])
    same = F.zip_with("__a", "__b", lambda a, b: (a == b).cast("int"))
    total = F.aggregate(same, F.lit(0), lambda acc, v: acc + v)
    return out.withColumn("proximity", total / F.size("__a")).drop("__a", "__b")
