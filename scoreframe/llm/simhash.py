"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints that agree in all but ``max_bits`` of 64 bits are linked. The distinct
fingerprints are dealt by pigeonhole keys: 64 bits fall into ``max_bits + 4`` blocks, and
two linked fingerprints agree in at least four of them, so each fingerprint goes to the
buckets of every choice of four blocks. For two bits a bucket leaves at most 22 bits open:
it can never hold more than 2**22 distinct fingerprints, whatever the input.

Inside a bucket the fingerprints are sorted by Gray rank, which puts those that differ in
few bits side by side. Neighbours form nodes that factor out the bits their members share;
nodes form upper nodes in the same way. Two nodes are compared by the bits both have fixed:
if these differ in more than ``max_bits`` places, no pair below can be linked and the whole
group is left out. Differences are taken over ever more fixed bits on the way down until
single fingerprints are compared. A bucket gives a spanning forest of its links, never the
pairs themselves. Links between fingerprints become components by repeated contraction,
with a written table between the rounds.

Defined results: a missing or empty text has fingerprint 0 and is linked like any other;
equal rows give equal rows; an empty table gives an empty result; other columns are not
looked at; a missing ``doc_id`` is never the smallest of a component that has a present one.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreframe.llm.text import unused, whole
from scoreframe.session import cut_lineage

BITS = 64
FAN_OUT = 8
FRONTIER = 1 << 19
BATCH_ROWS = 1 << 16


def fingerprint(text: bytes | None, size: int) -> int:
    """Majority bits of the XXH64 values of word shingles; half is no majority."""
    words = (text or b"").lower().split()  # on bytes: A-Z only, and blanks are 32 and 9 to 13
    if not words:
        return 0
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    hashed = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(hashed), 4096):
        part = hashed[start:start + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    value = np.packbits(2 * ones > len(hashed), bitorder="little").view("<u8")[0]
    return int(value)


def with_fingerprint(docs: DataFrame, id_column: str = "doc_id", size: int = 3) -> DataFrame:
    """(id, fingerprint as a long) of each row."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t, size) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(of_batches, f"id {kind}, fp bigint")


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Place of each pattern in the reflected Gray sequence: bit i is the parity of bits i and up."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _levels(values: np.ndarray, bucket: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per level: fixed bits, their pattern, first child and child count; level 0 has the rows."""
    n = len(values)
    mask, pattern, owner = np.full(n, ~np.uint64(0)), values, bucket
    levels = [(mask, pattern, np.arange(n), np.ones(n, dtype=np.int64))]
    while True:
        n = len(owner)
        new_bucket = np.r_[True, owner[1:] != owner[:-1]]
        begins = np.flatnonzero(new_bucket)
        if len(begins) == n:
            return levels
        within = np.arange(n) - np.repeat(begins, np.diff(np.r_[begins, n]))
        heads = np.flatnonzero(within % FAN_OUT == 0)
        counts = np.diff(np.r_[heads, n])
        first = np.repeat(pattern[heads], counts)
        same = mask & ~(pattern ^ first)
        mask = np.bitwise_and.reduceat(same, heads)
        pattern, owner = pattern[heads] & mask, owner[heads]
        levels.append((mask, pattern, heads, counts))


def _children(level: tuple, pairs: np.ndarray) -> np.ndarray:
    """Pairs of children of pairs of nodes; of a node with itself, each pair once."""
    _, _, heads, counts = level
    left, right = pairs
    total = counts[left] * counts[right]
    which = np.repeat(np.arange(len(left)), total)
    place = np.arange(len(which)) - np.repeat(np.cumsum(total) - total, total)
    width = counts[right][which]
    out = np.stack([heads[left][which] + place // width, heads[right][which] + place % width])
    return out[:, out[0] <= out[1]]


def linked(values: np.ndarray, bucket: np.ndarray, max_bits: int) -> Iterator[np.ndarray]:
    """Index pairs of rows in one bucket within ``max_bits``; rows sorted by bucket and Gray rank."""
    levels = _levels(values, bucket)
    top = len(levels) - 1
    roots = np.arange(len(levels[top][0]))
    todo = [(top, part) for part in np.array_split(np.stack([roots, roots]), max(1, len(roots) // FRONTIER + 1), axis=1)]
    while todo:
        depth, pairs = todo.pop()
        mask, pattern = levels[depth][:2]
        apart = (pattern[pairs[0]] ^ pattern[pairs[1]]) & mask[pairs[0]] & mask[pairs[1]]
        pairs = pairs[:, np.bitwise_count(apart) <= max_bits]
        if depth == 0:
            yield pairs[:, pairs[0] < pairs[1]]
            continue
        step = FRONTIER // (FAN_OUT * FAN_OUT)
        for start in range(0, pairs.shape[1], step):
            part = pairs[:, start:start + step]
            todo.append((depth - 1, _children(levels[depth], part)))


def _forest(root: np.ndarray, pairs: np.ndarray) -> None:
    """Merge the trees of ``root`` that the pairs link; each tree hangs on its smallest row."""
    left, right = pairs
    while True:
        while True:
            above = root[root]
            if np.array_equal(above, root):
                break
            root[:] = above
        a, b = root[left], root[right]
        apart = a != b
        if not apart.any():
            return
        left, right = left[apart], right[apart]
        np.minimum.at(root, np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart]))


def _bucket_edges(values: np.ndarray, bucket: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    root = np.arange(len(values))
    for pairs in linked(values, bucket, max_bits):
        _forest(root, pairs)
    own = np.flatnonzero(root != np.arange(len(values)))
    return values[own], values[root[own]]


def block_keys(fp: Column, max_bits: int) -> list[Column]:
    """One key for every choice of four blocks of bits, tagged with the choice."""
    blocks = max_bits + 4
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    keys = []
    for tag, chosen in enumerate(itertools.combinations(range(blocks), 4)):
        mask = sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in chosen)
        signed = mask - (1 << BITS) if mask >= 1 << (BITS - 1) else mask
        keys.append(F.struct(F.lit(tag).alias("tag"), fp.bitwiseAND(F.lit(signed)).alias("bits")))
    return keys


def links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Distinct fingerprints (``fp``) to a spanning forest (``a``, ``b``) of their links.

    Rows of a bucket arrive together and are searched in batches of whole buckets of about
    ``BATCH_ROWS`` rows, all buckets of a batch at once.
    """
    fp = F.col("fp")
    dealt = fps.select(fp, F.explode(F.array(*block_keys(fp, max_bits))).alias("k")).select("fp", "k.tag", "k.bits")
    parts = dealt.repartition("tag", "bits").sortWithinPartitions("tag", "bits", "fp")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush(rows: np.ndarray) -> pa.RecordBatch:
            value, tag, bits = (rows[i].view(np.uint64) for i in range(3))
            order = np.lexsort((gray_rank(value), bits, tag))
            value, tag, bits = value[order], tag[order], bits[order]
            change = np.r_[False, (tag[1:] != tag[:-1]) | (bits[1:] != bits[:-1])]
            bucket = np.cumsum(change)
            alone = np.bincount(bucket)[bucket] == 1
            a, b = _bucket_edges(value[~alone], bucket[~alone], max_bits) if not alone.all() else (value[:0], value[:0])
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], ["a", "b"])

        for batch in batches:
            held.append(np.stack([batch.column(i).cast(pa.int64()).to_numpy() for i in range(3)]))
            if sum(x.shape[1] for x in held) < BATCH_ROWS:
                continue
            rows = np.concatenate(held, axis=1)
            last = np.flatnonzero((rows[1] != rows[1, -1]) | (rows[2] != rows[2, -1]))
            cut = last[-1] + 1 if len(last) else 0  # the bucket of the last row may go on
            if cut:
                yield flush(rows[:, :cut])
            held = [rows[:, cut:]]
        if held:
            yield flush(np.concatenate(held, axis=1))

    return parts.mapInArrow(search, "a bigint, b bigint").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): each node of an edge with one node of its component, by contraction.

    Nodes stand in the order of their hashes. Every round hangs each node on the first of
    its neighbours and itself, moves the edges up with their ends and drops those that
    became loops, about half of them; an edge keeps its two ends connected until then.
    """
    left = cut_lineage(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b"))
    rounds = []
    while not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = F.least(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("n"))),
                        F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("n")))
        up = cut_lineage(both.groupBy("a").agg(first.alias("up")).select("a", "up.n"))
        rounds.append(up)
        moved = left.join(up.withColumnRenamed("n", "ua"), "a").join(
            up.select(F.col("a").alias("b"), F.col("n").alias("ub")), "b")
        left = cut_lineage(moved.where("ua <> ub").select(
            F.greatest("ua", "ub").alias("a"), F.least("ua", "ub").alias("b")).distinct())
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    nodes = rounds[0].select(F.col("a").alias("node"), F.col("n").alias("root"))
    for up in rounds[1:]:
        nodes = nodes.join(up.withColumnRenamed("a", "root"), "root", "left").select(
            "node", F.coalesce("n", "root").alias("root"))
    return nodes


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", size: int = 3, max_bits: int = 2) -> DataFrame:
    """(id, fingerprint, component_id): the smallest id that can be reached over links."""
    prints = cut_lineage(with_fingerprint(docs, id_column, size))
    smallest = cut_lineage(prints.groupBy("fp").agg(F.min("id").alias("least")))
    roots = cut_lineage(components(links(smallest.select("fp"), max_bits)))
    named = smallest.join(roots, smallest.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    component = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = cut_lineage(named.join(component, "root").select("fp", "component_id"))
    return prints.join(of_print, "fp").select(
        F.col("id").alias(id_column), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_groups(docs: DataFrame, id_column: str = "doc_id", size: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` with one row of each component: the one of smallest id, a missing id last.

    Rows that share an id are told apart by their text; of equal rows one stays.
    """
    name = unused(docs, "_kept_key")
    key = F.struct(F.col(id_column).isNull().alias("none"), F.col(id_column).alias("id"), F.xxhash64(whole()).alias("mark"))
    kept = near_duplicates(docs.select(key.alias("key"), "text"), "key", size, max_bits)
    kept = cut_lineage(kept.where("key <=> component_id").select(F.col("key").alias(name)).distinct())
    keyed = docs.withColumn(name, key)
    # the key leads after the join, so its removal leaves the columns in their order
    return keyed.join(kept, name, "left_semi").dropDuplicates([name]).drop(name)
