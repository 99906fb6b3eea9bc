"""Ranked lexical search without random access: the best documents of each item by summed term impacts.

A term's postings carry their impact, the term's weight times a saturated count in whole
numbers. Documents are searched in blocks; a block's lists are sorted by falling impact and
read one after the other from the top, the same cut for all lists of an item, so a rare
term's list is read out before a common one's is begun. For each document met, the sum of
the impacts read is the lower end of its score; the best impacts still unread in the lists
in which it was not met add up to the upper end.

* A document leaves when its upper end is below the ``k``-th best lower end known, in this
  block or from the blocks before. One that only reaches it stays: the smaller id wins a tie.
* An item takes no new documents once the best unread impacts of all its lists sum up to
  less than that; the further reads serve the documents it holds.
* Reading ends when no document is held or the lists are read out. Then membership and
  scores are exact, and ties are decided by id. A task hands on its ``k`` best of each item,
  and the best of these, by a window whose limit is applied before the shuffle, are the result.

The documents' counts of the items' terms are written once, since weights need all of them.
Items are a stated query set; they meet the documents in groups of about ``ENTRIES`` terms,
one pass for each group, so what a task is given does not grow with their number. Blocks of
documents get smaller as an item's terms get more, and hold at most ``POSTINGS`` counts more
than one document has.

Defined results: a missing text has no term; such documents and items are in no result. A
missing document id comes after all others; equal rows are documents of their own and share
a score; an item row that occurs twice is ranked twice; an item fewer than ``k`` documents
share a weighted term with has fewer rows; an empty table gives no row; other columns are
not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreframe.llm.text import LOWER, UPPER, whole
from scoreframe.session import cut_lineage

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans(UPPER, LOWER)
#: Item terms a pass serves, documents and counts in a block, and its documents times the terms of the longest item.
ENTRIES = 1 << 18
DOCS = 1 << 14
POSTINGS = 1 << 20
CELLS = 1 << 26


def terms_of(text: str) -> list[str]:
    return TERM.findall(text.translate(FOLD))


def item_terms(items: DataFrame, id_column: str = "item_id") -> DataFrame:
    """(item, item_id, terms): each row of ``items`` with its terms, repeats counted."""
    folded = F.translate(whole(), UPPER, LOWER)
    # numbered before the explosion, or each term would get a number
    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(id_column).alias("item_id"),
                        F.array_remove(F.split(folded, SEPARATORS), "").alias("own"))
    counted = rows.select("item", "item_id", F.explode("own").alias("term")).groupBy("item", "item_id", "term").agg(
        F.count("*").alias("times"))
    return counted.groupBy("item", "item_id").agg(F.sort_array(F.collect_list(F.struct("term", "times"))).alias("terms"))


def counts(docs: DataFrame, vocabulary: dict[str, int], id_column: str = "doc_id") -> DataFrame:
    """(id, n, terms, tf): of each document with terms their number, and the counts of those in ``vocabulary``."""
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, n, terms, tf = [], [], [], []
            for i, text in enumerate(batch.column(1)):
                if found := terms_of(text.as_py()):
                    own = [(k, c) for t, c in Counter(found).items() if (k := vocabulary.get(t)) is not None]
                    which.append(i)
                    n.append(len(found))
                    terms.append([k for k, _ in own])
                    tf.append([c for _, c in own])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(which, pa.int32())), pa.array(n, pa.int64()),
                 pa.array(terms, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int32()))], ["id", "n", "terms", "tf"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), whole().alias("text"))
    return rows.mapInArrow(of_batches, f"id {kind}, n bigint, terms array<int>, tf array<int>")


class Item(NamedTuple):
    key: int
    terms: np.ndarray
    times: np.ndarray


class Lists:
    """The postings of a block by term, each list by falling impact."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int, n_terms: int) -> None:
        order = np.lexsort((-impact, term))
        self.doc, self.impact, self.n_docs = doc[order], impact[order], n_docs
        self.edges = np.searchsorted(term[order], np.arange(n_terms + 1))

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.edges[term], self.edges[term + 1])
        return self.doc[own], self.impact[own]


def resolved(item: Item, lists: Lists, known: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of the block that may be among the item's ``k`` best, with exact scores.

    ``known`` is a score that ``k`` documents outside of the block reach, or 0.
    """
    own = [(docs, impact, q) for t, q in zip(item.terms, item.times, strict=True) for docs, impact in [lists.of(t)] if len(docs)]
    place = [0] * len(own)
    unread = np.array([impact[0] * q for _, impact, q in own], dtype=np.int64)
    low = np.zeros(lists.n_docs, dtype=np.int64)
    seen = np.zeros((lists.n_docs, len(own)), dtype=bool)
    held, taking, is_held = np.zeros(0, dtype=np.int64), True, None
    floor = max(1, known)
    while unread.any() and (len(held) or taking and unread.sum() >= floor):
        cut = max(impact[p] for (_, impact, _), p in zip(own, place, strict=True) if p < len(impact)) // 2
        for i, (docs, impact, q) in enumerate(own):
            begin = place[i]
            if begin == len(docs) or impact[begin] < cut:
                continue
            end = len(docs) - int(np.searchsorted(impact[::-1], cut, "left"))
            read, add = docs[begin:end], impact[begin:end] * q
            if not taking:
                mine = is_held[read]
                read, add = read[mine], add[mine]
            low[read] += add
            seen[read, i] = True
            place[i], unread[i] = end, impact[end] * q if end < len(docs) else 0
        if taking:
            held = np.flatnonzero(low)
        lower, rest = low[held], unread.sum()
        if len(held) >= k:
            floor = max(floor, int(np.partition(lower, -k)[-k]))
        held = held[lower + rest - seen[held] @ unread >= floor]
        taking = taking and rest >= floor
        is_held = np.zeros(lists.n_docs, dtype=bool)
        is_held[held] = True
    return held, low[held]


def _order(entry: tuple[int, object]) -> tuple:
    score, key = entry
    return -score, key is None, 0 if key is None else key


def _searched(batches: Iterator[pa.RecordBatch], items: list[Item], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> Iterator[pa.RecordBatch]:
    """(item, id, score): the ``k`` best documents of a task for each item."""
    best: list[list[tuple[int, object]]] = [[] for _ in items]
    most = max(1, min(DOCS, CELLS // max(len(i.terms) for i in items)))
    kind = pa.int64()

    def search(parts: list[pa.RecordBatch]) -> None:
        table = pa.Table.from_batches(parts).combine_chunks()
        ids, n = table.column("id"), table.column("n").to_numpy()
        sizes = table.column("terms").combine_chunks().value_lengths().to_numpy()
        term, tf = (table.column(c).combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("terms", "tf"))
        doc = np.repeat(np.arange(len(n)), sizes)
        norm = 75 + (25 * n * n_docs) // n_terms
        impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * norm[doc]))
        real = impact > 0
        lists = Lists(doc[real], term[real], impact[real], len(n), len(weights))
        for item, own in zip(items, best, strict=True):
            held, scores = resolved(item, lists, own[-1][0] if len(own) == k else 0, k)
            if len(held):
                own += zip(scores.tolist(), (ids[int(i)].as_py() for i in held), strict=True)
                own.sort(key=_order)
                del own[k:]

    parts, n_held, n_counts = [], 0, 0
    for batch in batches:
        kind = batch.schema.field(0).type
        ends = batch.column(2).offsets.to_numpy()
        begin = 0
        while begin < batch.num_rows:
            room = int(np.searchsorted(ends, ends[begin] + POSTINGS - n_counts, "right")) - 1 - begin
            take = max(min(room, most - n_held, batch.num_rows - begin), 0 if parts else 1)
            if take:
                parts.append(batch.slice(begin, take))
                n_held, n_counts, begin = n_held + take, n_counts + int(ends[begin + take] - ends[begin]), begin + take
            if n_held >= most or n_counts >= POSTINGS or not take:
                search(parts)
                parts, n_held, n_counts = [], 0, 0
    if parts:
        search(parts)
    rows = [(item.key, key, score) for item, own in zip(items, best, strict=True) for score, key in own]
    columns = zip(*rows, strict=True) if rows else [[]] * 3
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), kind, pa.int64()), strict=True)], ["item", "id", "score"])


def _group(docs: DataFrame, rows: list, k: int, id_column: str) -> DataFrame:
    """(item, id, score): the best of every task for a group of items."""
    vocabulary = {t: i for i, t in enumerate(sorted({x.term for r in rows for x in r.terms}))}
    items = [Item(r.item, np.array([vocabulary[x.term] for x in r.terms]), np.array([x.times for x in r.terms])) for r in rows]
    vectors = cut_lineage(counts(docs, vocabulary, id_column))
    total = vectors.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_terms")).first()
    weight = F.floor(1000 * F.log(F.lit(2.0 * total.n_docs + 2.0) / (2.0 * F.count("*") + 1.0)))
    weights = np.zeros(len(vocabulary), dtype=np.int64)
    for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(weight.alias("w")).collect():
        weights[r.term] = r.w
    n_docs, n_terms = total
    kind = vectors.schema["id"].dataType.simpleString()
    return cut_lineage(vectors.mapInArrow(lambda it: _searched(it, items, weights, n_docs, n_terms, k), f"item bigint, id {kind}, score bigint"))


def search(docs: DataFrame, items: DataFrame, k: int = 20, doc_column: str = "doc_id", item_column: str = "item_id") -> DataFrame:
    """(item, rank, document, score): the ``k`` best documents of each item, scores above 0 only."""
    wanted = cut_lineage(item_terms(items, item_column))
    entries = wanted.agg(F.sum(F.size("terms"))).first()[0] or 0
    groups = -(-entries // ENTRIES)
    kind = docs.schema[doc_column].dataType.simpleString()
    found = docs.sparkSession.createDataFrame([], f"item bigint, id {kind}, score bigint")
    for g in range(groups):
        rows = wanted.where(F.pmod(F.xxhash64("item"), F.lit(groups)) == g).collect()
        if rows:
            found = found.unionByName(_group(docs, rows, k, doc_column))
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(wanted.select("item", "item_id"), "item").select(
        F.col("item_id").alias(item_column), "rank", F.col("id").alias(doc_column), "score")
