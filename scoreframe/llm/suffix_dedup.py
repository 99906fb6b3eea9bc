"""Repeated passages, exact to the byte, by bucket-pointer refinement.

A byte is removed when a string of ``length`` bytes that covers it starts anywhere else
too. Sorting every suffix of the corpus is out of reach, so suffixes are first put into
buckets by one q-gram each that depends on the window alone: a window of ``length`` bytes
belongs to the bucket of its smallest q-gram (its anchor). Neighbouring windows share an
anchor, so each document gives about one row for 105 bytes: the bucket, and an identifier
of the anchor's context, the text all its windows cover.

1. Buckets with one row are done: none of their windows is repeated. Buckets with one
   context are done as well: all their windows are. Both are found by one aggregation.
2. In the others, contexts that occur twice are settled. The rest is refined window by
   window: the identifier of a window is made from the q-gram identifiers at its later
   offsets, pairs of which name strings twice as long, and these again, until ``length``
   bytes are named. Identifiers are computed once for a context and used by all windows.
3. A bucket of up to ``SMALL`` contexts is refined inside a task. In larger ones intervals
   of windows are refined by halves, with counts by key, so no bucket has to fit into one
   task and the rows stay in proportion to the contexts.

Identifiers are 64-bit values; two windows count as equal if bucket, place of the anchor
and identifier agree. Long texts are scanned in pieces that overlap by ``length - 1``.

Defined results: a missing text is empty; a text shorter than ``length`` bytes keeps
everything; equal rows are repeats of each other; an empty table gives an empty result; a
missing ``doc_id`` is a value of its own; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreframe.llm.text import whole
from scoreframe.session import cut_lineage

LENGTH = 400
SMALL = 64
HOT = 1_000
PIECE = 1 << 18
POS_BITS = 20
BASE = 0x9E3779B97F4A7C15
MIX = 0xBF58476D1CE4E5B9
MASK = (1 << 64) - 1
INTERVAL = ["doc_id", "mark", "bucket", "first", "shift", "lone", "bytes", "lo", "hi"]


def gram_for(length: int) -> int:
    return max(1, length * 12 // 25)


Tables = tuple[np.ndarray, np.ndarray, np.ndarray]


def tables_for(length: int) -> Tables:
    """A random value per byte, and the powers of the base and of its inverse; made once a task."""
    size = PIECE + 2 * length
    values = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)

    def powers(base: int) -> np.ndarray:
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        return np.cumprod(out)

    return values, powers(BASE), powers(pow(BASE, -1, 1 << 64))


def _prefix(raw: np.ndarray, tables: Tables) -> tuple[np.ndarray, np.ndarray]:
    values, up, down = tables
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(values[raw] * up[:len(raw)], out=total[1:])
    return total, down


def _grams(total: np.ndarray, down: np.ndarray, width: int) -> np.ndarray:
    n = len(total) - width
    ids = (total[width:] - total[:n]) * down[:n]
    ids ^= ids >> np.uint64(31)
    return ids * np.uint64(MIX)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values)
    padded = np.full(-(-n // width) * width, ~np.uint64(0))
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def anchors_of(text: bytes, tables: Tables, length: int = LENGTH) -> Iterator[tuple[np.ndarray, ...]]:
    """(bucket, context, first window, windows, anchor minus first window) of runs of windows."""
    raw, gram = np.frombuffer(text, dtype=np.uint8), gram_for(length)
    low = np.uint64((1 << POS_BITS) - 1)
    for begin in range(0, max(0, len(raw) - length + 1), PIECE):
        piece = raw[begin:begin + PIECE + length - 1]
        total, down = _prefix(piece, tables)
        ids = _grams(total, down, gram)
        best = _sliding_min((ids & ~low) | np.arange(len(ids), dtype=np.uint64), length - gram + 1)
        place = (best & low).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        last = np.r_[first[1:], len(place)] - 1
        place = place[first]
        shape = ((place - first) * length + last - first).astype(np.uint64)
        context = (total[last + length] - total[first]) * down[first] * np.uint64(MIX) + shape
        yield ids[place], context, first + begin, last - first + 1, place - first


def windows_of(context: bytes, tables: Tables, length: int = LENGTH) -> np.ndarray:
    """The identifier of each window of a context, refined from its q-grams' identifiers."""
    total, down = _prefix(np.frombuffer(context, dtype=np.uint8), tables)
    width = gram_for(length)
    ids = _grams(total, down, width)
    while width < length:
        further = min(width, length - width)  # the last step overlaps
        n = len(ids) - further
        ids = (ids[:n] ^ (ids[further:] * np.uint64(BASE) + (ids[further:] >> np.uint64(29)))) * np.uint64(MIX)
        width += further
    return ids


def _scan(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "mark", "bucket", "context", "first", "windows", "shift"]
    tables = tables_for(length)
    for batch in batches:
        which, parts = [], []
        for i, text in enumerate(batch.column(2)):
            for part in anchors_of(text.as_buffer() or b"", tables, length):
                which.append(np.full(len(part[0]), i))
                parts.append(part)
        if parts:
            of = pa.array(np.concatenate(which))
            bucket, context, first, windows, shift = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(of), batch.column(1).take(of), pa.array(bucket.view(np.int64)),
                 pa.array(context.view(np.int64)), pa.array(first.astype(np.int32)),
                 pa.array(windows.astype(np.int32)), pa.array(shift.astype(np.int32))], names)


def _merged(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted disjoint spans that cover the same places; touching spans are one."""
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(end[order])
    new = np.r_[True, first[1:] > end[:-1]] if len(first) else np.zeros(0, bool)
    heads = np.flatnonzero(new)
    return first[heads], end[np.r_[heads[1:], len(first)] - 1] if len(heads) else end


def _cut_out(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of each context that is to be refined."""
    names = ["doc_id", "mark", "bucket", "first", "shift", "lone", "contexts", "bytes"]
    for batch in batches:
        rows = []
        for doc, mark, text, todo in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            rows += [(doc, mark, x["bucket"], x["first"], x["shift"], x["lone"], x["contexts"],
                      text[x["first"]:x["first"] + x["windows"] + length - 1]) for x in todo]
        kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.binary()]
        for start in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows[start:start + 10_000], strict=True), kinds, strict=True)], names)


def _window_rows(rows: list[tuple], tables: Tables, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, window start minus anchor, identifier) of every window of the given contexts."""
    ids = [windows_of(r[-1], tables, length) for r in rows]
    counts = np.array([len(x) for x in ids])
    row = np.repeat(np.arange(len(rows)), counts)
    place = np.concatenate([np.arange(n) - r[4] for n, r in zip(counts, rows, strict=True)])
    return row, place, np.concatenate(ids)


def _refine(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Spans of windows that two contexts of a bucket share; rows arrive sorted by bucket."""
    held: list[tuple] = []
    tables = tables_for(length)

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        row, place, ids = _window_rows(rows, tables, length)
        bucket = np.array([r[2] for r in rows])[row]
        order = np.lexsort((place, ids, bucket))
        b, i, p = bucket[order], ids[order], place[order]
        same = (b[1:] == b[:-1]) & (i[1:] == i[:-1]) & (p[1:] == p[:-1])
        shared = np.zeros(len(order), bool)
        shared[order] = np.r_[same, False] | np.r_[False, same]
        shared &= np.array([r[5] for r in rows])[row]
        first = np.array([r[3] + r[4] for r in rows])
        got: list[list] = [[], [], [], []]
        hit = np.flatnonzero(shared)
        for part in np.split(hit, np.flatnonzero(np.diff(row[hit])) + 1) if len(hit) else []:
            k = row[part[0]]
            starts = first[k] + place[part]
            for a, e in zip(*_merged(starts, starts + length), strict=True):
                for column, value in zip(got, (rows[k][0], rows[k][1], int(a), int(e)), strict=True):
                    column.append(value)
        kinds = [kind, pa.int64(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(got, kinds, strict=True)],
                                          ["doc_id", "mark", "first", "end"])

    for batch in batches:
        kind = batch.schema.field(0).type
        held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
        cut = next((i for i in range(len(held) - 1, 0, -1) if held[i][2] != held[i - 1][2]), 0)
        if cut and len(held) >= 2_000:
            for start, end in _whole_buckets(held[:cut], 2_000):
                yield flush(held[start:end])
            held = held[cut:]
    if held:
        for start, end in _whole_buckets(held, 2_000):
            yield flush(held[start:end])


def _whole_buckets(rows: list[tuple], size: int) -> Iterator[tuple[int, int]]:
    start = 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or (i - start >= size and rows[i][2] != rows[i - 1][2]):
            yield start, i
            start = i


def _halves(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Both halves of each row's interval of places, as far as the row has windows there.

    ``core`` names the bytes all windows of the half share, ``full`` those they cover.
    """
    for batch in batches:
        kind, rows = batch.schema.field(0).type, []
        for *own, shift, lone, text, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            last = len(text) - length - shift
            middle = (low + high) // 2
            for lo, hi in ((low, middle), (middle + 1, high)):
                begin, end = max(lo, -shift), min(hi, last)
                if begin <= end:
                    core = xxhash.xxh3_64_intdigest(text[hi + shift:lo + shift + length])
                    full = xxhash.xxh3_64_intdigest(text[begin + shift:end + shift + length], begin * length + end & MASK)
                    rows.append((*own, shift, lone, text, lo, hi, begin, end, _signed(core), _signed(full)))
        kinds = [kind, pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), *[pa.int32()] * 4, pa.int64(), pa.int64()]
        columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [*INTERVAL, "begin", "end", "core", "full"])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _by_halves(contexts: DataFrame, key: str, length: int) -> list[DataFrame]:
    """Spans of shared windows in buckets of any size, by halving intervals of window places.

    A half whose core no other context of the bucket has is dropped, one whose full bytes
    another has is settled and stays as one row to compare with, the others are halved again.
    A context keeps about one open interval for each end of a passage, so each of the rounds,
    as many as halvings of ``length``, has about two rows for it.
    """
    settled = []
    rows = contexts.select("doc_id", "mark", "bucket", "first", "shift", "lone", "bytes",
                           F.lit(gram_for(length) - length).alias("lo"), F.lit(0).alias("hi"))
    while not rows.isEmpty():
        halves = cut_lineage(rows.mapInArrow(
            lambda it: _halves(it, length),
            f"{key}, bucket bigint, first int, shift int, lone boolean, bytes binary, lo int, hi int, begin int, end int, core bigint, full bigint")
            .withColumn("pointer", F.xxhash64("doc_id", "mark", "first")))
        place = ["bucket", "lo", "hi"]
        total = halves.count()
        cores = cut_lineage(halves.groupBy(*place, "core").agg(F.count("*").alias("n")).where("n > 1"))
        fulls = cut_lineage(halves.groupBy(*place, "full").agg(F.count("*").alias("n"), F.min("pointer").alias("chosen")).where("n > 1"))
        common = _looked_up(halves, cores, [*place, "core"], total).drop("n")
        kept = cut_lineage(_looked_up(common, fulls, [*place, "full"], _summed(cores, "n"), "left").drop("n"))
        start = F.col("first") + F.col("shift")
        settled.append(kept.where("lone and chosen is not null").select(
            "doc_id", "mark", (start + F.col("begin")).alias("first"), (start + F.col("end") + F.lit(length)).alias("end")))
        rows = kept.where("lo < hi and (chosen is null or pointer = chosen)").withColumn(
            "lone", F.expr("lone and chosen is null")).select(*INTERVAL)
    return settled


def _summed(table: DataFrame, column: str) -> int:
    return table.agg(F.sum(column)).first()[0] or 0


def _looked_up(rows: DataFrame, table: DataFrame, keys: list[str], total: int, how: str = "inner") -> DataFrame:
    """``rows``, ``total`` in number, joined to a written ``table`` of one row a key, which ``n`` of them have.

    Fewer than ``HOT`` keys can hold more than a ``HOT``-th of the rows each: these few are
    sent to every task, and their rows stay where they are; the others meet by key.
    """
    hot = F.col("n") * HOT > total
    often, seldom = table.where(hot), table.where(~hot)
    spread = rows.join(F.broadcast(often.select(*keys)), keys, "left_anti").join(seldom, keys, how)
    return spread.unionByName(rows.join(F.broadcast(often), keys))


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, mark, spans): per row with repeats the places its repeated windows cover.

    ``docs`` has (doc_id, mark, text as bytes); equal (doc_id, mark) mean equal texts.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    key = f"doc_id {kind}, mark bigint"
    anchors = cut_lineage(docs.mapInArrow(
        lambda it: _scan(it, length),
        f"{key}, bucket bigint, context bigint, first int, windows int, shift int"))
    buckets = anchors.groupBy("bucket").agg(
        F.count("*").alias("n"), F.min("context").alias("low"), F.max("context").alias("high")).where("n > 1")
    buckets = cut_lineage(buckets.select("bucket", (F.col("low") != F.col("high")).alias("mixed"), "n"))
    total = anchors.count()
    end = (F.col("first") + F.col("windows") + F.lit(length - 1)).alias("end")
    rows = cut_lineage(_looked_up(anchors, buckets, ["bucket"], total).drop("n"))
    settled = rows.where("not mixed").select("doc_id", "mark", "first", end)

    # Mixed buckets: one row for each context, counted; the least pointer stands for equal ones.
    mixed = rows.where("mixed").withColumn("pointer", F.xxhash64("doc_id", "mark", "first"))
    contexts = cut_lineage(mixed.groupBy("bucket", "context").agg(F.count("*").alias("copies"), F.min("pointer").alias("chosen")))
    sizes = cut_lineage(contexts.groupBy("bucket").agg(F.count("*").alias("n")))
    sized = _looked_up(contexts, sizes, ["bucket"], contexts.count()).withColumnsRenamed({"n": "contexts", "copies": "n"})
    mixed = _looked_up(mixed, cut_lineage(sized), ["bucket", "context"], _summed(contexts, "copies"))
    settled = settled.union(mixed.where("n > 1").select("doc_id", "mark", "first", end))
    todo = mixed.where("n = 1 or pointer = chosen").groupBy("doc_id", "mark").agg(F.collect_list(F.struct(
        "bucket", "first", "windows", "shift", (F.col("n") == 1).alias("lone"), "contexts")).alias("todo"))
    same = F.expr("doc_id <=> todo_id and mark = todo_mark")
    cut_out = cut_lineage(
        docs.join(todo.withColumnsRenamed({"doc_id": "todo_id", "mark": "todo_mark"}), same)
        .select("doc_id", "mark", "text", "todo")
        .mapInArrow(lambda it: _cut_out(it, length),
                    f"{key}, bucket bigint, first int, shift int, lone boolean, contexts bigint, bytes binary"))
    small = cut_out.where(F.col("contexts") <= SMALL).repartition("bucket").sortWithinPartitions("bucket")
    refined = small.mapInArrow(lambda it: _refine(it, length), f"{key}, first int, end int")
    spans = settled.union(refined)
    for part in _by_halves(cut_out.where(F.col("contexts") > SMALL), key, length):
        spans = spans.union(part)
    return spans.groupBy("doc_id", "mark").agg(
        F.collect_list(F.struct("first", "end")).alias("spans"))


def without_repeats(docs: DataFrame, id_column: str = "doc_id", length: int = LENGTH, kept: bool = False) -> DataFrame:
    """Per row: n_bytes, n_removed, n_spans, kept_sha256, and with ``kept`` the bytes that stay."""
    kind = docs.schema[id_column].dataType.simpleString()
    text = whole().cast("binary")
    rows = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    spans = repeated_spans(rows, length).withColumnsRenamed({"doc_id": "span_id", "mark": "span_mark"})
    joined = rows.join(spans, F.expr("doc_id <=> span_id and mark = span_mark"), "left").select("doc_id", "text", "spans")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * kept

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names[1:]]
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                text = text.as_py()
                spans = found.values
                first, end = ((), ()) if spans is None else _merged(*(spans.field(i).to_numpy() for i in range(2)))
                edges = [0, *(int(x) for pair in zip(first, end, strict=True) for x in pair), len(text)]
                stays = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                values = (len(text), len(text) - len(stays), len(first), hashlib.sha256(stays).hexdigest(), stays)
                for column, value in zip(out, values, strict=False):
                    column.append(value)
            kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, t) for x, t in zip(out, kinds, strict=False))], names)

    schema = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * kept
    return joined.mapInArrow(cut, schema).withColumnRenamed("doc_id", id_column)
