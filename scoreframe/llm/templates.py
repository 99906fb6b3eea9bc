"""Benchmark decontamination that sees through changed numbers, names and units.

Texts are made templates: numbers and units after numbers become typed placeholders, other
words are lower-cased and lose punctuation. Whether a capitalised word is a name depends on
what stands before it, which a copy need not keep. So each window has up to three forms, on
both sides: no word a name (any case matches), capitalised words inside a sentence as names,
and all capitalised words as names.
Windows of ``window`` template tokens are joined by hash with the windows of the benchmark
items (an item shorter than a window is one window), and then compared token by token. In a
window with fewer than ``literal`` plain words the placeholders keep their values, so dense
numbers match as they stand and never by their pattern alone. Windows of a document and an item on one diagonal belong
to one copy, and so do those on diagonals ``SHIFT`` apart or less, as a name of two words for
one of one word moves the rest. A copy counts if it covers ``share`` of the item's tokens, or ``run`` tokens, and
its changed slots are consistent: each value of the item that changed stands for one value of
the document and the other way round. So a question with its numbers changed is found, and
two texts that only share a pattern of numbers are not. Where changed slots clash, windows
that are the same, values included, still count as a copy of their own, and so does the
longest consistent stretch with them, by its unchanged tokens alone and from ``run`` on.

The item windows' hashes are marked in a bitmap of fixed size (``1 << BITMAP`` bits), which
is all that is sent to every task; document windows it lets through are joined by key, so
false marks cost rows and no results. The benchmark may have any size.

Defined results: a missing or empty text, on either side, has no window; equal rows give
equal pairs (one for each id); an empty table gives no pair; a missing id never gets one;
extra columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreframe.llm.text import row_key, unused
from scoreframe.session import cut_lineage

WINDOW, LITERAL = 8, 4
SHARE, RUN = 0.5, 16
SHIFT = 2
BITMAP = 24
TOGETHER = 1 << 17  # characters of texts that are searched in one go

NUMBER, UNIT, NAME = b"\x01", b"\x02", b"\x03"
SLOTS = frozenset((NUMBER, UNIT, NAME))
FIRST = b"\x04"  # before a capitalised word that need not be a name
#: The kinds of slots: the bytes above. A form of a text has the slots up to a kind.
FORMS = PLAIN, INSIDE, ALL = 2, 3, 4
#: Units of measure and money, fixed values.
UNITS = ("%", "°C", "°F", "km/h", "kWh", "km", "kg", "cm", "mm", "ml", "mg", "mph", "min", "hours", "hour", "days", "day",
         "years", "year", "meters", "metres", "miles", "feet", "dollars", "euros", "cents", "USD", "EUR", "m", "g", "s", "h", "l")


def slot_pattern() -> re.Pattern:
    """Groups: a number with its money sign or a name, a unit after a number, and '' for a name inside a sentence.

    It starts with one set of characters, as the search then passes over all others at once.
    """
    unit, capital = "|".join(re.escape(u) for u in UNITS), "[A-ZÀ-ÖØ-Þ]"
    return re.compile(rf"([$€£\dA-ZÀ-ÖØ-Þ](?:(?:(?<=\d)|(?<=[$€£])\d)\d*(?:[.,]\d+)*(?:\s?({unit})(?!\w))?"
                      rf"|(?:(?<=[\w,;:]\x20{capital})()|(?<={capital})(?<!\w{capital}))[a-zß-ÿ]+(?!\w)))")


def separators() -> bytes:
    """ASCII characters that are no letter, digit or placeholder become blanks."""
    keep = set(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789\x01\x02\x03\x04") | set(range(128, 256))
    return bytes(c if c in keep else 32 for c in range(256))


class Templates:
    """Makes templates of texts; one instance serves one task."""

    def __init__(self) -> None:
        self.pattern, self.table = slot_pattern(), separators()

    def __call__(self, text: str) -> tuple[bytes, list[str]]:
        """The template as bytes, a kind of slot before each slot's token, and the slots' values."""
        if any(c in text for c in "\x01\x02\x03\x04"):
            text = re.sub("[\x01-\x04]", " ", text)
        parts = self.pattern.split(text)
        out, values = parts[:1], []
        for slot, unit, inside, rest in zip(parts[1::4], parts[2::4], parts[3::4], parts[4::4], strict=True):
            if slot[-1].isalpha() and unit is None:
                out += (" \x04" if inside is None else " \x03", slot, rest)
                values.append(slot)
            elif unit is None:
                out += (" \x01 ", rest)
                values.append(slot.lstrip("$€£"))
            else:
                out += (" \x01 \x02 ", rest)
                values += (slot[:-len(unit)].rstrip().lstrip("$€£"), unit)
        return "".join(out).lower().encode("utf-8", "surrogatepass").translate(self.table), values


def token_ids(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, tokens), dtype=np.uint64, count=len(tokens))


def window_hashes(ids: np.ndarray, window: int) -> np.ndarray:
    n = len(ids) - window + 1
    out = np.full(max(n, 0), np.uint64(window))
    for i in range(window if n > 0 else 0):
        out ^= ids[i:i + n]
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def in_windows(chosen: np.ndarray, window: int) -> np.ndarray:
    """How many tokens of each window are chosen."""
    before = np.zeros(len(chosen) + 1, dtype=np.int64)
    np.cumsum(chosen, out=before[1:])
    return before[window:] - before[:-window]


class Forms:
    """The forms of some texts, whose templates follow each other; windows lie within one of them."""

    def __init__(self, keys: list, templates: list[bytes], values: list[list[str]]) -> None:
        joined = b" ".join([b"", *templates])
        shown = np.frombuffer(joined, dtype=np.uint8)
        starts = np.flatnonzero((shown[:-1] == 32) & (shown[1:] != 32)) + 1
        kinds = shown[starts]
        self.kinds = np.where(kinds <= ALL, kinds, 0)
        self.tokens = joined.translate(None, NAME + FIRST).split()
        self.ids = token_ids(self.tokens)
        self.values = [v for own in values for v in own]
        self.value = np.cumsum(self.kinds > 0) - 1
        self.keys = keys
        sizes = np.array([len(t) + 1 for t in templates])
        self.edges = np.searchsorted(starts, np.r_[0, np.cumsum(sizes)])  # first tokens of the texts, and the end
        self.text = np.repeat(np.arange(len(keys)), np.diff(self.edges))

    def exact(self, k: int) -> bytes:
        """A token, a number or unit followed by its value."""
        if 0 < self.kinds[k] <= PLAIN:
            return self.tokens[k] + self.values[self.value[k]].encode("utf-8", "surrogatepass")
        return self.tokens[k]

    def exact_hashes(self, few: np.ndarray, window: int) -> np.ndarray:
        """The hashes of the given windows with values; others stay unmade."""
        ids = self.ids.copy()
        near = np.zeros(len(ids) + 1, dtype=np.int64)
        np.add.at(near, few, 1)
        np.add.at(near, few + window, -1)
        for k in np.flatnonzero((np.cumsum(near[:-1]) > 0) & (self.kinds > 0) & (self.kinds <= PLAIN)).tolist():
            ids[k] = zlib.crc32(self.exact(k))
        return window_hashes(ids, window)[few]

    def rows(self, window: int, literal: int, marked: np.ndarray | None) -> Iterator[tuple]:
        """The windows of all forms, or those of them whose hash is marked; a form equal to one before it is left out."""
        if len(self.ids) < window:
            return
        fits = self.text[window - 1:] == self.text[:len(self.ids) - window + 1]
        for form in FORMS:
            few = in_windows((self.kinds > 0) & (self.kinds <= form), window) > window - min(literal, window)
            if form == PLAIN:
                hashes = window_hashes(self.ids, window)
                dense = np.flatnonzero(few)
                if len(dense):
                    hashes[dense] = self.exact_hashes(dense, window)
                own = fits
            else:
                own = fits & (in_windows(self.kinds == form, window) > 0) & ~few
                if not own.any():
                    continue
                named = (self.kinds > PLAIN) & (self.kinds <= form)
                hashes = window_hashes(np.where(named, np.uint64(zlib.crc32(NAME)), self.ids), window)
            if marked is not None:
                own = own & marked[(hashes >> np.uint64(64 - BITMAP)).view(np.int64)]
            for p in np.flatnonzero(own).tolist():
                if form == PLAIN and few[p]:
                    template, slots = [self.exact(k) for k in range(p, p + window)], []
                else:
                    kinds = self.kinds[p:p + window].tolist()
                    template = [NAME if PLAIN < k <= form else t for t, k in zip(self.tokens[p:p + window], kinds, strict=True)]
                    slots = [self.values[self.value[p + k]] for k, kind in enumerate(kinds) if 0 < kind <= form]
                first, end = self.edges[self.text[p]:self.text[p] + 2].tolist()
                yield self.keys[self.text[p]], int(hashes[p].view(np.int64)), p - first, b" ".join(template), slots, window, form, end - first


def together(texts: Iterator[tuple], size: int) -> Iterator[list[tuple]]:
    """(key, text) pairs in lists of about ``size`` characters, as each list costs some calls of its own."""
    held, length = [], 0
    for key, text in texts:
        if text:
            held.append((key, text))
            length += len(text)
        if held and length >= size:
            yield held
            held, length = [], 0
    if held:
        yield held


def _windows(rows: DataFrame, marks: dict[int, bytes] | None, window: int, literal: int) -> DataFrame:
    """(id, hash, place, template, slots, width, form, tokens) of the windows of (id, text) rows.

    Without ``marks`` all windows of an item, a short item as one; with them, for each of
    their widths, the windows whose hash is marked.
    """
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", "hash", "place", "template", "slots", "width", "form", "tokens"]

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Templates()
        bits = {w: np.unpackbits(np.frombuffer(b, dtype=np.uint8), bitorder="little").view(bool) for w, b in (marks or {}).items()}
        for batch in batches:
            out: list[tuple] = []
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for some in together(pairs, TOGETHER if marks is not None else 1):
                forms = Forms([key for key, _ in some], *zip(*(make(text) for _, text in some), strict=True))
                for width in [min(window, len(forms.tokens))] if marks is None else bits:
                    if width:
                        out += forms.rows(width, literal, None if marks is None else bits[width])
            types = [batch.schema.field(0).type, pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.string()), *[pa.int32()] * 3]
            columns = zip(*out, strict=True) if out else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return rows.mapInArrow(of_batches, f"id {kind}, hash bigint, place int, template binary, slots array<string>, width int, form int, tokens int")


def _marks(windows: DataFrame) -> dict[int, bytes]:
    """Per width the bitmap of marked hashes, gathered in words of 64 bits: 1 << BITMAP bits at most."""
    bit = F.shiftrightunsigned("hash", 64 - BITMAP)
    words = windows.groupBy("width", F.shiftrightunsigned(bit, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - BITMAP}) & 63 as int))")).alias("bits"))
    out: dict[int, np.ndarray] = {}
    for width, word, bits in words.toLocalIterator():
        out.setdefault(width, np.zeros(1 << (BITMAP - 6), dtype="<i8"))[word] = bits
    return {width: words.tobytes() for width, words in out.items()}


class Pair(NamedTuple):
    """A window of an item that a document has too: its place, its changed slots and the wider form of the two."""

    place: int
    changed: dict[int, tuple[str, str]]  # place in the item: value there and in the document
    form: int


def pair_of(place: int, template: bytes, item_slots: list[str], slots: list[str], form: int) -> Pair:
    at = [place + k for k, t in enumerate(template.split(b" ")) if t in SLOTS]
    return Pair(place, {p: (x, y) for p, x, y in zip(at, item_slots, slots, strict=False) if x != y}, form)


def one_to_one(values: set[tuple[str, str]]) -> bool:
    return len({x for x, _ in values}) == len({y for _, y in values}) == len(values)


def covered(pairs: list[Pair], width: int) -> int:
    """Tokens of the item in windows sorted by place."""
    return sum(min(width, after.place - own.place) for own, after in zip(pairs, pairs[1:], strict=False)) + (width if pairs else 0)


def longest_consistent(pairs: list[Pair], width: int) -> list[Pair]:
    """The windows in a row, sorted by place, whose changed slots agree and that have most unchanged tokens."""
    reach = np.cumsum([0, *(min(width, b.place - a.place) for a, b in zip(pairs, pairs[1:], strict=False))])
    changed = sorted({p for x in pairs for p in x.changed})
    best, chosen, low = 0, (0, 0), 0
    there: dict[str, Counter] = defaultdict(Counter)
    back: dict[str, Counter] = defaultdict(Counter)
    for high, pair in enumerate(pairs):
        own = set(pair.changed.values())
        for x, y in own:
            there[x][y] += 1
            back[y][x] += 1
        while low <= high and any(len(there[x]) > 1 or len(back[y]) > 1 for x, y in own):
            for x, y in set(pairs[low].changed.values()):
                for counts, key, value in ((there, x, y), (back, y, x)):
                    counts[key][value] -= 1
                    if not counts[key][value]:
                        del counts[key][value]
            low += 1
        if low <= high:
            lost = bisect_left(changed, pair.place + width) - bisect_left(changed, pairs[low].place)
            same = int(reach[high] - reach[low]) + width - lost
            if same > best:
                best, chosen = same, (low, high + 1)
    return pairs[slice(*chosen)]


def judge(pairs: list[Pair], width: int, tokens: int, share: float, run: int) -> tuple[int, int] | None:
    """(tokens matched, changed slots) of the windows of one copy, or None if they make no copy."""
    values = {v for x in pairs for v in x.changed.values()}
    matched, changed = covered(pairs, width), len(values)
    if not one_to_one(values):
        same = [x for x in pairs if not x.changed]
        matched, changed = covered(same, width), 0
        longest = longest_consistent(pairs, width)
        joined = sorted({x.place: x for x in (*same, *longest)}.values(), key=lambda x: x.place)
        unchanged = covered(joined, width) - len({p for x in longest for p in x.changed})
        if unchanged >= run and unchanged > matched:
            matched, changed = unchanged, len({v for x in longest for v in x.changed.values()})
    return (matched, changed) if matched >= run or matched >= share * tokens else None


def across(chain: list[list[Pair]]) -> list[Pair]:
    """The windows of neighbouring diagonals; a slot with a value on several, as a name of two words, has them all."""
    values: dict[int, dict[str, None]] = defaultdict(dict)
    for pairs in chain:
        for x in pairs:
            for p, (_, value) in x.changed.items():
                values[p][value] = None
    return [x._replace(changed={p: (own, " ".join(values[p])) for p, (own, _) in x.changed.items()}) for pairs in chain for x in pairs]


def judged(diagonals: list[tuple[int, list[Pair]]], width: int, tokens: int, share: float, run: int) -> tuple[int, int] | None:
    """The best copy on one diagonal or on neighbouring ones, with all forms or without the widest."""
    chains: list[list[list[Pair]]] = []
    last = None
    for diagonal, pairs in sorted(diagonals, key=lambda x: x[0]):
        if last is None or diagonal - last > SHIFT:
            chains.append([])
        chains[-1].append(pairs)
        last = diagonal
    best = None
    for chain in chains:
        for pairs in (*chain, *([across(chain)] if len(chain) > 1 else [])):
            narrow = [x for x in pairs if x.form < ALL]
            for some in (pairs, narrow) if len(narrow) < len(pairs) else (pairs,):
                # of the pairs at one place the one that changed least
                at = {x.place: x for x in sorted(some, key=lambda x: -len(x.changed))}
                found = judge([at[p] for p in sorted(at)], width, tokens, share, run)
                if found and (best is None or found[0] > best[0] or found[0] == best[0] and found[1] < best[1]):
                    best = found
    return best


def _judged(copies: DataFrame, share: float, run: int) -> DataFrame:
    """(id, item, matched, item_tokens, changed_slots) of the rows that make a copy."""
    names = ["id", "item", "matched", "item_tokens", "changed_slots"]
    kinds = {x: copies.schema[x].dataType.simpleString() for x in ("id", "item")}

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                diagonals = [(x["diagonal"], [pair_of(**w) for w in x["windows"]]) for x in row["diagonals"]]
                found = judged(diagonals, row["width"], row["item_tokens"], share, run)
                if found:
                    out.append((row["id"], row["item"], found[0], row["item_tokens"], found[1]))
            types = [batch.schema.field(0).type, batch.schema.field(1).type, *[pa.int32()] * 3]
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return copies.select("id", "item", "item_tokens", "width", "diagonals").mapInArrow(
        of_batches, f"id {kinds['id']}, item {kinds['item']}, matched int, item_tokens int, changed_slots int")


def leaks(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", item_column: str = "item_id",
          window: int = WINDOW, literal: int = LITERAL, share: float = SHARE, run: int = RUN) -> DataFrame:
    """(doc id, item id, tokens matched, share of the item, changed slots) of each pair with a copy."""
    of_items = cut_lineage(_windows(
        items.where(F.col(item_column).isNotNull()).select(F.col(item_column).alias("id"), F.col("text").cast("string").alias("text")),
        None, window, literal))
    rows = docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"), F.col("text").cast("string").alias("text"))
    found = _windows(rows, _marks(of_items), window, literal)
    asked = of_items.select(F.col("id").alias("item"), "hash", "width", F.col("template").alias("item_template"),
                            F.col("place").alias("item_place"), F.col("form").alias("item_form"), F.col("slots").alias("item_slots"), F.col("tokens").alias("item_tokens"))
    pairs = found.drop("tokens").join(asked, ["hash", "width"]).where("template = item_template")
    window_pair = F.struct(F.col("item_place").alias("place"), "template", "item_slots", "slots", F.greatest("item_form", "form").alias("form"))
    copies = pairs.groupBy("id", "item", (F.col("place") - F.col("item_place")).alias("diagonal"), "item_tokens", "width").agg(
        F.collect_set(window_pair).alias("windows"))
    copies = _judged(copies.groupBy("id", "item", "item_tokens", "width").agg(
        F.sort_array(F.collect_list(F.struct("diagonal", "windows"))).alias("diagonals")), share, run)
    best = copies.groupBy("id", "item").agg(F.max(F.struct("matched", "item_tokens", "changed_slots")).alias("best"))
    return best.select(
        F.col("id").alias(id_column), F.col("item").alias(item_column), F.col("best.matched").alias("matched_tokens"),
        (F.col("best.matched") / F.col("best.item_tokens")).alias("share"), F.col("best.changed_slots").alias("changed_slots"))


def without_leaks(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that hold no copy of an item, as they are."""
    key = row_key(id_column)
    found = cut_lineage(leaks(docs.select(key.alias("key"), "text"), items, "key", **options).select("key").distinct())
    name = unused(docs, "_leak_key")
    keyed = docs.withColumn(name, key)
    return keyed.join(found.withColumnRenamed("key", name), name, "left_anti").drop(name)
