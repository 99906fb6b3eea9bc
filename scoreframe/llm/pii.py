"""Personal data by patterns and a skip-chain conditional random field over each document.

Patterns give the base spans. The field then makes labels agree across a document. Its nodes
are the base spans, whose labels are fixed, and candidate segments between them: runs of at
least seven digits with separators, tokens with ``@`` inside and the user names of the base
mails (those of one to three letters left out, as they are words as well). Every node
has potentials for each label from its shape; neighbours in the text share a weak potential
for equal labels; skip edges join distant segments that repeat each other (the same digits,
the same last nine digits, the same name) or are similar (one digit apart) and share a
strong one. Loopy sum-product messages run over all edges until they settle (``settled`` says
whether they did within ``SWEEPS`` sweeps), and a candidate
whose marginal favours a label becomes a span of that kind. So a phone number without its
country code, a card number with one digit mistyped or a mail's user name is found in a
document that also holds the full form, and nothing is added where no pattern matched.

Skip edges go from each segment to the last one before it and to the first base span with
the same signature. Those that share a signature are equal in it, so the chain joins them all.
One digit apart is a signature too: the digits with that one place masked. A number has as many
as it has digits, so edges are linear in the text for numbers of bounded length, and a run of more
than ``LONGEST`` digits, which no pattern takes, has none. Every scan and every sweep is linear in the length
of the text; base spans send constant messages, so a span with very many repeats is no more work than its edges.

Defined results: a missing or empty text has no span; equal rows get equal results; an empty
table gives an empty result; a missing id is kept; extra columns are not looked at, and
``masked`` returns them as they are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive repeats never give characters back, which keeps each scan linear.
PATTERNS = {
    "domain": r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "dotted": r"[0-9]++(?:\.[0-9]++)*+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "digits": r"[+(]?[0-9](?:[\x20().-]{0,2}[0-9])++",
    "name": r"[A-Za-z0-9@._%+-]++",
}
REPEAT, SIMILAR, CHAIN = 3.0, 2.5, 0.2
OTHER_BIAS, MISFIT = 2.0, -8.0
SWEEPS, SETTLED = 1_000, 1e-6
LONGEST = 19  # digits of the longest card number


def patterns() -> dict[str, re.Pattern]:
    return {k: re.compile(v) for k, v in PATTERNS.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str, find: dict[str, re.Pattern]) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its test, by kind and start."""
    out: list[Span] = []
    done = at = 0
    while (at := text.find("@", max(at, done))) >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        host = find["domain"].match(text, at + 1) if start < at else None
        if host:
            out.append(("email", start, host.end()))
            done = host.end()
        at += 1
    # Four parts of a dotted chain at a time: what is left of a run never starts a match.
    for m in find["dotted"].finditer(text):
        parts = m.group().split(".")
        begin = m.start()
        for i in range(0, len(parts) - 3, 4):
            own = parts[i:i + 4]
            end = begin + sum(map(len, own)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in own):
                out.append(("ip", begin, end))
            begin = end + 1
    for m in find["card"].finditer(text):
        if m.end() - m.start() >= 13:
            digits = only_digits(m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    for m in find["phone"].finditer(text):
        if 9 <= len(only_digits(m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def candidates(text: str, base: list[Span], find: dict[str, re.Pattern]) -> list[tuple[int, int]]:
    """Segments outside the base spans that could be personal data."""
    taken = sorted((a, b) for _, a, b in base)
    out = []
    names = {text[a:b].split("@")[0].lower() for k, a, b in base if k == "email"}
    found = [m.span() for m in find["digits"].finditer(text) if len(only_digits(m.group())) >= 7]
    if names:
        for m in find["name"].finditer(text):
            own = m.group().strip(".-_")
            # one to three letters are ordinary words more often than a user
            if ("@" in own or own.lower() in names) and (len(own) >= 4 or not own.isalpha()):
                start = m.start() + m.group().index(own)
                found.append((start, start + len(own)))
    i, last = 0, -1
    for a, b in sorted(set(found)):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if a >= last and (i == len(taken) or taken[i][0] >= b):
            out.append((a, b))
            last = b
    return out


def named(segment: str) -> bool:
    """Whether a segment is a mail or a user, not a number."""
    return len(only_digits(segment)) < 7 or any(c == "@" or c.isalpha() for c in segment)


def _signatures(segment: str) -> list[tuple[str, float]]:
    """Signatures and the strength of an edge between two segments that share one."""
    digits = only_digits(segment)
    if named(segment):
        name = segment.split("@")[0].lower()
        return [(f"name:{name}", REPEAT)] if name else []
    out = [(f"all:{digits}", REPEAT)]
    if len(digits) >= 9:
        out.append((f"tail:{digits[-9:]}", REPEAT))
    if len(digits) <= LONGEST:  # one digit apart: equal but for the masked place
        out += [(f"but:{digits[:k]}*{digits[k + 1:]}", SIMILAR) for k in range(len(digits))]
    return out


def skip_edges(segments: list[str], fixed: list[bool]) -> list[tuple[int, int, float]]:
    """(earlier, later, strength) of segments that share a signature.

    Each is joined with the last one before it and with the first fixed one, wherever that is;
    of numbers that share a masked place any two are at most one digit apart.
    """
    own = [_signatures(s) for s in segments]
    anchor: dict[str, int] = {}
    for j, signatures in enumerate(own):
        if fixed[j]:
            for signature, _ in signatures:
                anchor.setdefault(signature, j)
    latest: dict[str, int] = {}
    edges: dict[tuple[int, int], float] = {}
    for j, signatures in enumerate(own):
        for signature, strength in signatures:
            for i in {latest.get(signature, j), anchor.get(signature, j)} - {j}:
                edge = (min(i, j), max(i, j))
                edges[edge] = max(strength, edges.get(edge, 0.0))
            latest[signature] = j
    return [(i, j, s) for (i, j), s in edges.items()]


def unary(segment: str) -> list[float]:
    """Log potentials of other, email, ip, card and phone for a candidate."""
    n = len(only_digits(segment))
    name = named(segment)
    fits = (name, not name and segment.count(".") >= 3 and n <= 12, not name and 12 <= n <= 19, not name and 7 <= n <= 15)
    return [OTHER_BIAS, *(0.0 if x else MISFIT for x in fits)]


def marginals(potentials: list[list[float]], edges: list[tuple[int, int, float]], labels: list[int | None]) -> tuple[np.ndarray, bool]:
    """Loopy sum-product with a bonus for equal labels on each edge; whether the messages settled.

    A node with a label keeps it. What it sends is the same in every sweep, so it goes into its neighbours'
    potentials and a hub of any degree costs one addition for each edge. Between the others, all messages of
    a sweep are made at once from each node's sum of logarithms, the message that came the other way taken out.
    """
    local = np.array(potentials, dtype=float)
    size = local.shape[1]
    fixed = np.array([-1 if k is None else k for k in labels])
    i, j = (np.array([e[k] for e in edges], dtype=np.int64) for k in (0, 1))
    bonus = np.expm1(np.array([e[2] for e in edges], dtype=float))
    for source, target in ((i, j), (j, i)):
        known = fixed[source] >= 0
        np.add.at(local, (target[known], fixed[source][known]), np.log1p(bonus[known]))
    free = (fixed[i] < 0) & (fixed[j] < 0)
    source, target, bonus = np.r_[i[free], j[free]], np.r_[j[free], i[free]], np.r_[bonus[free], bonus[free]]
    back = np.roll(np.arange(len(source)), len(source) // 2)
    sent = np.zeros((len(source), size))

    def totals() -> np.ndarray:
        return local + np.stack([np.bincount(target, sent[:, k], len(local)) for k in range(size)], axis=1)

    def shares(logs: np.ndarray) -> np.ndarray:
        p = np.exp(logs - logs.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    settled = not len(source)
    for _ in range(SWEEPS):
        if settled:
            break
        new = np.log1p(bonus[:, None] * shares(totals()[source] - sent[back]))
        new -= new.max(axis=1, keepdims=True)
        settled = bool(np.abs(new - sent).max() < SETTLED)
        sent = new
    belief = shares(totals())
    belief[fixed >= 0] = np.eye(size)[fixed[fixed >= 0]]
    return belief, settled


def added_spans(text: str, base: list[Span], find: dict[str, re.Pattern]) -> tuple[list[Span], bool]:
    """Spans the field adds to the base spans of one text, and whether its messages settled."""
    free = candidates(text, base, find) if base else []
    if not free:
        return [], True
    nodes = sorted([(a, b, k) for k, a, b in base] + [(a, b, None) for a, b in free], key=lambda n: (n[0], n[1], n[2] or ""))
    segments = [text[a:b] for a, b, _ in nodes]
    skips = skip_edges(segments, [n[2] is not None for n in nodes])
    if not any(nodes[i][2] is None or nodes[j][2] is None for i, j, _ in skips):
        return [], True  # neighbours alone never outweigh the bias to other
    chain = [(i, i + 1, CHAIN) for i in range(len(nodes) - 1)]
    labels = [None if k is None else 1 + KINDS.index(k) for _, _, k in nodes]
    found, settled = marginals([unary(s) for s in segments], skips + chain, labels)
    out = []
    for (a, b, label), belief in zip(nodes, found, strict=True):
        best = int(belief.argmax())
        if label is None and best and belief[best] > 0.5:
            out.append((KINDS[best - 1], a, b))
    return out, settled


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def personal_data(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Per row: base spans per kind, the digest of their list, all spans, how many were added, whether messages settled."""
    kind = docs.schema[id_column].dataType.simpleString()
    names = [id_column, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "settled"]

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = patterns()
        for batch in batches:
            out: list[list] = [[] for _ in names[1:]]
            for text in batch.column(1).to_pylist():
                base = base_spans(text, find) if text else []
                more, settled = added_spans(text, base, find) if base else ([], True)
                values = [sum(s[0] == k for s in base) for k in KINDS]
                values += [hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + more), len(more), settled]
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))], names)

    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    rows = docs.select(id_column, F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(of_batches, f"`{id_column}` {kind}, {counts}, base_sha256 string, spans string, n_added bigint, settled boolean")


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span, or several that overlap, replaced by the kind of the first."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"<{kind.upper()}>"]
        done = max(done, b)
    return "".join(out) + text[done:]


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of personal data in ``text`` replaced by its kind."""

    def of_series(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = patterns()
        for texts in batches:
            out = []
            for t in texts:
                base = base_spans(t, find) if t else []
                out.append(mask(t, base + added_spans(t, base, find)[0]) if base else t)
            yield pd.Series(out, dtype=object)

    return docs.withColumn(text, F.pandas_udf(of_series, "string")(F.col(text).cast("string")))
