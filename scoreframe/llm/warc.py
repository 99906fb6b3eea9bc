"""WARC derivatives: a metadata and a plain-text conversion record for each response.

Both records refer to the response they come from (WARC-Refers-To), keep its target URI,
date and payload digest, and carry digests of their own blocks. A response that brings its
own record id and payload digest keeps both; else they are made from it. The metadata record lists
the response's HTTP headers, title and links as warc-fields; the conversion record holds the
page's text. Record ids are name-based: the same response always gives the same ids, so a
task that runs again writes the same records. ``serialized`` makes each record one gzip
member, ``parsed`` reads such members back, and ``responses`` reads the response records of
a table of members.

Defined results: a response without payload has an empty one; without URI or date these
headers are left out; a member that is damaged or no HTTP response gives no response;
equal responses give equal records; an empty table gives no record;
extra columns are not looked at. Scans of the page are linear in its length.
"""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HIDDEN = ("script", "style", "noscript", "template")
BREAKING = frozenset("address article aside blockquote br dd div dl dt footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th title tr ul".split())
NAMES = ["id", "warc_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type",
         "source_payload_digest", "block_digest", "n_bytes", "block"]
RECORD = ("warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, "
          "source_payload_digest string, block_digest string, n_bytes bigint, block string")


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*of: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(of))}>"


#: A comment, or the opening tag of an element that is never shown; its name must end there.
OPENING = re.compile(rf"(?i)<!--|<(?P<name>{'|'.join(HIDDEN)})(?=[\s/>])[^<>]*>?")
#: Where an element ends; templates and noscript hold markup, so comments in them hide an end.
CLOSING = {n: re.compile(rf"(?i){'<!--|' if n in ('noscript', 'template') else ''}</{n}(?=[\s/>])[^<>]*>?") for n in HIDDEN}


def visible(page: str) -> str:
    """The page without comments and without elements that are never shown, in one pass from left to right.

    Of a comment or element without an end only the opening goes.
    """
    out, at = [], 0
    endless: set[str] = set()  # no end of these is left in the page

    def end_of(name: str, begin: int, after: int) -> int:
        """Where a comment (no name) or element ends, else -1; each fails once at most."""
        if name in endless:
            return -1
        if name:
            while (close := CLOSING[name].search(page, after)) and close.group() == "<!--":
                after = max(end_of("", close.start(), 0), close.end())
            end = close.end() if close else -1
        else:  # the dashes of an opening may be those of its end: <!--> and <!---> are whole
            found = page.find("-->", begin + 2)
            end = found + 3 if found >= 0 else -1
        if end < 0:
            endless.add(name)
        return end

    while found := OPENING.search(page, at):
        out.append(page[at:found.start()])
        at = max(end_of((found.group("name") or "").lower(), found.start(), found.end()), found.end())
    return "".join(out) + page[at:] if out else page


class Pages:
    """Text, title and links of pages; one instance serves one task."""

    def __init__(self) -> None:
        self.tag = re.compile(r"<(/?[A-Za-z!?][^<>]*)>")
        self.link = re.compile(r"""(?i)<a\s[^<>]*?\bhref\s*=\s*(?:"([^"<>]*)"|'([^'<>]*)'|([^\s"'<>]+))""")
        self.title = re.compile(r"(?i)<title[^<>]*>([^<]*)")
        self.blanks = re.compile(r"[^\S\n]+")

    def _break(self, m: re.Match) -> str:
        name = m.group(1).lstrip("/").split(None, 1)
        return "\n" if name and name[0].rstrip("/").lower() in BREAKING else ""

    def read(self, page: str, base: str | None) -> tuple[str, str, list[str]]:
        shown = visible(page)
        title = self.title.search(shown)
        links = []
        for m in self.link.finditer(shown):
            target = html.unescape(next(x for x in m.groups() if x is not None)).strip()
            try:
                links.append(urljoin(base or "", target))
            except ValueError:  # not a URL at all
                links.append(target)
        lines = (self.blanks.sub(" ", x).strip() for x in html.unescape(self.tag.sub(self._break, shown)).split("\n"))
        named = " ".join(html.unescape(title.group(1)).split()) if title else ""
        return "\n".join(x for x in lines if x), named, list(dict.fromkeys(links))


def derived(responses: DataFrame, id_column: str = "id", record_column: str | None = None,
            digest_column: str | None = None) -> DataFrame:
    """Two records for each response (id, uri, date, headers, payload), linked to its record id.

    ``headers`` are the HTTP header lines of the response as one string. ``record_column`` and
    ``digest_column`` name columns with the response's own record id and payload digest; where
    they are missing or NULL, both are derived.
    """
    kind = responses.schema[id_column].dataType.simpleString()

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages = Pages()
        for batch in batches:
            rows = []
            for key, uri, date, headers, payload, own_id, own_digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = payload or ""
                raw = payload.encode("utf-8", "surrogatepass")
                source_digest = own_digest or digest(raw)
                source = own_id or record_id("response", str(key), uri or "", date or "", source_digest)
                text, title, links = pages.read(payload, uri)
                fields = [f"source-header: {x}" for x in (headers or "").splitlines() if x.strip()]
                fields += [f"title: {title}"] * bool(title) + [f"outlink: {' '.join(x.split())}" for x in links]
                for warc_type, content_type, block in (
                        ("metadata", "application/warc-fields", "".join(f"{x}\r\n" for x in fields)),
                        ("conversion", "text/plain; charset=utf-8", text)):
                    own = block.encode("utf-8", "surrogatepass")
                    rows.append((key, warc_type, record_id(warc_type, source), source, uri, date, content_type,
                                 source_digest, digest(own), len(own), block))
            kinds = [batch.schema.field(0).type, *[pa.string()] * 8, pa.int64(), pa.string()]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], NAMES)

    text = [F.col(c).cast("string").alias(c) for c in ("uri", "date", "headers", "payload")]
    given = [(F.col(c) if c else F.lit(None)).cast("string").alias(f"own_{i}") for i, c in enumerate((record_column, digest_column))]
    return responses.select(F.col(id_column).alias("id"), *text, *given).mapInArrow(
        of_batches, f"id {kind}, {RECORD}").withColumnRenamed("id", id_column)


def record_bytes(row) -> bytes:
    """One record as a gzip member."""
    block = (row["block"] or "").encode("utf-8", "surrogatepass")
    lines = [("WARC-Type", row["warc_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Refers-To", row["refers_to"]),
             ("WARC-Target-URI", row["target_uri"]), ("WARC-Date", row["warc_date"]),
             ("WARC-Source-Payload-Digest", row["source_payload_digest"]),
             ("WARC-Block-Digest", row["block_digest"]), ("Content-Type", row["content_type"]), ("Content-Length", len(block))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines if v is not None)
    return gzip.compress(head.encode() + b"\r\n" + block + b"\r\n\r\n", mtime=0)


def serialized(records: DataFrame) -> DataFrame:
    """(record_id, member): each record as a gzip member; members in any order make a WARC file."""
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["record_id"] for r in rows], pa.string()), pa.array(list(map(record_bytes, rows)), pa.binary())],
                ["record_id", "member"])

    return records.select(*NAMES[1:]).mapInArrow(of_batches, "record_id string, member binary")


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one gzip member."""
    head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
    named = (line.partition(":") for line in head.decode().split("\r\n")[1:])
    headers = {name: value.strip() for name, _, value in named}
    return headers, rest[:int(headers["Content-Length"])]


def _charset(headers: str) -> str:
    found = re.search(r"(?i)^content-type:[^\r\n]*charset=[\"']?([\w-]+)", headers, re.MULTILINE)
    try:
        return codecs.lookup(found.group(1)).name if found else "utf-8"
    except LookupError:
        return "utf-8"


def responses(members: DataFrame, column: str = "member") -> DataFrame:
    """(record_id, uri, date, payload_digest, headers, payload) of the response records among gzip members.

    The HTTP header block is split from the body, which is read in its own character set.
    """
    names = ["record_id", "uri", "date", "payload_digest", "headers", "payload"]
    fields = ("WARC-Record-ID", "WARC-Target-URI", "WARC-Date", "WARC-Payload-Digest")

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for member in batch.column(0).to_pylist():
                try:
                    about, block = parsed(member or b"")
                except (OSError, EOFError, ValueError, KeyError, zlib.error):
                    continue
                head, found, body = block.partition(b"\r\n\r\n")
                if about.get("WARC-Type") != "response" or not head.startswith(b"HTTP/"):
                    continue
                headers = head.decode("latin-1")
                rows.append((*map(about.get, fields), headers, body.decode(_charset(headers), "replace")))
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names)

    return members.select(F.col(column).cast("binary")).mapInArrow(of_batches, ", ".join(f"{n} string" for n in names))
