"""Operator 4, WARC derivative builder.

Each response record gives two linked records: ``metadata`` (title, language, outlinks and the source's
headers, as warc-fields) and ``conversion`` (plain text). Both name the response in WARC-Refers-To, keep
its target URI and date, and carry digests of their own block; the source's payload digest stays with them.
Record ids are name-based, so a rerun or a retried task writes the same ones.

Mark-up is read in one pass, whatever it is like: a tag that never closes is text, and what its search has
seen is not searched again, so a page takes time in proportion to its length.

Defined cases: null or empty html gives an empty conversion and metadata without links; a null URL
gives records without a target URI; unclosed comments and scripts end with the page, an unclosed tag is
text; a very long page is a step of its own; equal rows give equal records; an empty table or file gives
an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as htmllib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import byte_steps, table

VERSION = "WARC/1.1"
#: Date of records made from tables that have none.
DATE = "2024-01-01T00:00:00Z"
#: Elements whose content is not text, and those that end a line.
RAW = ("script", "style", "noscript", "template", "textarea", "iframe")
BLOCK = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split())
_HEAD = re.compile(r"""<(/?)([a-zA-Z][^\s/<>"']*)""")
_STOP = re.compile(r"""[>"']""")
_HREF = re.compile(r"""\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_LANG = re.compile(r"""\blang\s*=\s*["']?([\w-]+)""", re.I)
_SPACE = re.compile(r"[ \t\r\f\v\xa0]+")


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(31).join(parts))}>"


class _Ends:
    """Ends of tags of one page: the first ``>`` outside quotes. What led to none is remembered."""

    def __init__(self, page: str):
        self.page, self.dead, self.seen = page, set(), (-1, -1)  # seen: from a place on, where the next stop is
        self.last = {q: page.rfind(q) for q in "\"'"}

    def _stop(self, pos: int) -> int:
        if not self.seen[0] <= pos <= self.seen[1]:
            m = _STOP.search(self.page, pos)
            self.seen = (pos, m.start() if m else len(self.page))
        return self.seen[1]

    def find(self, pos: int) -> int:
        """Place of the end of the tag whose attributes begin at ``pos``, or -1."""
        path = []
        while (at := self._stop(pos)) < len(self.page) and at not in self.dead:
            c = self.page[at]
            if c == ">":
                return at
            path.append(at)
            if at >= self.last[c]:
                break
            pos = self.page.find(c, at + 1) + 1
        self.dead.update(path)
        return -1


def extract(page: str) -> tuple[str, str, str, list[str]]:
    """(text, title, language, links) in one pass."""
    out, links, title, lang, pos, n = [], [], None, "", 0, len(page)
    low, ends = None, _Ends(page)
    while pos < n:
        i = page.find("<", pos)
        if i < 0:
            out.append(page[pos:])
            break
        out.append(page[pos:i])
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            pos = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), i):
            end = page.find(">", i)
            pos = n if end < 0 else end + 1
            continue
        m = _HEAD.match(page, i)
        end = ends.find(m.end()) if m else -1
        if end < 0:
            out.append("<")
            pos = i + 1
            continue
        inside, pos, name = page[m.end() : end], end + 1, m[2].lower()
        if name in RAW and not m[1]:
            low = low if low is not None else page.lower()
            end = low.find(f"</{name}", pos) if len(low) == n else page.find(f"</{name}", pos)
            pos = n if end < 0 else end
        elif name == "title" and not m[1] and title is None:
            end = page.find("<", pos)
            title, pos = page[pos : n if end < 0 else end], n if end < 0 else end
        elif name == "a" and not m[1]:
            if h := _HREF.search(inside):
                links.append(htmllib.unescape(next(g for g in h.groups() if g is not None)).strip())
        elif name == "html" and not lang and (h := _LANG.search(inside)):
            lang = h[1]
        if name in BLOCK:
            out.append("\n")
    lines = (_SPACE.sub(" ", x).strip() for x in htmllib.unescape("".join(out)).split("\n"))
    return "\n".join(x for x in lines if x), " ".join(htmllib.unescape(title or "").split()), lang, links


def responses(pages: DataFrame) -> DataFrame:
    """Response records of a table (page_id, url, html)."""
    head = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    return pages.select("page_id", F.col("url").alias("target_uri"), F.lit(DATE).alias("date"), head.alias("http_header"), F.coalesce("html", F.lit("")).alias("payload"))


RESPONSE_COLUMNS = ("record_id", "target_uri", "date", "http_header", "payload")
DERIVED = "warc_type string, record_id string, refers_to string, target_uri string, date string, content_type string, source_header string, source_payload_digest string, block_digest string, content_length bigint, n_links int, block string"


def _derive(key: str, has_id: bool):
    def run(batches):
        for whole in batches:
            for lo, hi in byte_steps(whole.column("payload")):
                yield _derived(whole.slice(lo, hi - lo), key, has_id)

    return run


def _derived(batch: pa.RecordBatch, key: str, has_id: bool) -> pa.RecordBatch:
    rows = {c: [] for c in [key, *(x.split()[0] for x in DERIVED.split(", "))]}
    source = [batch.column(c).to_pylist() for c in (key, "target_uri", "date", "http_header", "payload")]
    given = batch.column("record_id").to_pylist() if has_id else [None] * batch.num_rows
    for own, (k, uri, date, header, payload) in zip(given, zip(*source)):
        raw = payload if isinstance(payload, bytes) else (payload or "").encode("utf-8", "surrogatepass")
        page = payload if isinstance(payload, str) else raw.decode("utf-8", "replace")
        src, mark = own or record_id("response", str(k), uri or ""), digest(raw)
        text, title, lang, links = extract(page)
        fields = [("title", title), ("language", lang), ("source-payload-digest", mark)] + [("source-header", x) for x in (header or "").split("\r\n") if x] + [("outlink", x) for x in links]
        meta = "".join(f"{a}: {' '.join(b.split())}\r\n" for a, b in fields if b)
        for kind, content, block in (("metadata", "application/warc-fields", meta), ("conversion", "text/plain; charset=utf-8", text)):
            data = block.encode("utf-8", "surrogatepass")
            for c, v in zip(rows, (k, kind, record_id(kind, src), src, uri, date, content, header, mark, digest(data), len(data), len(links), block)):
                rows[c].append(v)
    kinds = {"content_length": pa.int64(), "n_links": pa.int32(), key: batch.schema.field(key).type}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(c, pa.string())) for c, v in rows.items()], list(rows))


def derive(records: DataFrame, key: str = "page_id") -> DataFrame:
    """Metadata and conversion records of response records (``key``, target_uri, date, http_header, payload[, record_id])."""
    has_id = "record_id" in records.columns
    cols = [key, "target_uri", "date", "http_header", "payload", *["record_id"] * (has_id and key != "record_id")]
    return records.select(*cols).mapInArrow(_derive(key, has_id), f"`{key}` {records.schema[key].dataType.simpleString()}, {DERIVED}" if key != "record_id" else DERIVED)


def as_text(derived: DataFrame) -> DataFrame:
    """One column ``value``: each record with its WARC header."""
    line = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(c).cast("string"), F.lit("\r\n"))).otherwise("")
    pairs = (("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("WARC-Block-Digest", "block_digest"), ("WARC-Source-Payload-Digest", "source_payload_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"))
    return derived.select(F.concat(F.lit(f"{VERSION}\r\n"), *[line(*p) for p in pairs], F.lit("\r\n"), F.col("block")).alias("value"))


def write_warc(derived: DataFrame, path: str, compression: str = "none") -> None:
    """WARC files, one a task: records end with two line breaks, which the text writer sets."""
    as_text(derived).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def _headers(head: bytes) -> dict[str, str]:
    out = {}
    for x in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = x.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def parse(data: bytes):
    """(headers, block) of every record of a WARC file, gzipped by record or file or not at all."""
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    pos = 0
    while (pos := data.find(b"WARC/", pos)) >= 0:
        end = data.find(b"\r\n\r\n", pos)
        if end < 0:
            return
        headers = _headers(data[pos:end])
        size = int(headers.get("content-length", 0))
        yield headers, data[end + 4 : end + 4 + size]
        pos = end + 4 + size


def _response(headers: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    return (*(headers.get(c) for c in ("warc-record-id", "warc-target-uri", "warc-date")), http.decode("utf-8", "replace") + "\r\n\r\n", payload)


def _batch(rows: list[tuple], path: list[str], whole: list[bool]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(RESPONSE_COLUMNS)
    kinds = [pa.string()] * 4 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)] + [pa.array(path, pa.string()), pa.array(whole, pa.bool_())], [*RESPONSE_COLUMNS, "path", "whole"])


def _pieces(batches):
    """Responses of records split from their file; ``whole`` is false in a row for a piece that is not as long as its header says."""
    for batch in batches:
        for lo, hi in byte_steps(batch.column("record")):
            rows, paths, whole = [], [], []
            for piece, path in zip(batch.column("record").slice(lo, hi - lo).to_pylist(), batch.column("path").slice(lo, hi - lo).to_pylist()):
                head, found, block = piece.partition(b"\r\n\r\n")
                headers = _headers(head) if found else {}
                size = int(headers["content-length"]) if headers.get("content-length", "").isdigit() else -1
                fits = size >= 0 and len(block) >= size and not block[size:].strip(b"\r\n")
                if piece.strip() and (not fits or headers.get("warc-type") == "response"):
                    rows.append(_response(headers, block[:size]) if fits else (None,) * len(RESPONSE_COLUMNS))
                    paths.append(path)
                    whole.append(fits)
            yield _batch(rows, paths, whole)


def _read(batches):
    for batch in batches:
        for data in batch.column("content").to_pylist():
            rows = [_response(h, b) for h, b in parse(data) if h.get("warc-type") == "response"]
            yield _batch(rows, [None] * len(rows), [True] * len(rows))


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Response records of WARC files, plain or gzipped.

    Records are rows of a text read with the mark between records as line separator, so plain files are split
    and no file is held whole. A file with a record that is not as long as its header says (the mark within a page)
    is read once more, as a whole and by lengths alone.
    """
    kind = "record_id string, target_uri string, date string, http_header string, payload binary, path string, whole boolean"
    text = spark.read.option("lineSep", "\r\n\r\nWARC/1.").text(path)
    pieces = text.select(F.col("value").cast("binary").alias("record"), F.col("_metadata.file_path").alias("path")).mapInArrow(_pieces, kind)
    odd = [r[0] for r in pieces.filter("NOT whole").select("path").distinct().collect()]  # names of files
    if not odd:
        return pieces.select(*RESPONSE_COLUMNS)
    files = spark.read.format("binaryFile").load(odd).select("content").mapInArrow(_read, kind)
    return pieces.filter(~F.col("path").isin(odd)).unionByName(files).select(*RESPONSE_COLUMNS)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both derived records of every page."""
    return derive(responses(table(spark, sf_dir, "pages"))).drop("source_header")
