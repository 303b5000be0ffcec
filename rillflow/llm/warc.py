"""WARC derivatives: metadata and plain-text conversion records made from response records.

Each conversion and metadata record refers to its response by WARC-Refers-To, and keeps the source's target URI, date,
block and payload digests. Record ids are name-based UUIDs, so a task that runs again makes the same records.
"""

from __future__ import annotations

import base64
import hashlib
import html as html_lib
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean

FLUSH_BYTES = 4 << 20
DATE = "1970-01-01T00:00:00Z"
SPACE = uuid.UUID("5cbb3a6e-2f0e-5d51-9d0c-1b5a1f6b7c10")
_OPEN = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*)|[!?])")
#: From behind a tag's name to its end; a ">" in a quoted value doesn't end it.
_REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*"|'[^']*')?+)*+>""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
#: Elements whose content is not shown, and up to where it goes.
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in ("script", "style", "template", "noscript", "title")}
_BLOCKS = frozenset("p div br h1 h2 h3 h4 h5 h6 li ul ol tr td th table article section nav header footer title head body html blockquote pre hr form main aside".split())
_LINKS = {"a": "href", "area": "href", "link": "href", "img": "src", "iframe": "src", "script": "src"}
_BLANKS = re.compile(r"[\t\r\f\v][ \t\r\f\v]*| [ \t\r\f\v]+")
_LINES = re.compile(r" ?\n[ \n]*")
_BREAK = re.compile(rb"\r?\n\r?\n")
_CHARSET = re.compile(r"""charset\s*=\s*["']?([\w.:-]+)""", re.I)


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(0).join(parts))}>"


def _attribute(attributes: str, name: str) -> str | None:
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() == name:
            return html_lib.unescape(next((v for v in m.groups()[1:] if v is not None), ""))
    return None


def read_page(page: str) -> tuple[str, dict]:
    """The visible text of a page (markup gone, a line per block, entities resolved, blanks folded), and its title, links
    (tag, url) and meta tags, in order.

    One pass from left to right that never comes back to a character more than a fixed number of times, whatever is left
    open. An element that isn't shown or a comment without an end goes on to the page's end; of a script element only the
    opening tag counts. Where no later ">" ends a tag outside quotes, the next one of any kind does; where there is none,
    the rest is text. A "<" without a name behind it is text.
    """
    shown, links, metas, title = [], [], [], None
    at, quotes, titles = 0, True, True
    while (m := _OPEN.search(page, at)) is not None:
        shown.append(page[at : m.start()])
        if m[0] == "<!--":
            end = page.find("-->", m.start() + 2)
            at = end + 3 if end >= 0 else len(page)
            shown.append(" ")
            continue
        rest = _REST.match(page, m.end()) if quotes else None
        quotes = quotes and rest is not None
        end = rest.end() if rest else page.find(">", m.end()) + 1
        if not end:
            at = m.start()
            break
        at = end
        if m[2] is None:
            continue
        name, attributes = m[2].lower(), page[m.end() : end - 1]
        if not m[1]:
            if name in _LINKS and (url := _attribute(attributes, _LINKS[name])) is not None:
                links.append({"path": f"{name.upper()}@/{_LINKS[name]}", "url": url})
            elif name == "meta":
                metas.append(attributes.strip(" /"))
            elif name == "title" and titles:
                close = _CLOSE[name].search(page, at)
                titles = False
                if close:
                    title = html_lib.unescape(page[at : close.start()]).strip()
                    shown.append(f"\n{page[at : close.start()]}\n")
                    at = close.end()
                    continue
            if name in _CLOSE and name != "title":
                close = _CLOSE[name].search(page, at)
                at = close.end() if close else len(page)
                shown.append(" ")
                continue
        if name in _BLOCKS:
            shown.append("\n")
    shown.append(page[at:])
    text = _LINES.sub("\n", _BLANKS.sub(" ", html_lib.unescape("".join(shown)))).strip()
    return text, {"Title": title, "Links": links, "Metas": metas}


def header_block(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields)).encode() + b"\r\n"


def serialise(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as it stands in a WARC file."""
    return header_block(fields) + block + b"\r\n\r\n"


def header_fields(head: str) -> tuple[str, list[tuple[str, str]]]:
    """The first line and the fields of a header: blanks around values don't count, folded lines are put together, repeated
    fields stay apart, and a line without a colon is a value without a name."""
    first, *lines = re.split(r"\r?\n", head)
    out: list[tuple[str, str]] = []
    for line in lines:
        name, colon, value = line.partition(":")
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}".strip())
        elif line.strip():
            out.append((name.strip(), value.strip()) if colon else ("", line.strip()))
    return first, out


def field(fields: list[tuple[str, str]], name: str) -> str | None:
    """The first value of a field; names are the same in upper and lower case."""
    return next((v for k, v in fields if k.lower() == name.lower()), None)


def by_name(fields: list[tuple[str, str]]) -> dict[str, str | list[str]]:
    """The fields as an object; a repeated one is a list of its values."""
    out: dict = {}
    for k, v in fields:
        out.setdefault(k, []).append(v)
    return {k: v[0] if len(v) == 1 else v for k, v in out.items()}


def parse(record: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """The header fields and the block of one record. Without a Content-Length that is a number the block is all the rest."""
    end = _BREAK.search(record)
    head, rest = (record[: end.start()], record[end.end() :]) if end else (record, b"")
    fields = header_fields(head.decode("utf-8", "replace"))[1]
    length = field(fields, "Content-Length") or ""
    return fields, rest[: int(length)] if length.isascii() and length.isdigit() else rest.removesuffix(b"\r\n\r\n")


def response_record(url: str, page: str, date: str = DATE) -> tuple[list[tuple[str, str]], bytes]:
    """A response record with an HTTP header for a page."""
    payload = page.encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n" + payload
    fields = [
        ("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", url, date, sha1(payload))), ("WARC-Date", date), ("WARC-Target-URI", url),
        ("WARC-Block-Digest", sha1(block)), ("WARC-Payload-Digest", sha1(payload)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    return fields, block


def derive(fields: list[tuple[str, str]], block: bytes) -> list[tuple[list[tuple[str, str]], bytes]]:
    """The metadata and the conversion record of a response record, in this order.

    All header fields of the record and of its HTTP response are in the metadata, repeated ones as lists. The page is read
    in the charset of its Content-Type, UTF-8 without a known one. A block that doesn't start as an HTTP response is a
    payload without header. A record without an id is referred to by an id made from its block.
    """
    end = _BREAK.search(block) if block.startswith(b"HTTP/") else None
    head, payload = (block[: end.start()], block[end.end() :]) if end else (b"", block)
    status, http = header_fields(head.decode("latin-1"))
    charset = _CHARSET.search(field(http, "Content-Type") or "")
    try:
        page = payload.decode(charset[1] if charset else "utf-8", "replace")
    except (LookupError, ValueError):
        page = payload.decode("utf-8", "replace")
    uri, date = field(fields, "WARC-Target-URI") or "", field(fields, "WARC-Date") or DATE
    source = field(fields, "WARC-Record-ID") or record_id("response", uri, date, sha1(block))
    text, html_metadata = read_page(page)
    response = {"Response-Message": status, "Headers": by_name(http), "Entity-Digest": sha1(payload), "Entity-Length": len(payload), "HTML-Metadata": html_metadata}
    envelope = {"Envelope": {"WARC-Header-Metadata": by_name(fields), "Payload-Metadata": {"Actual-Content-Type": field(fields, "Content-Type"), "HTTP-Response-Metadata": response}}}
    out = []
    for kind, content_type, body in (("metadata", "application/json", json.dumps(envelope, ensure_ascii=False).encode("utf-8", "replace")), ("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace"))):
        own = [
            ("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, source)), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Refers-To", source),
            ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date), ("WARC-Source-Block-Digest", field(fields, "WARC-Block-Digest") or sha1(block)),
            ("WARC-Source-Payload-Digest", field(fields, "WARC-Payload-Digest") or sha1(payload)), ("WARC-Block-Digest", sha1(body)), ("Content-Type", content_type), ("Content-Length", str(len(body))),
        ]
        out.append((own, body))
    return out


SCHEMA = "page_id long, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, source_block_digest string, source_payload_digest string, block string, record_bytes long, record_sha256 string"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def warc_derivatives(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Two rows per row of ``pages`` (page_id, url, html): its metadata and its conversion record.

    Each page is framed as a response record first, serialised and parsed like one from a file. A null url or html
    counts as empty; an empty page converts to an empty text. A page of any length or shape takes time in proportion to
    its length (``read_page``), and pages go through a worker a few megabytes at a time. Null ids are carried; repeated
    rows give the same records again; other columns are left aside; an empty table gives no rows. ``block`` holds the
    JSON or the text.
    """
    types = [pa.int64() if c.split()[1] == "long" else pa.string() for c in SCHEMA.split(", ")]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for page_id, url, page in zip(*batch.columns, strict=True):
                url, page = re.sub(r"[\r\n]+", " ", url.as_py() or "").strip(), page.as_py() or ""
                for fields, body in derive(*parse(serialise(*response_record(url, page, date)))):
                    f, record = dict(fields), serialise(fields, body)
                    rows.append((
                        page_id.as_py(), f["WARC-Type"], f["WARC-Record-ID"], f["WARC-Refers-To"], f["WARC-Target-URI"], f["WARC-Date"], f["Content-Type"], len(body), f["WARC-Block-Digest"],
                        f["WARC-Source-Block-Digest"], f["WARC-Source-Payload-Digest"], body.decode(), len(record), hashlib.sha256(record).hexdigest(),
                    ))
                    size += len(body)
                if size > FLUSH_BYTES or len(rows) >= 512:
                    yield packed(rows)
                    rows, size = [], 0
        if rows:
            yield packed(rows)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(lean(run), SCHEMA)
