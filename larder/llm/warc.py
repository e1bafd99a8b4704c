"""WARC derivatives: metadata and plain-text conversion records linked to their responses."""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"  # of pages that come without one
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
HREF = re.compile(r"""\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
RAW = {"script", "style", "template", "noscript", "svg", "textarea"}
CODE = {"script", "style"}
END = {name: re.compile(rf"</{name}\b", re.I) for name in (*RAW, "title")}
BLOCKS = set(
    "address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table tbody td tfoot "
    "th thead title tr ul".split()
)
RECORD = (
    "record_type string, record_id string, refers_to string, target_uri string, date string, "
    "content_type string, content_length long, block_digest string, "
    "headers array<struct<name: string, value: string>>, block string"
)


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: object) -> str:
    """A UUID made from what identifies a record, so that reruns give the same."""
    text = "\x1f".join("\x00" if p is None else str(p) for p in parts)
    d = hashlib.sha1(text.encode("utf-8", "surrogatepass")).hexdigest()
    return f"<urn:uuid:{d[:8]}-{d[8:12]}-5{d[13:16]}-{'89ab'[int(d[16], 16) % 4]}{d[17:20]}-{d[20:32]}>"


def is_empty(rest: str) -> bool:
    """Whether a tag closes itself, by all after its name: a / in a bare value is the value's."""
    if not rest.endswith("/>"):
        return False
    last = rest.split()[-1]
    return "=" not in last or '"' in last or "'" in last


def parse_html(page: str) -> tuple[str, str, list[str]]:
    """Title, text and links of a page, in time that grows with its length only.

    The contents of script, style, template, noscript, svg and textarea and comments are left out,
    and the title stands apart; block elements begin new lines; spaces within a line are one;
    character references are resolved. Of these elements one that ends in /> is empty, and one
    that is never closed loses its tag alone; a script or style that is never closed and an open
    comment end the page. Other broken markup is text.
    """
    unclosed: set[str] = set()
    out: list[str] = []
    links: list[str] = []
    title, at, quotes = "", 0, True
    while True:
        lt = page.find("<", at)
        if lt < 0:
            out.append(page[at:])
            break
        out.append(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = len(page) if end < 0 else end + 3
            continue
        tag = TAG.match(page, lt)
        if not tag and page[lt + 1 : lt + 2] not in ("!", "?", "/"):
            out.append("<")
            at = lt + 1
            continue
        start = tag.end() if tag else lt + 1
        rest = REST.match(page, start) if quotes else None
        if rest:
            at = rest.end()
        else:  # an open quote: from here on, tags end at the next bracket
            quotes = False
            gt = page.find(">", start)
            at = len(page) if gt < 0 else gt + 1
        if not tag:
            continue
        name = tag[2].lower()
        if name in BLOCKS:
            out.append("\n")
        if tag[1]:
            continue
        if name == "a" and (href := HREF.search(page, start, at)):
            links.append(entities.unescape(href[1] or href[2] or href[3] or ""))
        if name in END and name not in unclosed and not is_empty(page[start:at]):
            close = END[name].search(page, at)
            if not close and name not in CODE:
                unclosed.add(name)
                continue
            stop = close.start() if close else len(page)
            if name == "title" and not title:
                title = " ".join(entities.unescape(page[at:stop]).split())
            at = stop
    text = entities.unescape("".join(out))
    lines = (" ".join(line.split()) for line in text.split("\n"))
    return title, "\n".join(line for line in lines if line), links


def response(page_id: object, url: str | None, page: str | None, date: str) -> dict:
    """A response record for a page: its headers, HTTP head and payload."""
    payload = (page or "").encode("utf-8", "replace")
    head = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    return {
        "record_id": record_id("response", page_id, url),
        "target_uri": url,
        "date": date,
        "http": head.decode(),
        "block_digest": digest(head + payload),
        "payload_digest": digest(payload),
        "payload": page or "",
    }


def record(kind: str, source: dict, content_type: str, block: bytes, more: list) -> dict:
    """A record derived from a response, with the source's own identifier, date and digests."""
    own = record_id(kind, source["record_id"])
    fixed = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", own),
        ("WARC-Date", source["date"]),
        ("WARC-Refers-To", source["record_id"]),
        *([("WARC-Target-URI", one_line(source["target_uri"]))] if source["target_uri"] else []),
        ("WARC-Refers-To-Date", source["date"]),
        ("WARC-Source-Block-Digest", source["block_digest"]),
        ("WARC-Source-Payload-Digest", source["payload_digest"]),
        *more,
        ("WARC-Block-Digest", digest(block)),
        ("Content-Type", content_type),
        ("Content-Length", str(len(block))),
    ]
    return {
        "record_type": kind,
        "record_id": own,
        "refers_to": source["record_id"],
        "target_uri": source["target_uri"],
        "date": source["date"],
        "content_type": content_type,
        "content_length": len(block),
        "block_digest": digest(block),
        "headers": [{"name": name, "value": value} for name, value in fixed],
        "block": block.decode(),
    }


def one_line(value: str) -> str:
    return " ".join(value.split())


def derive(source: dict) -> list[dict]:
    """The metadata and the conversion record of a response."""
    title, text, links = parse_html(source["payload"])
    text = text.encode("utf-8", "replace").decode()
    head = [line.split(": ", 1) for line in source["http"].split("\r\n")[1:] if ": " in line]
    fields = [
        *(("source-" + name.lower(), value) for name, value in head),
        ("source-payload-digest", source["payload_digest"]),
        ("title", one_line(title)),
        ("text-length", str(len(text))),
        *(("outlink", one_line(link)) for link in links),
    ]
    about = "".join(f"{name}: {value}\r\n" for name, value in fields).encode("utf-8", "replace")
    conversion = record(
        "conversion", source, "text/plain; charset=utf-8", text.encode(), []
    )
    linked = [("WARC-Concurrent-To", conversion["record_id"])]
    return [record("metadata", source, "application/warc-fields", about, linked), conversion]


def derivatives(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = DATE
) -> DataFrame:
    """Two rows per page: the page's id, and the fields, headers and block of a record.

    ``refers_to`` is the identifier of the page's response record, made from its id and URL;
    digests and HTTP headers of the response are kept in the records. Whole pages are converted.
    A null page is an empty one; a null URL is left out of the headers; a null id is an id like
    others. Repeated rows give repeated records with the same identifiers. No rows give none;
    other columns are ignored whatever their names.
    """
    chosen = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")
    )
    kind = chosen.schema["page_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):  # bounds what is held at a time
                part = batch.slice(low, 500)
                ids = part.column(0).to_pylist()
                rows = zip(ids, part.column(1).to_pylist(), part.column(2).to_pylist())
                made = [derive(response(i, u, h, date)) for i, u, h in rows]
                keys = pa.array([i for i in ids for _ in range(2)], part.column(0).type)
                records = pa.Table.from_pylist([r for pair in made for r in pair], schema)
                yield from records.add_column(0, "page_id", keys).to_batches()

    header = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
    kinds = {"content_length": pa.int64(), "headers": header}
    names = re.findall(r"(\w+) (?:string|long|array)", RECORD)
    schema = pa.schema([(name, kinds.get(name, pa.string())) for name in names])
    return chosen.mapInArrow(run, f"page_id {kind}, {RECORD}")


def serialize(headers: Iterable[tuple[str, str]], block: bytes) -> bytes:
    """A record as it stands in a file."""
    lines = "".join(f"{name}: {value}\r\n" for name, value in headers)
    return f"{VERSION}\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Headers and block of each record in a file's bytes."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if version != VERSION:
            raise ValueError(f"no record at byte {at}")
        headers = [tuple(line.split(": ", 1)) if ": " in line else (line.rstrip(":"), "") for line in lines]
        start = end + 4
        length = int(dict(headers)["Content-Length"])
        yield headers, data[start : start + length]
        at = start + length + 4


def _member(headers: list, block: str) -> bytes:
    pairs = [(h["name"], h["value"]) for h in headers]
    return gzip.compress(serialize(pairs, block.encode()), mtime=0)


def _members(headers: pa.Array, blocks: pa.Array) -> pa.Array:
    return pa.array(map(_member, headers.to_pylist(), blocks.to_pylist()), pa.binary())


_members.__annotations__ = {k: pa.Array for k in ("headers", "blocks", "return")}


def members(records: DataFrame) -> DataFrame:
    """``record_id`` and ``member``: each record as a gzip member of its own.

    Members written one after the other, in any order, make a compressed WARC file.
    """
    return records.select(
        "record_id", F.arrow_udf(_members, "binary")("headers", "block").alias("member")
    )
