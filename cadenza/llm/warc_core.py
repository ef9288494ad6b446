"""WARC records: writing members and reading archives that may be damaged."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

VERSION = b"WARC/1.1"
_GZIP = b"\x1f\x8b\x08"
_NEXT = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
_NAME, _CONTROL = re.compile(rb"[A-Za-z0-9-]+"), re.compile(rb"[\x00-\x08\x0a-\x1f\x7f]")
_MANDATORY = {"warc-type", "warc-record-id", "warc-date", "content-length"}
_STEP = 1 << 14                           # bytes handed to the decompressor at a time
_DATE = "2000-01-01T00:00:00Z"            # pages carry no crawl time


@dataclass
class Record:
    start: int
    end: int
    headers: dict[str, str]
    block: bytes


@dataclass
class Gap:
    start: int
    end: int
    reason: str


def _header_value(value: str) -> str:
    """A header line holds no control characters or blanks at its ends: these
    and percent signs are percent-encoded."""
    out = re.sub(r"[%\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)
    return re.sub(r"^\s+|\s+$", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), out)


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    headers = [*headers, ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()), ("Content-Length", str(len(block)))]
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response with its HTTP block, or a revisit (``refers_to``) with the
    HTTP head alone; both tell the digest and length of the full payload."""
    revisit = refers_to is not None
    head = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
            + str(len(payload)).encode() + b"\r\n\r\n")
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)),
               ("WARC-Date", _DATE), ("WARC-Payload-Digest", "sha256:" + digest),
               ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        headers.append(("WARC-Target-URI", _header_value(url)))
    if revisit:
        headers += [("WARC-Refers-To", record_id(refers_to)),
                    ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return _record(headers, head if revisit else head + payload)


def member(record: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def _parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at ``at``; raises ValueError with
    the check that failed."""
    head_end = data.find(b"\r\n\r\n", at)
    if not re.match(rb"WARC/1\.[01]\r\n", data[at:at + 10]) or head_end < 0:
        raise ValueError("no version line" if head_end >= 0 else "headers cut off")
    headers = {}
    for line in data[at:head_end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not _NAME.fullmatch(name) or _CONTROL.search(value):
            raise ValueError("not a header line")
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not _MANDATORY <= headers.keys():
        raise ValueError("mandatory header missing")
    length = headers.get("content-length", "")
    if not length.isdigit():
        raise ValueError("no content length")
    start = head_end + 4
    block = data[start:start + int(length)]
    end = start + int(length)
    if len(block) != int(length) or data[end:end + 4] != b"\r\n\r\n":
        raise ValueError("content length does not hold")
    kind, _, want = headers.get("warc-block-digest", "").partition(":")
    if kind == "sha256" and hashlib.sha256(block).hexdigest() != want:
        raise ValueError("block digest does not hold")
    return headers, block, end + 4


def _try(data: bytes, at: int) -> Record:
    if data.startswith(_GZIP, at):
        z, parts, fed = zlib.decompressobj(31), [], at
        try:
            while not z.eof and fed < len(data):
                parts.append(z.decompress(data[fed:fed + _STEP]))
                fed = min(fed + _STEP, len(data))
        except zlib.error as e:
            raise ValueError(f"gzip: {str(e)[:60]}") from None
        if not z.eof:
            raise ValueError("gzip member cut off")
        raw = b"".join(parts)
        headers, block, end = _parse(raw, 0)
        if end != len(raw):
            raise ValueError("bytes after the record in its member")
        return Record(at, fed - len(z.unused_data), headers, block)
    headers, block, end = _parse(data, at)
    return Record(at, end, headers, block)


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """Records of an archive (gzip members or plain records) in order.  Where
    a check fails, the reader goes to the next member or version line at which
    a whole valid record is found and reports the bytes between as a gap."""
    at, gap, why = 0, None, ""
    while at < len(data):
        try:
            r = _try(data, at)
        except ValueError as e:
            if gap is None:
                gap, why = at, str(e)
            m = _NEXT.search(data, at + 1)
            at = m.start() if m else len(data)
            continue
        if gap is not None:
            yield Gap(gap, at, why)
            gap = None
        yield r
        at = r.end
    if gap is not None:
        yield Gap(gap, len(data), why)


def payload_of(r: Record) -> bytes:
    """The HTTP body of a response block."""
    return r.block.partition(b"\r\n\r\n")[2]


def page_of(urn: str) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn)
    return int(m[1]) if m else None
