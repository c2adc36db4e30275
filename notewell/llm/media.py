"""Media columns by signature sniffing.

An Aho-Corasick automaton finds magic bytes anywhere in a blob, validators confirm the structure and length of what a signature announces,
the declared type is corrected to the one found at the start, and media embedded further on are carved out.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import fresh, prepare

PAD_UNIT = 576
SAMPLE_RATE = 8000

SNIFFED = "media_type string, valid boolean, declared_ok boolean, length long, details string, embedded array<struct<media_type:string,start:long,length:long,content:binary>>"


def _wav(b: bytes, at: int, marks: Marks) -> tuple[int, str] | None:
    if len(b) < at + 44 or b[at + 8 : at + 12] != b"WAVE":
        return None
    size = struct.unpack_from("<I", b, at + 4)[0] + 8
    if at + size > len(b):
        return None
    pos, form = at + 12, None
    while pos + 8 <= at + size:
        kind, n = b[pos : pos + 4], struct.unpack_from("<I", b, pos + 4)[0]
        if kind == b"fmt " and n >= 16:
            form = struct.unpack_from("<HHIIHH", b, pos + 8)
        if kind == b"data":
            if form is None or pos + 8 + n > at + size:
                return None
            return size, f"codec={form[0]} channels={form[1]} rate={form[2]} bits={form[5]} data_at={pos + 8 - at} data_bytes={n}"
        pos += 8 + n + n % 2
    return None


def _png(b: bytes, at: int, marks: Marks) -> tuple[int, str] | None:
    pos, shape = at + 8, None
    while pos + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, pos)
        if pos + 12 + n > len(b) or zlib.crc32(b[pos + 4 : pos + 8 + n]) != struct.unpack_from(">I", b, pos + 8 + n)[0]:
            return None
        if kind == b"IHDR" and n == 13:
            shape = struct.unpack_from(">II", b, pos + 8)
        pos += 12 + n
        if kind == b"IEND":
            return (pos - at, f"width={shape[0]} height={shape[1]}") if shape else None
        if shape is None:
            return None
    return None


def _gif(b: bytes, at: int, marks: Marks) -> tuple[int, str] | None:
    if len(b) < at + 14:
        return None
    width, height, flags = struct.unpack_from("<HHB", b, at + 6)
    pos = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
    while pos < len(b):
        mark = b[pos]
        if mark == 0x3B:
            return pos + 1 - at, f"width={width} height={height}"
        if mark == 0x21:
            pos += 2
        elif mark == 0x2C and pos + 10 <= len(b):
            local = b[pos + 9]
            pos += 10 + (3 << ((local & 7) + 1) if local & 0x80 else 0) + 1
        else:
            return None
        while pos < len(b) and b[pos]:
            pos += 1 + b[pos]
        pos += 1
    return None


def _jpeg(b: bytes, at: int, marks: Marks) -> tuple[int, str] | None:
    pos, shape = at + 2, None
    while pos + 4 <= len(b) and b[pos] == 0xFF:
        mark = b[pos + 1]
        n = struct.unpack_from(">H", b, pos + 2)[0]
        if n < 2 or pos + 2 + n > len(b):
            return None
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC) and n >= 7:
            shape = struct.unpack_from(">HH", b, pos + 5)
        pos += 2 + n
        if mark == 0xDA:
            end = marks.next(b"\xff\xd9", pos)
            return (end + 2 - at, f"width={shape[1]} height={shape[0]}") if end >= 0 and shape else None
    return None


class Marks:
    """Where a byte string stands in a blob: all its places, found once, so that many signatures that look for one end don't each search to it."""

    def __init__(self, b: bytes):
        self.b, self.places = b, {}

    def of(self, mark: bytes) -> list[int]:
        if mark not in self.places:
            self.places[mark] = [m.start() for m in re.finditer(re.escape(mark), self.b)]
        return self.places[mark]

    def next(self, mark: bytes, at: int) -> int:
        """The first place from ``at`` on, or -1."""
        places = self.of(mark)
        k = bisect_left(places, at)
        return places[k] if k < len(places) else -1


def _pdf(b: bytes, at: int, marks: Marks) -> tuple[int, str] | None:
    """Up to the last end marker before the next PDF header or the blob's end: files saved in increments have an end marker for each."""
    if not b[at + 5 : at + 6].isdigit():
        return None
    stop = marks.next(b"%PDF-", at + 5)
    ends = marks.of(b"%%EOF")
    k = bisect_left(ends, len(b) if stop < 0 else stop) - 1
    return (ends[k] + 5 - at, f"version={b[at + 5 : at + 8].decode('latin-1')}") if k >= 0 and ends[k] >= at else None


def _zip(b: bytes, at: int, marks: Marks) -> tuple[int, str] | None:
    end = marks.next(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(b):
        return None
    entries, size, offset, note = struct.unpack_from("<HIIH", b, end + 10)
    return (end + 22 + note - at, f"entries={entries}") if at + offset + size == end and end + 22 + note <= len(b) else None


def _gzip(b: bytes, at: int, marks: Marks) -> tuple[int, str] | None:
    out = zlib.decompressobj(31)
    n = pos = 0
    pos = at
    try:
        while not out.eof and pos < len(b):
            n += len(out.decompress(b[pos : pos + 65536]))
            pos += 65536
    except zlib.error:
        return None
    return (min(pos, len(b)) - len(out.unused_data) - at, f"inflated={n}") if out.eof else None


#: Block sizes and sample rates that a FLAC frame header's codes announce with 1 or 2 more bytes.
_MORE_SIZE, _MORE_RATE = {6: 1, 7: 2}, {12: 1, 13: 2, 14: 2}


def _crc8(x: bytes) -> int:
    """Polynomial x^8 + x^2 + x + 1, as FLAC frame headers have it."""
    c = 0
    for v in x:
        c ^= v
        for _ in range(8):
            c = (c << 1 ^ 7 if c & 0x80 else c << 1) & 0xFF
    return c


@lru_cache(maxsize=1)
def _crc16_table() -> list[int]:
    out = []
    for v in range(256):
        c = v << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


def _flac_header(b: bytes, at: int) -> bool:
    """Whether a frame header stands here: sync code, no reserved value, right checksum."""
    if len(b) < at + 6 or b[at] != 0xFF or b[at + 1] & 0xFE != 0xF8 or b[at + 2] >> 4 == 0 or b[at + 2] & 15 == 15 or b[at + 3] >> 4 > 10 or b[at + 3] & 1:
        return False
    lead = b[at + 4]
    number = 1 if lead < 0x80 else next((n for n in range(2, 8) if lead >> (7 - n) == (1 << n + 1) - 2), 0)
    end = at + 4 + number + _MORE_SIZE.get(b[at + 2] >> 4, 0) + _MORE_RATE.get(b[at + 2] & 15, 0)
    return number > 0 and end < len(b) and _crc8(b[at:end]) == b[end]


def _flac(b: bytes, at: int, marks: Marks) -> tuple[int, str] | None:
    """Metadata blocks up to the last one, then frames: each begins with a right header and ends where its checksum of 16 bits is right. The last
    frame has no header behind it, so it ends at the first place whose checksum is right."""
    pos, last, rate = at + 4, False, 0
    while not last:
        if pos + 4 > len(b):
            return None
        last, kind, n = bool(b[pos] & 0x80), b[pos] & 0x7F, int.from_bytes(b[pos + 1 : pos + 4], "big")
        if pos + 4 + n > len(b) or kind == 127 or (pos == at + 4) != (kind == 0) or kind == 0 and n != 34:
            return None
        if kind == 0:
            rate = int.from_bytes(b[pos + 14 : pos + 17], "big") >> 4
        pos += 4 + n
    table, stop = _crc16_table(), marks.next(b"fLaC", pos)
    stop = len(b) if stop < 0 else stop
    while _flac_header(b, pos):
        c, end = 0, 0
        for k in range(pos, stop):  # the checksum over a frame and its own checksum is zero
            c = (c << 8 & 0xFFFF) ^ table[c >> 8 ^ b[k]]
            if c == 0 and k - pos > 8:
                end = end or k + 1
                if k + 1 == stop or _flac_header(b, k + 1):
                    end = k + 1
                    break
        if not end:
            break
        pos = end
    return pos - at, f"rate={rate}"


#: Magic bytes, where they stand from the start of the media, media type.
SIGNATURES: list[tuple[bytes, str, Callable[[bytes, int, Marks], tuple[int, str] | None]]] = [
    (b"RIFF", "audio/wav", _wav),
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"%PDF-", "application/pdf", _pdf),
    (b"PK\x03\x04", "application/zip", _zip),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"fLaC", "audio/flac", _flac),
]


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for k, (magic, _, _) in enumerate(SIGNATURES):
        a.add_word(magic.decode("latin-1"), k)
    a.make_automaton()
    return a


def sniff(blob: bytes | None) -> list[tuple[str, int, int, str]]:
    """(type, start, length, details) of every confirmed signature, in order of start; what lies inside a confirmed one other than the first is not looked at again."""
    found, free = [], 0
    if not blob:
        return found
    marks = Marks(blob)
    for last, k in _automaton().iter(blob.decode("latin-1")):
        magic, kind, confirm = SIGNATURES[k]
        at = last + 1 - len(magic)
        if at >= free and (got := confirm(blob, at, marks)):
            found.append((kind, at, got[0], got[1]))
            free = 1 if at == 0 else at + got[0]
    return found


def sniff_media(df: DataFrame, content: str = "content", declared: str | None = None) -> DataFrame:
    """``df`` with the columns of SNIFFED: the type confirmed at the start (else ``application/octet-stream``, not valid), whether the declared
    type is right, the confirmed length, and what was carved from further on. Null or empty content: octet-stream, length 0, nothing carved.
    Columns of ``df`` that clash with these are replaced; repeated rows and null ids are rows like others; blobs of any length are read whole; an empty
    table stays empty.
    """
    prepare(df.sparkSession)
    names = [x.split()[0] for x in SNIFFED.replace("array<struct<media_type:string,start:long,length:long,content:binary>>", "x").split(", ")]
    kept = df.drop(*[n for n in names if n not in (content, declared)])
    if set(names) & {content, declared}:
        raise ValueError(f"the input column may not be named one of {names}")
    struct_type = "struct<" + ",".join(f"{n}:{t}" for n, t in (x.split(" ", 1) for x in SNIFFED.split(", "))) + ">"

    @F.udf(struct_type, useArrow=True)
    def look(blob, said):
        found = sniff(bytes(blob) if blob is not None else None)
        head = found[0] if found and found[0][1] == 0 else None
        kind = head[0] if head else "application/octet-stream"
        inner = [(t, a, n, bytes(blob[a : a + n])) for t, a, n, _ in found if a]
        return (kind, head is not None, None if said is None else said == kind, head[2] if head else len(blob or b""), head[3] if head else "", inner)

    found = fresh("sniffed", kept)
    out = kept.withColumn(found, look(F.col(content), F.col(declared) if declared else F.lit(None).cast("string")))
    return out.select(*kept.columns, f"{found}.*")


def as_wav(payload: bytes) -> bytes:
    """One channel of unsigned 8-bit samples behind the 44-byte header."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8, b"data", len(payload)) + payload


def text_payload(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (-len(raw) % PAD_UNIT or (0 if raw else PAD_UNIT))


def read_samples(media: bytes) -> tuple[bytes, list[tuple[str, int, int, str]]]:
    """The samples of a sniffed WAV blob and all that was found in it."""
    found = sniff(media)
    if not found or found[0][:2] != ("audio/wav", 0):
        raise ValueError("not a WAV blob")
    facts = dict(x.split("=") for x in found[0][3].split())
    at = int(facts["data_at"])
    return media[at : at + int(facts["data_bytes"])], found


def text_media(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Store each text losslessly as a WAV blob: ident, n_bytes, media. Null text: as an empty one, padded to one unit. An empty table gives no rows."""
    prepare(docs.sparkSession)
    kind = dict(docs.dtypes)[ident]

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            texts = x.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array([as_wav(text_payload(t)) for t in texts], pa.binary())], [ident, "n_bytes", "media"])

    return docs.select(ident, text).mapInArrow(store, f"`{ident}` {kind}, n_bytes long, media binary")


def media_digests(media: DataFrame, ident: str = "doc_id", declared: str | None = None) -> DataFrame:
    """Digests of stored WAV blobs as the sniffer reads them back: of the payload, of the stored form and of what was carved, and a feature string.

    media: ident, n_bytes, media and, if named, the column of the declared type. ``media_type`` is the corrected type, ``declared_ok`` whether the
    declared one was right (null without one), ``n_embedded`` and ``embedded_bytes`` what was carved from within. A blob that is no WAV is an error.
    """
    said = F.col(declared) if declared else F.lit(None).cast("string")
    seen = sniff_media(media.select(F.col(ident).alias("i"), F.col("n_bytes").alias("b"), F.col("media").alias("m"), said.alias("said")), "m", "said")
    fact = lambda name: F.regexp_extract("details", rf"\b{name}=(\d+)", 1).cast("int")
    right = F.col("valid") & (F.col("media_type") == "audio/wav")
    payload = F.when(right, F.substring("m", fact("data_at") + 1, fact("data_bytes"))).otherwise(F.raise_error(F.lit("not a WAV blob")))
    inner = F.array_join(F.transform("embedded", lambda e: F.format_string("%s@%d+%d", e["media_type"], e["start"], e["length"])), ",")
    return seen.withColumn("p", payload).select(
        F.col("i").alias(ident),
        F.col("b").alias("n_bytes"),
        F.octet_length("p").cast("long").alias("payload_bytes"),
        F.sha2("p", 256).alias("payload_sha256"),
        F.crc32(F.substring("p", -32, 32)).alias("tail_crc32"),
        F.octet_length("m").cast("long").alias("media_bytes"),
        F.sha2("m", 256).alias("media_sha256"),
        F.concat("media_type", F.lit(" "), "details", F.lit(" embedded="), F.when(inner == "", "none").otherwise(inner)).alias("feature"),
        "media_type",
        "declared_ok",
        F.size("embedded").cast("long").alias("n_embedded"),
        F.aggregate("embedded", F.lit(0).cast("long"), lambda n, e: n + F.octet_length(e["content"])).alias("embedded_bytes"),
    )
