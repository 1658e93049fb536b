"""Media columns by signature sniffing.

An Aho-Corasick automaton finds every magic byte string in one pass over a
value. For each hit the format's validator checks structure and lengths; what
it confirms gives the type and the exact extent, which corrects a declared type
and carves media embedded in other bytes. ``encode_wav`` stores any payload
losslessly as 8-bit samples.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandmill.llm.common import numbered, restored, tidy

#: Magic bytes: fixed values of public formats, with the offset at which a value has them.
MAGIC = (
    (b"RIFF", 0, "riff"),
    (b"\x89PNG\r\n\x1a\n", 0, "png"),
    (b"\xff\xd8\xff", 0, "jpeg"),
    (b"GIF87a", 0, "gif"),
    (b"GIF89a", 0, "gif"),
    (b"%PDF-", 0, "pdf"),
    (b"PK\x03\x04", 0, "zip"),
    (b"\x1f\x8b\x08", 0, "gzip"),
    (b"fLaC", 0, "flac"),
    (b"OggS", 0, "ogg"),
    (b"BM", 0, "bmp"),
)
SAMPLE_RATE = 8000


@dataclass(frozen=True)
class Found:
    """A confirmed piece of media: type, extent, and where its payload lies."""

    kind: str
    start: int
    end: int
    payload_start: int
    payload_end: int
    detail: str


def encode_wav(payload: bytes) -> bytes:
    """A mono WAV file whose 8-bit samples are the payload (padded to even length)."""
    body = payload + b"\x00" * (len(payload) & 1)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8, b"data", len(payload))
    return head + body


def _riff(data: bytes, at: int) -> Found | None:
    if at + 12 > len(data):
        return None
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    if data[at + 8 : at + 12] != b"WAVE" or end > len(data):
        return None
    here, detail, span = at + 12, "", None
    while here + 8 <= end:
        name, size = struct.unpack_from("<4sI", data, here)
        if here + 8 + size > end:
            return None
        if name == b"fmt " and size >= 16:
            coding, channels, rate, _, _, width = struct.unpack_from("<HHIIHH", data, here + 8)
            detail = f"coding={coding},channels={channels},rate={rate},bits={width}"
        elif name == b"data":
            span = here + 8, here + 8 + size
        here += 8 + size + (size & 1)
    return Found("audio/wav", at, end, *span, detail) if span and detail else None


def _png(data: bytes, at: int) -> Found | None:
    here, detail = at + 8, ""
    while here + 12 <= len(data):
        size, name = struct.unpack_from(">I4s", data, here)
        stop = here + 12 + size
        if stop > len(data) or zlib.crc32(data[here + 4 : stop - 4]) != struct.unpack_from(">I", data, stop - 4)[0]:
            return None
        if name == b"IHDR" and size == 13:
            detail = "width={},height={}".format(*struct.unpack_from(">II", data, here + 8))
        if name == b"IEND":
            return Found("image/png", at, stop, at, stop, detail) if detail else None
        here = stop
    return None


def _jpeg(data: bytes, at: int) -> Found | None:
    here, detail = at + 2, ""
    while here + 4 <= len(data) and data[here] == 0xFF:
        mark, size = data[here + 1], struct.unpack_from(">H", data, here + 2)[0]
        if size < 2 or here + 2 + size > len(data):
            return None
        if 0xC0 <= mark <= 0xC2 and size >= 8:
            detail = "height={},width={}".format(*struct.unpack_from(">HH", data, here + 5))
        here += 2 + size
        if mark == 0xDA:
            end = data.find(b"\xff\xd9", here)
            return Found("image/jpeg", at, end + 2, at, end + 2, detail) if end >= 0 and detail else None
    return None


def _gif(data: bytes, at: int) -> Found | None:
    if at + 13 > len(data):
        return None
    width, height, flags = struct.unpack_from("<HHB", data, at + 6)
    here = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)

    def blocks(p: int) -> int:
        while p < len(data) and data[p]:
            p += data[p] + 1
        return p + 1

    while here < len(data):
        if data[here] == 0x3B:
            return Found("image/gif", at, here + 1, at, here + 1, f"width={width},height={height}")
        if data[here] == 0x21:
            here = blocks(here + 2)
        elif data[here] == 0x2C and here + 10 <= len(data):
            table = data[here + 9]
            here = blocks(here + 10 + (3 << ((table & 7) + 1) if table & 0x80 else 0) + 1)
        else:
            return None
    return None


def _pdf(data: bytes, at: int) -> Found | None:
    if not data[at + 5 : at + 6].isdigit():
        return None
    after = data.find(b"%PDF-", at + 5)
    end = data.rfind(b"%%EOF", at, after if after >= 0 else len(data))
    if end < 0 or data.rfind(b"startxref", at, end) < 0:
        return None
    return Found("application/pdf", at, end + 5, at, end + 5, "version=" + data[at + 5 : at + 8].decode("latin-1"))


def _zip(data: bytes, at: int, walked: set[int] | None = None) -> Found | None:
    """``walked`` holds the entries of chains that have led nowhere, so none is followed twice."""
    here, entries = at, 0
    walked = set() if walked is None else walked
    if at in walked:
        return None
    while data[here : here + 4] == b"PK\x03\x04" and here + 30 <= len(data):
        flags, size, name, extra = struct.unpack_from("<6xH10xI4xHH", data, here)
        walked.add(here)
        if flags & 8:
            return None
        here, entries = here + 30 + name + extra + size, entries + 1
    while data[here : here + 4] == b"PK\x01\x02" and here + 46 <= len(data):
        here += 46 + sum(struct.unpack_from("<HHH", data, here + 28))
    if data[here : here + 4] != b"PK\x05\x06" or here + 22 > len(data):
        return None
    end = here + 22 + struct.unpack_from("<H", data, here + 20)[0]
    return Found("application/zip", at, end, at, end, f"entries={entries}") if end <= len(data) else None


def _gzip(data: bytes, at: int) -> Found | None:
    unpack, size, here = zlib.decompressobj(31), 0, at
    try:
        while not unpack.eof and here < len(data):
            rest = data[here : here + 65536]
            here += 65536
            while rest and not unpack.eof:
                size += len(unpack.decompress(rest, 1 << 20))
                rest = unpack.unconsumed_tail
    except zlib.error:
        return None
    end = min(here, len(data)) - len(unpack.unused_data)
    return Found("application/gzip", at, end, at, end, f"bytes={size}") if unpack.eof else None


def _flac(data: bytes, at: int) -> Found | None:
    """Metadata blocks to the last one, then the sync code of a first frame."""
    here, last, detail = at + 4, False, ""
    while not last:
        if here + 4 > len(data):
            return None
        kind, size = data[here], int.from_bytes(data[here + 1 : here + 4], "big")
        if here == at + 4:
            if kind & 0x7F or size != 34 or here + 38 > len(data):
                return None
            packed = int.from_bytes(data[here + 14 : here + 22], "big")
            detail = f"rate={packed >> 44},channels={(packed >> 41 & 7) + 1},samples={packed & (1 << 36) - 1}"
        last, here = bool(kind & 0x80), here + 4 + size
    if data[here : here + 1] != b"\xff" or data[here + 1 : here + 2] not in (b"\xf8", b"\xf9"):
        return None
    return Found("audio/flac", at, len(data), at, len(data), detail)


def _ogg_sum(page: bytes) -> int:
    """Checksum of a page whose own checksum field is taken as zero."""
    total = 0
    for value in page[:22] + bytes(4) + page[26:]:
        total = (total << 8) & 0xFFFFFFFF ^ _OGG_TABLE[total >> 24 ^ value]
    return total


def _ogg_row(value: int) -> int:
    total = value << 24
    for _ in range(8):
        total = (total << 1) ^ (0x04C11DB7 if total & 0x80000000 else 0)
    return total & 0xFFFFFFFF


_OGG_TABLE = [_ogg_row(value) for value in range(256)]


def _ogg(data: bytes, at: int) -> Found | None:
    here, pages = at, 0
    while data[here : here + 4] == b"OggS" and here + 27 <= len(data) and data[here + 4] == 0:
        table = data[here + 27 : here + 27 + data[here + 26]]
        stop = here + 27 + len(table) + sum(table)
        if len(table) < data[here + 26] or stop > len(data) or _ogg_sum(data[here:stop]) != struct.unpack_from("<I", data, here + 22)[0]:
            break
        here, pages = stop, pages + 1
    return Found("audio/ogg", at, here, at, here, f"pages={pages}") if pages else None


def _bmp(data: bytes, at: int) -> Found | None:
    if at + 54 > len(data):
        return None
    size, zero, offset, header = struct.unpack_from("<IIII", data, at + 2)
    if zero or header not in (40, 108, 124) or not 14 + header <= offset <= size or at + size > len(data):
        return None
    return Found("image/bmp", at, at + size, at, at + size, "width={},height={}".format(*struct.unpack_from("<ii", data, at + 18)))


VALIDATORS = {"riff": _riff, "png": _png, "jpeg": _jpeg, "gif": _gif, "pdf": _pdf, "zip": _zip, "gzip": _gzip, "flac": _flac, "ogg": _ogg, "bmp": _bmp}
_automata: list = []


def _automaton():
    if not _automata:
        import ahocorasick

        made = ahocorasick.Automaton()
        for magic, offset, kind in MAGIC:
            made.add_word(magic.decode("latin-1"), (len(magic) + offset, kind))
        made.make_automaton()
        _automata.append(made)
    return _automata[0]


def sniff(data: bytes) -> list[Found]:
    """Confirmed media in order of place; a hit inside a confirmed piece that began
    at the value's first byte is reported as embedded, other overlaps are not."""
    found: list[Found] = []
    free, walked = 0, set()
    for last, (width, kind) in _automaton().iter(data.decode("latin-1")):
        at = last + 1 - width
        if at < free:
            continue
        piece = _zip(data, at, walked) if kind == "zip" else VALIDATORS[kind](data, at)
        if piece:
            found.append(piece)
            free = piece.payload_start if at == 0 and piece.payload_start else piece.end
    return found


def sniff_column(df: DataFrame, media: str, declared: str | None = None) -> DataFrame:
    """``df`` with ``sniffed`` (the true type), ``corrected`` (differs from the declared
    one), ``detail``, ``payload`` and ``carved`` (embedded pieces: kind, start, length).

    Null and empty values have no type, no payload and nothing carved; without a
    confirmed piece at the first byte the type is null and the declared one is
    called wrong if it names a format that is known here. Columns with the names
    of the results are replaced. One narrow pass, one value at a time.
    """
    names = [name for name in df.columns if name.lower() not in ("sniffed", "corrected", "detail", "payload", "carved")]
    rows = df.select(*numbered(names), F.col(media).cast("binary").alias("_sm_media"), (F.col(declared) if declared else F.lit(None)).cast("string").alias("_sm_declared"))
    kinds = {"audio/wav", "image/png", "image/jpeg", "image/gif", "application/pdf", "application/zip", "application/gzip", "audio/flac", "audio/ogg", "image/bmp"}
    carved_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                out: list[tuple] = []
                for data, said in zip(part.column(len(names)).to_pylist(), part.column(len(names) + 1).to_pylist(), strict=True):
                    pieces = sniff(data or b"")
                    top = pieces[0] if pieces and pieces[0].start == 0 else None
                    inner = [{"kind": p.kind, "start": p.start, "length": p.end - p.start} for p in pieces if p is not top]
                    wrong = said is not None and said != top.kind if top else said in kinds
                    out.append((top and top.kind, wrong, top and top.detail, top and data[top.payload_start : top.payload_end], inner))
                columns = [list(c) for c in zip(*out, strict=True)]
                made = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.string(), pa.binary(), carved_type), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], *made], [*part.schema.names[: len(names)], "sniffed", "corrected", "detail", "payload", "carved"])

    results = StructType.fromDDL("sniffed string, corrected boolean, detail string, payload binary, carved array<struct<kind: string, start: bigint, length: bigint>>")
    return restored(rows.mapInArrow(tidy(run), StructType([*rows.schema.fields[: len(names)], *results.fields])), names)


def text_media(docs: DataFrame) -> DataFrame:
    """Documents as WAV files: doc_id, n_bytes, media. The payload is the UTF-8 text,
    filled with zero bytes to a positive multiple of 64; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [text or b"" for text in part.column(1).to_pylist()]
                media = [encode_wav(text.ljust(max(64, -(-len(text) // 64) * 64), b"\x00")) for text in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, n_bytes long, media binary")


def sample_features(payload: bytes) -> str:
    """Features of 8-bit samples: mean, deviation, crossings of the middle a second,
    entropy in bits, and the most frequent sample. An empty payload has none."""
    if not payload:
        return ""
    x = np.frombuffer(payload, np.uint8)
    n, counts = len(x), np.bincount(x, minlength=256)
    levels = np.arange(256)
    mean = float(counts @ levels) / n
    spread = math.sqrt(max(float(counts @ levels**2) / n - mean * mean, 0.0))
    above = x >= 128
    crossings = int(np.count_nonzero(above[1:] != above[:-1])) * SAMPLE_RATE / n
    share = counts[counts > 0] / n
    entropy = -float((share * np.log2(share)).sum()) + 0.0
    return f"mean={mean:.4f},deviation={spread:.4f},crossings={crossings:.3f},entropy={entropy:.4f},mode={int(counts.argmax())}"


def digest(sniffed: DataFrame) -> DataFrame:
    """Checksums of what was read back, and a feature string: the type found, whether the
    declared one was wrong, the features of the samples, and what was carved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([sample_features(value.as_buffer().to_pybytes() if value.is_valid else b"") for value in batch.column(batch.num_columns - 1)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], [*batch.schema.names[:-1], "samples"])

    size = F.octet_length("payload")
    pieces = F.concat_ws(",", F.transform("carved", lambda c: F.concat(c["kind"], F.lit("@"), c["start"])))
    kind = F.concat_ws(";", "sniffed", "detail", F.concat(F.lit("corrected="), F.col("corrected").cast("string")), F.concat(F.lit("carved="), pieces))
    rows = sniffed.select(
        "doc_id",
        "n_bytes",
        size.cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", size - 63, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        kind.alias("kind"),
        "payload",
    )
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, kind string, samples string"
    return rows.mapInArrow(tidy(run), schema).withColumn("feature", F.concat_ws(";", "kind", "samples")).drop("kind", "samples")
