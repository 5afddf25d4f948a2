"""Media columns: signature sniffing, type correction, carving, and lossless storage of bytes as samples.

An Aho-Corasick automaton finds all magic bytes of a value in one pass. At each place the validator of that format checks
the structure and reckons the length, so that chance matches inside text or samples fall away. The format that is valid at
offset 0 is the value's type, whatever was declared; valid ones further in, and not inside one another, are carved.

Very long values, also of nothing but magic bytes, are read about once: validators of formats made of parts remember from
which parts no valid end is reached, and ends that formats look for further on are found once for the value. (Only streams
made for it can cost more: many starts of gzip or RIFF that are all well formed for long and then fail.)

A null or empty value has no type and nothing carved. Of valid media that overlap, the one that starts first counts, then
the longer, then the one whose format is listed first. Repeated rows give repeated results.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Hashable, Iterator
from functools import cached_property, lru_cache, partial

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Value:
    """The bytes of a value, and what validators have learned about it."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        self.dead: set[Hashable] = set()
        self.places: dict[bytes, list[int]] = {}

    def all_of(self, mark: bytes) -> list[int]:
        """Where a mark stands, in order."""
        if mark not in self.places:
            at, found = -1, []
            while (at := self.data.find(mark, at + 1)) >= 0:
                found.append(at)
            self.places[mark] = found
        return self.places[mark]

    def next_of(self, mark: bytes, at: int) -> int:
        """The first place of a mark from there on, or -1."""
        places = self.all_of(mark)
        k = bisect_left(places, at)
        return places[k] if k < len(places) else -1

    @cached_property
    def zip_ends(self) -> dict[int, int]:
        """The end of the first archive that starts at each place, by the records that close archives."""
        out: dict[int, int] = {}
        for at in self.all_of(b"PK\x05\x06"):
            if at + 22 <= len(self.data):
                size, start, note = struct.unpack_from("<IIH", self.data, at + 12)
                first = at - start - size
                if first >= 0 and self.data[first + start : first + start + 4] in (b"PK\x01\x02", b"PK\x05\x06") and at + 22 + note <= len(self.data):
                    out.setdefault(first, at + 22 + note)
        return out

    def walk(self, state: tuple, step: Callable[[bytes, tuple], tuple | int]) -> int:
        """The end that a format's parts lead to, 0 if to none. A state is the format's name, a place and what counts so far."""
        path = []
        while state not in self.dead:
            path.append(state)
            after = step(self.data, state)
            if isinstance(after, tuple):
                state = after
            elif after:
                return after
            else:
                break
        self.dead.update(path)
        return 0


Validator = Callable[[Value, int], int]


def _png(x: Value, i: int) -> int:
    def chunk(d: bytes, state: tuple) -> tuple | int:
        j = state[1]
        if j + 12 > len(d):
            return 0
        size, kind = struct.unpack_from(">I4s", d, j)
        end = j + 12 + size
        if end > len(d) or zlib.crc32(d[j + 4 : end - 4]) != struct.unpack_from(">I", d, end - 4)[0]:
            return 0
        return end if kind == b"IEND" else ("png", end)

    return max(0, x.walk(("png", i + 8), chunk) - i) if x.data[i + 8 : i + 16] == b"\0\0\0\x0dIHDR" else 0


def _riff(form: bytes, need: bytes) -> Validator:
    def valid(x: Value, i: int) -> int:
        d = x.data
        if d[i + 8 : i + 12] != form:
            return 0
        end, j, seen = i + 8 + struct.unpack_from("<I", d, i + 4)[0], i + 12, False
        if end > len(d):
            return 0
        while j + 8 <= end:
            kind, size = struct.unpack_from("<4sI", d, j)
            seen |= kind[: len(need)] == need
            j += 8 + size + size % 2
        return end - i if seen and j == end + (j - end == 1) else 0

    return valid


def _gif(x: Value, i: int) -> int:
    def part(d: bytes, state: tuple) -> tuple | int:
        _, j, inside = state
        if j >= len(d):
            return 0
        if inside:  # blocks of data up to an empty one
            return ("gif", j + 1 + d[j], d[j] > 0)
        if d[j] == 0x3B:
            return j + 1
        if d[j] == 0x21:
            return ("gif", j + 2, True)
        if d[j] == 0x2C and j + 10 < len(d):
            f = d[j + 9]
            return ("gif", j + 11 + (3 << (f & 7) + 1 if f & 128 else 0), True)
        return 0

    if len(x.data) < i + 14:
        return 0
    flags = x.data[i + 10]
    return max(0, x.walk(("gif", i + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0), False), part) - i)


def _jpeg(x: Value, i: int) -> int:
    def segment(d: bytes, state: tuple) -> tuple | int:
        _, j, scanned = state
        if d[j : j + 1] != b"\xff" or j + 2 > len(d):
            return 0
        kind = d[j + 1]
        if kind == 0xFF:  # a byte that fills
            return ("jpeg", j + 1, scanned)
        if kind == 0xD9:
            return j + 2 if scanned else 0
        size = struct.unpack_from(">H", d, j + 2)[0] if j + 4 <= len(d) else 0
        if size < 2 or not 0xC0 <= kind <= 0xFE:
            return 0
        j += 2 + size
        if kind == 0xDA:
            scanned = True
            while (j := d.find(b"\xff", j)) >= 0 and j + 1 < len(d) and (d[j + 1] == 0 or 0xD0 <= d[j + 1] <= 0xD7):
                j += 2
        return ("jpeg", j, scanned) if j >= 0 else 0

    return max(0, x.walk(("jpeg", i + 2, False), segment) - i)


def _bmp(x: Value, i: int) -> int:
    if len(x.data) < i + 30:
        return 0
    size, zero, start, head, wide, high, planes, bits = struct.unpack_from("<IIIIiiHH", x.data, i + 2)
    need = (abs(wide) * bits + 31) // 32 * 4 * abs(high)
    fits = not zero and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and head in (40, 52, 56, 108, 124) and 14 + head <= start and start + need == size
    return size if fits and i + size <= len(x.data) else 0


def _pdf(x: Value, i: int) -> int:
    d = x.data
    if not d[i + 5 : i + 6].isdigit() or d[i + 6 : i + 7] != b".":
        return 0
    other, ends = x.next_of(b"%PDF-", i + 5), x.all_of(b"%%EOF")
    k = bisect_right(ends, (other if other > 0 else len(d)) - 5) - 1
    if k < 0 or ends[k] < i:
        return 0
    table = x.next_of(b"startxref", i)
    return ends[k] + 5 - i if 0 <= table <= ends[k] - 9 else 0


def _zip(x: Value, i: int) -> int:
    return max(0, x.zip_ends.get(i, 0) - i)


def _gzip(x: Value, i: int) -> int:
    d, j = x.data, i + 10
    if len(d) < i + 18:
        return 0
    flags = d[i + 3]
    if flags & 0xE0:
        return 0
    if flags & 4:
        j += 2 + int.from_bytes(d[j : j + 2], "little")
    for mark in (8, 16):  # a name, a comment
        if flags & mark:
            end = x.next_of(b"\0", j)
            if end < 0:
                return 0
            j = end + 1
    if flags & 2:
        if zlib.crc32(d[i:j]) & 0xFFFF != int.from_bytes(d[j : j + 2], "little"):
            return 0
        j += 2
    unpack, crc, size, step = zlib.decompressobj(-15), 0, 0, 256
    try:
        while j < len(d) and not unpack.eof:
            part = d[j : j + step]
            j, step = j + len(part), min(4 * step, 1 << 16)
            while part and not unpack.eof:
                made = unpack.decompress(part, 1 << 20)
                crc, size = zlib.crc32(made, crc), size + len(made)
                part = unpack.unconsumed_tail
    except zlib.error:
        return 0
    j -= len(unpack.unused_data)
    return j + 8 - i if unpack.eof and d[j : j + 8] == struct.pack("<II", crc, size & 0xFFFFFFFF) else 0


def _flac(x: Value, i: int) -> int:
    """Its frames give no length: it runs to the end of the value."""
    def block(d: bytes, state: tuple) -> tuple | int:
        j = state[1]
        if j + 4 > len(d):
            return 0
        after = j + 4 + int.from_bytes(d[j + 1 : j + 4], "big")
        if d[j] & 128:
            return len(d) if d[after : after + 1] == b"\xff" else 0
        return ("flac", after)

    first = x.data[i + 4 : i + 8]
    return max(0, x.walk(("flac", i + 4), block) - i) if len(first) == 4 and not first[0] & 127 and first[1:] == b"\0\0\x22" else 0


def _ogg(x: Value, i: int) -> int:
    """Pages, of several streams maybe, until each stream that began has ended, or no page follows."""
    d, j, streams = x.data, i, set()
    while d[j : j + 4] == b"OggS" and j + 27 <= len(d) and not d[j + 4]:
        n = d[j + 26]
        end = j + 27 + n + sum(d[j + 27 : j + 27 + n])
        if end > len(d) or (j == i and not d[j + 5] & 2):
            return 0
        if d[j + 5] & 2:
            streams.add(d[j + 14 : j + 18])
        if d[j + 5] & 4:
            streams.discard(d[j + 14 : j + 18])
        j = end
        if not streams:
            break
    return j - i


def _mp4(x: Value, i: int) -> int:
    """The magic stands 4 bytes in. A box of length 1 has 64 bits of length, one of length 0 runs to the end of the value."""
    def box(d: bytes, state: tuple) -> tuple | int:
        _, j, seen = state
        if j + 8 <= len(d):
            size, kind = struct.unpack_from(">I4s", d, j)
            least = 16 if size == 1 else 8
            if size == 1 and j + 16 <= len(d):
                size = struct.unpack_from(">Q", d, j + 8)[0]
            elif not size:
                size = len(d) - j
            if size >= least and j + size <= len(d) and kind.isalnum():
                return ("mp4", j + size, seen or kind in (b"moov", b"mdat"))
        return j if seen else 0

    return max(0, x.walk(("mp4", i, False), box) - i)


#: Magic bytes, how far into the file they stand, type, validator.
FORMATS: tuple[tuple[bytes, int, str, Validator], ...] = (
    (b"\x89PNG\r\n\x1a\n", 0, "image/png", _png),
    (b"\xff\xd8\xff", 0, "image/jpeg", _jpeg),
    (b"GIF87a", 0, "image/gif", _gif),
    (b"GIF89a", 0, "image/gif", _gif),
    (b"RIFF", 0, "audio/wav", _riff(b"WAVE", b"data")),
    (b"RIFF", 0, "image/webp", _riff(b"WEBP", b"VP8")),
    (b"BM", 0, "image/bmp", _bmp),
    (b"fLaC", 0, "audio/flac", _flac),
    (b"OggS", 0, "audio/ogg", _ogg),
    (b"ftyp", 4, "video/mp4", _mp4),
    (b"%PDF-", 0, "application/pdf", _pdf),
    (b"PK\x03\x04", 0, "application/zip", _zip),
    (b"\x1f\x8b\x08", 0, "application/gzip", _gzip),
)


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    out, by = ahocorasick.Automaton(), {}
    for k, (magic, *_) in enumerate(FORMATS):
        by.setdefault(magic, []).append(k)
    for magic, ks in by.items():
        out.add_word(magic.decode("latin-1"), (len(magic), tuple(ks)))
    out.make_automaton()
    return out


def found(data: bytes) -> list[tuple[str, int, int]]:
    """(type, offset, length) of the valid media of a value, none inside or across another."""
    at: dict[int, list[int]] = {}
    for end, (size, ks) in automaton().iter(data.decode("latin-1")):
        for k in ks:
            at.setdefault(end - size + 1 - FORMATS[k][1], []).append(k)
    value, valid, free = Value(data), [], 0
    for start in sorted(at):
        if start >= free:
            length, k = max((FORMATS[k][3](value, start), -k) for k in at[start])
            if length > 0:
                valid.append((FORMATS[-k][2], start, length))
                free = start + length
    return valid


CARVED = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("data", T.BinaryType())]))


def _sniff(batches: Iterator[pa.RecordBatch], carve: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, 500):
            part = batch.slice(first, 500)
            media, declared = (part.column(part.num_columns - k).to_pylist() for k in (2, 1))
            kinds, wrong, sizes, carved = [], [], [], []
            for data, told in zip(media, declared, strict=True):
                data = data or b""
                got = found(data)
                kind = got[0][0] if got and not got[0][1] else None
                kinds.append(kind)
                sizes.append(got[0][2] if kind else None)
                wrong.append(kind is not None and kind != told)
                carved.append([{"type": t, "offset": i, "length": n, "data": data[i : i + n] if carve else None} for t, i, n in got if i])
            kind_of = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("data", pa.binary())]))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(kinds, pa.string()), pa.array(sizes, pa.int64()), pa.array(wrong, pa.bool_()), pa.array(carved, kind_of)], [*part.schema.names, "media_type", "media_length", "corrected", "carved"])


def sniff(df: DataFrame, media: str = "media", declared: str | None = None, columns: tuple[str, ...] = ("doc_id",), carve: bool = True) -> DataFrame:
    """The given columns, media, declared_type, and: media_type as its bytes say (null: none valid), media_length, corrected (it isn't the declared one), carved media further in."""
    source = df.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{media}`").cast("binary").alias("media"), (F.col(f"`{declared}`") if declared else F.lit(None)).cast("string").alias("declared_type"))
    added = [T.StructField("media_type", T.StringType()), T.StructField("media_length", T.LongType()), T.StructField("corrected", T.BooleanType()), T.StructField("carved", CARVED)]
    return source.mapInArrow(partial(_sniff, carve=carve), T.StructType([*source.schema.fields, *added]))


#: Samples a second of what to_wav() writes.
RATE = 8000


def to_wav(payload: bytes) -> bytes:
    """Mono 8-bit PCM whose samples are the payload."""
    n = len(payload)
    return b"RIFF" + struct.pack("<I", 36 + n + n % 2) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n) + payload + b"\0" * (n % 2)


def from_wav(data: bytes) -> tuple[dict[str, int], bytes]:
    """What the format chunk says, and the samples."""
    j, about = 12, {}
    while j + 8 <= len(data):
        kind, size = struct.unpack_from("<4sI", data, j)
        if kind == b"fmt ":
            about = dict(zip(("format", "channels", "rate", "byte_rate", "align", "bits"), struct.unpack_from("<HHIIHH", data, j + 8), strict=True))
        elif kind == b"data":
            return about, data[j + 8 : j + 8 + size]
        j += 8 + size + size % 2
    raise ValueError("no samples")


def padded(text: str | None, unit: int = 64) -> bytes:
    """UTF-8, and bytes 0 up to a positive multiple of the unit."""
    raw = (text or "").encode()
    return raw + b"\0" * (-len(raw) % unit or (0 if raw else unit))
