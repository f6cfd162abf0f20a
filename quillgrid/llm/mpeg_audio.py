"""MPEG audio in a column: frames, tags, variable-bitrate tables, checksums.

parse() walks a file's bytes: it reads ID3 (1, 2.2 to 2.4, extended headers and
unsynchronisation included) and APE tags, finds a frame header that a second
one follows (or the end), steps from frame to frame and resynchronises when a
header fails; in the free format the distance of two like headers is the size.
It reads the Xing, Info or VBRI table with its seek points, encoder delay and
padding, verifies each protected frame's CRC-16 in all three layers, and gives
the exact number of samples and the offset of every frame for seeking. The
duration is that of the samples without delay and padding. stored() writes a payload losslessly into the data
parts of Layer III frames, PER_FRAME bytes each, behind a tag and a table of
seek points; payload() reads it back from the parsed frames.

Defined results: null bytes are parsed like empty ones (no frame); of two tags
that tell the same thing the first counts; texts and media of any length are
taken whole, each in one task; a null or empty text has a payload of padding alone; repeated rows get the same result
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tune

#: kbit/s by (MPEG 1 or not, layer), for the bit-rate index; 0 is the free format.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
#: Samples a second by the two version bits.
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
#: Bits that tell a subband's allocation, by Layer II table: (subbands from here on, bits), and where the table ends.
ALLOCATION = {
    "a": (((0, 4), (11, 3), (23, 2)), 27), "b": (((0, 4), (11, 3), (23, 2)), 30),
    "c": (((0, 4), (2, 3)), 8), "d": (((0, 4), (2, 3)), 12), "low": (((0, 4), (4, 3), (11, 2)), 30),
}
#: Longest frame of the free format, in bytes.
FREE = 1 << 14
PER_FRAME = 576
#: MPEG 1, Layer III, protected, 224 kbit/s, 48 kHz, stereo: 672 bytes, of which 38 are header, checksum and side information.
HEADER = bytes((0xFF, 0xFA, 0xC4, 0x00))
SIDE = 32
FRAME = 672


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    protected: bool
    rate: int
    size: int
    samples: int
    mono: bool
    kbits: int = 0
    bound: int = 32
    padding: int = 0

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)


@dataclass
class Audio:
    """What parse() finds. offsets and sizes are those of audio frames, without a table's frame."""

    tags: dict[str, str] = field(default_factory=dict)
    table: dict[str, int] = field(default_factory=dict)
    points: list[int] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    samples: int = 0
    duration: Fraction = Fraction(0)
    checked: int = 0
    failed: int = 0
    skipped: int = 0


def header(data: bytes, at: int) -> Header | None:
    """The frame header at a place, or None if there is none."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    b1, b2, b3 = data[at + 1 : at + 4]
    version, layer, index, rate = b1 >> 3 & 3, 4 - (b1 >> 1 & 3), b2 >> 4, b2 >> 2 & 3
    if version == 1 or layer == 4 or index == 15 or rate == 3 or b3 & 3 == 2:
        return None
    hertz, kbits, pad = RATES[version][rate], BITRATES[version == 3, layer][index], b2 >> 1 & 1
    if layer == 1:
        samples, pad = 384, 4 * pad
        size = 12 * 1000 * kbits // hertz * 4 + pad
    else:
        samples = 1152 if layer == 2 or version == 3 else 576
        size = samples // 8 * 1000 * kbits // hertz + pad
    joint = (b3 >> 4 & 3) * 4 + 4 if b3 >> 6 == 1 else 32
    return Header(version, layer, not b1 & 1, hertz, size if kbits else 0, samples, b3 >> 6 == 3, kbits, joint, pad)


def alike(a: Header, b: Header | None) -> bool:
    return b is not None and (b.version, b.layer, b.rate) == (a.version, a.layer, a.rate)


def free_size(data: bytes, at: int, end: int, h: Header) -> int:
    """Bytes of the free-format frame at a place, without padding: up to the next header like it, behind which another or the end comes at the same distance; else 0."""
    place = at + 4
    while 0 <= (place := data.find(b"\xff", place, min(end, at + FREE))):
        n = header(data, place)
        if alike(h, n) and n.kbits == 0 and n.protected == h.protected:
            size = place - at - h.padding
            last = place + size + n.padding
            if last == end or alike(h, header(data, last)):
                return size
        place += 1
    return 0


def _table() -> list[int]:
    out = []
    for i in range(256):
        crc = i << 8
        for _ in range(8):
            crc = crc << 1 ^ (0x8005 if crc & 0x8000 else 0)
        out.append(crc & 0xFFFF)
    return out


CRC = _table()


def crc16(data: bytes, crc: int = 0xFFFF) -> int:
    for byte in data:
        crc = crc << 8 & 0xFF00 ^ CRC[crc >> 8 ^ byte]
    return crc


#: Checksums by what they protect; frames of one file mostly repeat it.
_known: dict[tuple[bytes, int], int] = {}


def crc_bits(data: bytes, bits: int, crc: int = 0xFFFF) -> int:
    """The checksum of the first bits of data."""
    crc = crc16(data[: bits // 8], crc)
    for i in range(bits % 8):
        bit = data[bits // 8] >> 7 - i & 1
        crc = (crc << 1 ^ (0x8005 if (crc >> 15) ^ bit else 0)) & 0xFFFF
    return crc


def _bits(data: bytes, at: int, n: int) -> int:
    """n bits of data from bit at on."""
    whole = int.from_bytes(data[at // 8 : (at + n + 7) // 8], "big")
    return whole >> -(at + n) % 8 & (1 << n) - 1


def allocation_table(h: Header) -> str:
    """The Layer II table of a frame, by sample rate and kbit/s of a channel."""
    each = h.kbits if h.mono else h.kbits // 2
    if h.version != 3:
        return "low"
    if 56 <= each <= 80 or each >= 56 and h.rate == 48000:
        return "a"
    if each >= 96 or not h.kbits:
        return "b" if h.rate != 48000 else "a"
    return "d" if h.rate == 32000 else "c"


def protected_bits(data: bytes, h: Header) -> int:
    """Bits behind the checksum that it covers; data begins there."""
    if h.layer == 3:
        return 8 * h.side
    channels, used = (1 if h.mono else 2), 0
    if h.layer == 1:
        bound = 32 if h.mono else h.bound
        return 4 * (bound * channels + 32 - bound)
    steps, last = ALLOCATION[allocation_table(h)]
    at = 0
    for band in range(last):
        width = next(w for first, w in reversed(steps) if band >= first)
        shared = channels == 2 and band >= h.bound
        for _ in range(1 if shared else channels):
            used += (channels if shared else 1) * (_bits(data, at, width) > 0)
            at += width
    return at + 2 * used


def checksum_fits(data: bytes, at: int, h: Header) -> bool | None:
    """Whether a protected frame's CRC-16 fits; None where there is none, or the data ends before."""
    if not h.protected or at + 6 > len(data):
        return None
    body = data[at + 6 : at + 6 + 256]
    bits = protected_bits(body, h)
    if bits > 8 * len(body):
        return None
    covered = (data[at + 2 : at + 4] + body[: (bits + 7) // 8], bits)
    if covered not in _known:
        if len(_known) > 4096:
            _known.clear()
        _known[covered] = crc_bits(covered[0], 16 + bits)
    return _known[covered] == data[at + 4] << 8 | data[at + 5]


def _safe(raw: bytes) -> int:
    """A number of seven bits a byte."""
    n = 0
    for byte in raw:
        n = n << 7 | byte & 0x7F
    return n


def _text(body: bytes) -> str:
    name = ("latin-1", "utf-16", "utf-16-be", "utf-8")[min(body[0], 3)]
    return body[1:].decode(name, "replace").rstrip("\0")


def _id3(data: bytes, at: int, stop: int, tags: dict[str, str]) -> None:
    """Text frames of an ID3v2 tag that begins at a place."""
    major, flags, raw = data[at + 3], data[at + 5], data[at + 10 : stop]
    if flags & 0x80 and major < 4:
        raw = raw.replace(b"\xff\0", b"\xff")
    p = 0
    if flags & 0x40 and major >= 3:  # an extended header
        p = _safe(raw[:4]) if major >= 4 else 4 + int.from_bytes(raw[:4], "big")
    name, wide = (3, 6) if major == 2 else (4, 10)
    while p + wide <= len(raw) and raw[p : p + name].isalnum():
        size = int.from_bytes(raw[p + 3 : p + 6], "big") if major == 2 else _safe(raw[p + 4 : p + 8]) if major >= 4 else int.from_bytes(raw[p + 4 : p + 8], "big")
        body, own = raw[p + wide : p + wide + size], raw[p + 9] if major >= 4 else 0
        if own & 1:  # the length stands in front
            body = body[4:]
        if own & 2:
            body = body.replace(b"\xff\0", b"\xff")
        if raw[p : p + 1] == b"T" and body and not own & 0x0C:
            tags.setdefault(raw[p : p + name].decode("latin-1"), _text(body))
        p += wide + size


def _ape(data: bytes, start: int, end: int, tags: dict[str, str]) -> int:
    """Items of an APE tag whose foot ends at end; gives where the tag begins."""
    if end - start < 32 or data[end - 32 : end - 24] != b"APETAGEX":
        return end
    size, items, flags = struct.unpack("<III", data[end - 20 : end - 8])
    p = max(start, end - size)
    first = max(start, p - 32) if flags >> 31 else p
    for _ in range(items):
        if p + 8 >= end - 32:
            break
        length, kind = struct.unpack("<II", data[p : p + 8])
        stop = data.find(b"\0", p + 8, end - 32)
        if stop < 0:
            break
        if kind >> 1 & 3 == 0:
            tags.setdefault(data[p + 8 : stop].decode("latin-1"), data[stop + 1 : min(end - 32, stop + 1 + length)].decode("utf-8", "replace"))
        p = stop + 1 + length
    return first


def _front_tags(data: bytes, audio: Audio) -> int:
    """Read the tags in front; gives where they end."""
    start, end = 0, len(data)
    while data[start : start + 3] == b"ID3" and start + 10 <= end:
        stop = min(end, start + 10 + _safe(data[start + 6 : start + 10]))
        _id3(data, start, stop, audio.tags)
        start = stop + (10 if data[start + 5] & 0x10 else 0)
    return start


def _tail_tags(data: bytes, start: int) -> tuple[int, dict[str, str]]:
    """Where tags at the end would begin, and what they would say. They are tags only if no frame reaches into them."""
    end, old, tags = len(data), {}, {}
    if end - start >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        old = {"TIT2": data[end + 3 : end + 33].decode("latin-1").rstrip("\0 ")}
    end = _ape(data, start, end, tags)
    return end, old | tags


def _vbr(data: bytes, at: int, h: Header) -> tuple[dict[str, int], list[int]] | None:
    """What a Xing, Info or VBRI table in this frame tells, and the offsets in the audio that it gives for seeking."""
    for name, place in itertools.product((b"Xing", b"Info"), (at + 4 + h.side, at + 6 + h.side)):
        if data[place : place + 4] == name and place + 8 <= len(data):
            flags, p = int.from_bytes(data[place + 4 : place + 8], "big"), place + 8
            found, points = {"variable": int(name == b"Xing")}, []
            for bit, key in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    found[key] = int.from_bytes(data[p : p + 4], "big")
                    p += 4
            if flags & 4:
                points = [x * found.get("bytes", 0) // 256 for x in data[p : p + 100]]
                p += 100
            if flags & 8:
                found["quality"] = int.from_bytes(data[p : p + 4], "big")
                p += 4
            if data[p : p + 4] in (b"LAME", b"Lavf", b"Lavc") and p + 24 <= at + h.size:
                gap = int.from_bytes(data[p + 21 : p + 24], "big")
                found |= {"delay": gap >> 12, "padding": gap & 0xFFF}
            return found, points
    place = at + 36
    if data[place : place + 4] == b"VBRI" and place + 26 <= len(data):
        delay, _, size, frames, entries, scale, wide, _ = struct.unpack(">HHIIHHHH", data[place + 6 : place + 26])
        steps = [int.from_bytes(data[i : i + wide], "big") * scale for i in range(place + 26, min(len(data), place + 26 + entries * wide), max(1, wide))]
        return {"bytes": size, "frames": frames, "variable": 1, "delay": delay}, list(itertools.accumulate(steps, initial=0))[:-1]
    return None


def parse(data: bytes | None) -> Audio:
    """Frames, tags, table and checksums of MPEG audio bytes."""
    data, audio = data or b"", Audio()
    at = _front_tags(data, audio)
    tail, late = _tail_tags(data, at)
    end, synced, free = tail, False, 0
    while at + 4 <= end:
        h = header(data, at)
        if h is not None and not h.kbits:
            if not synced or not free:
                free = free_size(data, at, end, h)
            h = replace(h, size=free + h.padding) if free else None
        if h is not None and synced and end == tail < at + h.size and (at + h.size == len(data) or alike(h, header(data, at + h.size))):
            end, late = len(data), {}  # a frame that goes on to the end or to another frame holds what looked like a tag
        fits = h is not None and at + h.size <= end
        if fits and not synced:  # one header alone may be chance
            fits = at + h.size == end or alike(h, header(data, at + h.size))
        if not fits:
            synced = False
            step = data.find(b"\xff", at + 1, end)
            audio.skipped += (end if step < 0 else step) - at
            at = end if step < 0 else step
            continue
        synced = True
        if not audio.headers and not audio.table and h.layer == 3 and (found := _vbr(data, at, h)) is not None:
            audio.table, audio.points = found
        else:
            audio.offsets.append(at)
            audio.headers.append(h)
            audio.samples += h.samples
            ok = checksum_fits(data, at, h)
            audio.checked += ok is not None
            audio.failed += ok is False
        at += h.size
    audio.skipped += max(0, end - at)
    audio.tags = late | audio.tags
    silent = min(audio.samples, audio.table.get("delay", 0) + audio.table.get("padding", 0))
    audio.duration = sum((Fraction(h.samples, h.rate) for h in audio.headers), Fraction(0)) if len({h.rate for h in audio.headers}) > 1 else Fraction(audio.samples, audio.headers[0].rate) if audio.headers else Fraction(0)
    if silent:
        audio.duration -= Fraction(silent, audio.headers[0].rate)
    return audio


_PROTECTED = HEADER + crc16(HEADER[2:] + bytes(SIDE)).to_bytes(2, "big") + bytes(SIDE)


def stored(payload: bytes) -> bytes:
    """Layer III frames that hold payload, a multiple of PER_FRAME bytes, behind a tag and an Info table."""
    n, rest = divmod(len(payload), PER_FRAME)
    if rest:
        raise ValueError(f"{len(payload)} bytes are no multiple of {PER_FRAME}")
    text = b"\x03payload"
    body = b"TSSE" + struct.pack(">I", len(text)) + b"\0\0" + text
    tag = b"ID3\x04\0\0" + bytes((0, 0, 0, len(body))) + body
    points = bytes(255 * i // 100 for i in range(100))
    info = b"Info" + struct.pack(">III", 7, n, (n + 1) * FRAME) + points
    head = (_PROTECTED + info).ljust(FRAME, b"\0")
    rest = bytes(FRAME - len(_PROTECTED) - PER_FRAME)
    return b"".join([tag, head, *[_PROTECTED + payload[a : a + PER_FRAME] + rest for a in range(0, len(payload), PER_FRAME)]])


def payload(data: bytes, audio: Audio) -> bytes:
    """What stored() has put into the frames."""
    return b"".join([data[a + len(_PROTECTED) : a + len(_PROTECTED) + PER_FRAME] for a in audio.offsets])


def padded(text: str | None) -> tuple[int, bytes]:
    """UTF-8 bytes of a text: their number, and they themselves up to a positive multiple of PER_FRAME."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\xff" * (PER_FRAME - len(raw) if not raw else -len(raw) % PER_FRAME)


def feature(audio: Audio) -> str:
    """Samples, exact duration, checksums and a digest of the seek offsets, as text."""
    seek = hashlib.sha256(struct.pack(f"<{len(audio.offsets)}Q", *audio.offsets)).hexdigest()[:16]
    told = audio.table.get("frames", -1)
    return f"frames={len(audio.offsets)};told={told};samples={audio.samples};seconds={audio.duration.numerator}/{audio.duration.denominator};checked={audio.checked};failed={audio.failed};seek={seek}"


RESULT = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            n, raw = padded(text)
            media = stored(raw)
            audio = parse(media)
            back = payload(media, audio)
            rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(audio)))
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = [x.split()[0] for x in RESULT.split(", ")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]], names=names)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [parse(x) for x in batch.column("media").to_pylist()]
        columns = [
            pa.array([a.samples for a in found], pa.int64()), pa.array([a.duration.numerator for a in found], pa.int64()), pa.array([a.duration.denominator for a in found], pa.int64()),
            pa.array([a.offsets for a in found], pa.list_(pa.int64())), pa.array([a.points for a in found], pa.list_(pa.int64())), pa.array([a.checked for a in found], pa.int64()), pa.array([a.failed for a in found], pa.int64()), pa.array([a.skipped for a in found], pa.int64()),
            pa.array([list(a.tags.items()) for a in found], pa.map_(pa.string(), pa.string())), pa.array([list(a.table.items()) for a in found], pa.map_(pa.string(), pa.int64())),
        ]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=["id", "samples", "seconds_over", "seconds_under", "offsets", "points", "checked", "failed", "skipped", "tags", "table"])


def parsed(media: DataFrame, id_column: str, media_column: str) -> DataFrame:
    """Exact duration, seek offsets, checksums, tags and table of each row's MPEG audio bytes."""
    tune(media.sparkSession)
    kind = dict(media.dtypes)[id_column]
    rows = media.select(F.col(id_column).alias("id"), F.col(media_column).alias("media"))
    return rows.mapInArrow(_parsed, f"id {kind}, samples bigint, seconds_over bigint, seconds_under bigint, offsets array<bigint>, points array<bigint>, checked bigint, failed bigint, skipped bigint, tags map<string,string>, table map<string,bigint>").withColumnRenamed("id", id_column)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_stored, RESULT)
