"""Secret scans of texts and of the layers encoded inside them.

A work list holds layers; the first is the text. Each layer is scanned with
the base patterns, then unwrapped: URL escapes, and Unicode escapes and
character references, are decoded one by one in place, and what a base64 run
holds, plain, in UTF-16 or compressed (gzip, zlib, raw deflate, bzip2, xz,
zstandard, in one or more members), becomes layers of its own. A run may go on
over line breaks, and is tried at its four alignments, so that what stands in
front of it without a break doesn't hide it. A short run that is the name in
front of a value is decoded in place. A layer that was seen before, at the
same place, isn't taken up again, so loops end; the list ends when nothing
unwraps further. A layer knows its parent and, in stretches, which part of the
parent each character comes from, so that every span is one of the text and as
narrow as its encoding allows (a compressed run is one part).

A run under MIN_RUN characters can't hold a secret: the shortest one has twelve
bytes. Compressed data of any size is unfolded to its end; it is scanned in
pieces of about PIECE bytes, which overlap and are cut where no encoded run
goes on, and grow where there is no such place.

Defined results: a null or empty text has no spans; spans are code points, end
exclusive; repeated rows get the same result each; an empty table gives an
empty result; texts of any length are scanned whole, each in one task; other
columns are kept by the pipeline stage.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import html
import itertools
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tune

#: Base patterns in the order of their kinds. Letters of the key words may have either case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?((?-i:[A-Za-z0-9+/_.=-]+))""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")
MIN_VALUE = 6
MIN_RUN = 16

_X = "[0-9A-Fa-f]"
_TAIL = f"%[89ABab]{_X}"
#: The escapes of one character in UTF-8; a byte that begins none is left as it is.
URL_ESCAPE = re.compile(f"%[0-7]{_X}|%[CDcd]{_X}{_TAIL}|%[Ee]{_X}(?:{_TAIL}){{2}}|%[Ff][0-4](?:{_TAIL}){{3}}")
UNICODE_ESCAPE = re.compile(rf"\\u[Dd][89ABab]{_X}{{2}}\\u[Dd][C-Fc-f]{_X}{{2}}|\\u{_X}{{4}}|\\u\{{{_X}{{1,6}}\}}|\\U{_X}{{8}}|\\x{_X}{{2}}|&(?:#[0-9]{{1,7}}|#[xX]{_X}{{1,6}}|[A-Za-z][A-Za-z0-9]{{1,31}});")
BASE64 = re.compile(rf"[A-Za-z0-9+/_-]{{{MIN_RUN},}}={{0,2}}")
#: A run that goes on over line breaks, as MIME has it.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{4,}+(?:[\x20\t]*\r?\n[\x20\t>]*[A-Za-z0-9+/_-]++)+={0,2}")
RUN = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
#: A short run in the place of an assignment's name.
NAME = re.compile(r"""(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{7,15}={0,2}(?=["']?\x20*[:=])""")
STANDARD = str.maketrans("-_", "+/")
#: Where compressed data may begin: gzip, zlib, bzip2, xz, zstandard.
COMPRESSED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
#: Text among other bytes, as long as the shortest secret.
PRINTED = re.compile(rb"(?:[\t\n\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){12,}+")
WIDE = re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00){12,}+|(?:\x00[\t\n\r\x20-\x7e]){12,}+")
#: Bytes of unfolded data that are scanned at once, about, and those that are scanned with the piece before too.
PIECE = 1 << 24
OVERLAP = 1 << 16
#: A byte that no encoded run holds.
BREAK = re.compile(rb"[^A-Za-z0-9+/_=%\\&;#{}\r\n-]")

Span = tuple[int, int, str]
#: Where a stretch of a layer begins, the byte or character of the source that it begins with, how many of these a
#: character takes, and the place of source number n: base + n * num / den. num is 0 if all come from one part: (first, end).
Stretch = tuple[int, int, int, int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the base patterns, leftmost and non-overlapping within each kind."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return ordered(found)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(set(spans), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


class Layer:
    """Text, the layer it comes from (None for the text itself) and the stretches that map it to that one."""

    __slots__ = ("at", "parent", "stretches", "text")

    def __init__(self, text: str, parent: Layer | None = None, stretches: list[Stretch] | None = None) -> None:
        self.text, self.parent, self.stretches = text, parent, stretches or []
        self.at = [s[0] for s in self.stretches]

    def source(self, i: int) -> tuple[int, int]:
        """The part of the parent that character i comes from."""
        at, first, unit, num, den, base = self.stretches[bisect_right(self.at, i) - 1]
        if not num:
            return first, unit
        n = first + (i - at) * unit
        return base + n * num // den, base - (-(n + unit) * num // den)

    def place(self, start: int, end: int) -> tuple[int, int]:
        """The part of the text that characters start to end come from."""
        layer = self
        while layer.parent is not None:
            start, end = layer.source(start)[0], layer.source(end - 1)[1]
            layer = layer.parent
        return start, end

    def replaced(self, pattern: re.Pattern[str], decode: Callable[[str], str | None]) -> Layer | None:
        """The layer with each match decoded; None if nothing changes."""
        parts: list[str] = []
        stretches: list[Stretch] = []
        size = at = 0

        def add(new: str, first: int, unit: int, num: int) -> None:
            nonlocal size
            if new:
                last = stretches[-1] if stretches else None
                if not (last and num and last[2:4] == (unit, num) and last[1] + (size - last[0]) * unit == first):
                    stretches.append((size, first, unit, num, 1, 0))
                parts.append(new)
                size += len(new)

        for m in pattern.finditer(self.text):
            new = decode(m[0])
            if new is None or new == m[0]:
                continue
            add(self.text[at : m.start()], at, 1, 1)
            add(new, m.start(), *((m.end() - m.start(), 1) if len(new) == 1 else (m.end(), 0)))
            at = m.end()
        if not at:
            return None
        add(self.text[at:], at, 1, 1)
        return Layer("".join(parts), self, stretches)


def _url(escapes: str) -> str | None:
    try:
        return bytes.fromhex(escapes.replace("%", "")).decode("utf-8")
    except UnicodeDecodeError:
        return None


def _unicode(escape: str) -> str | None:
    try:
        if escape[0] == "&":
            return html.unescape(escape)
        if len(escape) == 12:
            return bytes.fromhex(escape.replace("\\u", "")).decode("utf-16-be")
        return chr(int(escape[2:].strip("{}"), 16))
    except (ValueError, OverflowError):
        return None


def _short(run: str) -> str | None:
    """What a short base64 run says, if all of it is ASCII text."""
    body = run.rstrip("=").translate(STANDARD)
    if len(body) % 4 == 1:
        return None
    raw = base64.b64decode(body + "=" * (-len(body) % 4))
    return raw.decode("ascii") if raw.isascii() and raw.decode("ascii").isprintable() else None


def _unpacker(raw: bytes, at: int) -> object:
    if raw.startswith(b"BZh", at):
        return bz2.BZ2Decompressor()
    if raw.startswith(b"\xfd7zXZ", at):
        return lzma.LZMADecompressor(lzma.FORMAT_XZ)
    if raw.startswith(b"\x28\xb5\x2f\xfd", at):
        return zstandard.ZstdDecompressor().decompressobj()
    return zlib.decompressobj(47)


def _unfolded(raw: bytes, at: int, bare: bool) -> Iterator[tuple[bytes, int]]:
    """What is compressed from a place on, bit by bit, with where the data read so far ends; all members, and of a broken stream what comes before the break."""
    end = at
    while end == at or COMPRESSED.match(raw, end):
        unpack, start = zlib.decompressobj(-15) if bare else _unpacker(raw, end), end
        try:
            while not unpack.eof and end < len(raw):
                piece = raw[end : end + 4096]  # a piece unfolds to a few megabytes at most
                out = unpack.decompress(piece)
                end += len(piece) - len(unpack.unused_data)
                if out:
                    yield out, end
        except (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError):
            return
        if bare or not unpack.eof or end <= start:
            return


def _pieces(raw: bytes, at: int, bare: bool = False) -> Iterator[tuple[bytes, int]]:
    """Unfolded data in overlapping pieces, each with where the data read so far ends."""
    held, size, end = [], 0, at
    for out, end in _unfolded(raw, at, bare):
        held.append(out)
        size += len(out)
        if size < PIECE:
            continue
        whole = b"".join(held)
        held, size = [whole], len(whole)
        if COMPRESSED.search(whole):  # data compressed again is kept whole
            continue
        cut = max((m.end() for m in BREAK.finditer(whole, size - 4096)), default=0)
        if cut:
            yield whole[:cut], end
            held = [whole[max(0, cut - OVERLAP) :]]
            size = len(held[0]) - OVERLAP
    if held:
        yield b"".join(held), end


def _texts(raw: bytes) -> Iterator[tuple[bytes, int, int, tuple[int, int] | None]]:
    """Texts that bytes hold: bytes, where they begin, bytes a character (0: as UTF-8 has it), or the part of the bytes where they lie compressed."""
    todo, seen = [(raw, None)], set()
    while todo:
        raw, part = todo.pop()
        mark = (hashlib.sha256(raw).digest(), part)
        if mark in seen:
            continue
        seen.add(mark)
        at = 0
        while m := COMPRESSED.search(raw, at):
            end = at = m.start() + 1
            for piece, end in _pieces(raw, m.start()):
                todo.append((piece, part or (m.start(), end)))
            at = max(at, end)
        text = 0
        for m in PRINTED.finditer(raw):
            text += m.end() - m.start()
            yield m[0], m.start(), 0, part
        if b"\0" in raw:
            for m in WIDE.finditer(raw):
                yield m[0].replace(b"\0", b""), m.start(), 2, part
        if text < len(raw) and COMPRESSED.match(raw) is None:
            for piece, end in _pieces(raw, 0, bare=True):
                if PRINTED.search(piece) or COMPRESSED.search(piece) or end == len(raw) and len(piece) >= 12:
                    todo.append((piece, part or (0, end)))


def _packed(layer: Layer) -> Iterator[Layer]:
    """The layers that a base64 run, which is a layer's whole text, holds at any of its four alignments."""
    body = layer.text.rstrip("=").translate(STANDARD)
    for shift in range(4):
        some = body[shift:]
        some = some[: len(some) - (len(some) % 4 == 1)]
        raw = base64.b64decode(some + "=" * (-len(some) % 4))
        for found, at, width, part in _texts(raw):
            text = found.decode("utf-8", "replace")
            if part:
                yield Layer(text, layer, [(0, shift + part[0] * 4 // 3, min(len(body), shift - (-part[1] * 4 // 3)), 0, 1, 0)])
            elif width or len(text) == len(found):
                yield Layer(text, layer, [(0, at, width or 1, 4, 3, shift)])
            else:
                stretches, i = [], 0
                for unit, run in itertools.groupby(len(c.encode("utf-8")) for c in text):
                    stretches.append((i, at, unit, 4, 3, shift))
                    n = sum(1 for _ in run)
                    i, at = i + n, at + n * unit
                yield Layer(text, layer, stretches)


def unwrapped(layer: Layer) -> Iterator[Layer]:
    """The layers directly inside one."""
    text = layer.text
    if "%" in text and (new := layer.replaced(URL_ESCAPE, _url)):
        yield new
    if ("\\" in text or "&" in text) and (new := layer.replaced(UNICODE_ESCAPE, _unicode)):
        yield new
    if (":" in text or "=" in text) and (new := layer.replaced(NAME, _short)):
        yield new
    for m in BASE64.finditer(text):
        yield from _packed(Layer(m[0], layer, [(0, m.start(), 1, 1, 1, 0)]))
    for m in WRAPPED.finditer(text) if "\n" in text else ():
        lines = [r.span() for r in RUN.finditer(text, m.start(), m.end())]
        size, stretches = 0, []
        for a, b in lines:
            stretches.append((size, a, 1, 1, 1, 0))
            size += b - a
        if size >= MIN_RUN:
            yield from _packed(Layer("".join(text[a:b] for a, b in lines), layer, stretches))


def all_spans(text: str, base: list[Span] | None = None) -> list[Span]:
    """The base spans, and those of every layer, as spans of the text."""
    found = set(base_spans(text) if base is None else base)
    todo = list(unwrapped(Layer(text)))
    seen = {(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest(), 0)}
    while todo:
        layer = todo.pop()
        mark = (hashlib.sha256(layer.text.encode("utf-8", "surrogatepass")).digest(), layer.place(0, 1)[0] if layer.text else 0)
        if mark in seen:
            continue
        seen.add(mark)
        found |= {(*layer.place(a, b), kind) for a, b, kind in base_spans(layer.text)}
        todo += unwrapped(layer)
    return ordered(list(found))


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            base = base_spans(text or "")
            kinds = [s[2] for s in base]
            rows.append((*[kinds.count(k) for k in KINDS], hashlib.sha256(written(base).encode()).hexdigest(), written(all_spans(text or "", base))))
        names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]
        types = [pa.int64()] * 3 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]], names=["doc_id", *names])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base spans by kind, their digest, and all spans of each row."""
    tune(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scanned, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def redacted(text: str) -> str:
    """The text with each part that holds a secret replaced by [SECRET]."""
    parts, at = [], 0
    for a, b, _ in all_spans(text):
        if a > at or not parts:
            parts += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def _redacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [None if t is None else redacted(t) for t in batch.column("text").to_pylist()]
        new = {"text": pa.array(texts, pa.string())}
        if "n_chars" in batch.schema.names:
            new["n_chars"] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field("n_chars").type)
        yield pa.RecordBatch.from_arrays([new.get(f.name, batch.column(f.name)) for f in batch.schema], names=batch.schema.names)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: secrets are cut out of the texts; every document stays."""
    tune(spark)
    return docs.mapInArrow(_redacted, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
