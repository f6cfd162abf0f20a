"""SentencePiece encoding of whole texts that keeps each piece's place in the original bytes.

Normalisation is the model's own: at each place the longest key of its compiled
character map is replaced, blanks are kept, thinned or marked as the model says.
It records an alignment, one source code point for each normalised one. The
normalised text is cut before each run of blanks that follows another character,
where no piece of the model reaches across, and each such word gets its ids once
in a worker; unknown words go to the library together. Lengths of pieces, added
up, are places in the normalised text; the alignment and the lengths of UTF-8
characters turn them into byte spans of the original.

Defined results: a null or empty text has no ids and no spans; texts of any
length are taken whole (a word without blanks too); equal and repeated rows get
the same result each, and no ties arise; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty, tune

BLANK = "▁"
#: Code points of a word, at most, that a worker remembers, and words until it starts anew.
WORD, CACHED = 64, 300_000
#: Code points of the unknown words that go to the library in one call.
TOGETHER = 1 << 18
# Fixed values of the model file: numbers of its fields and kinds of pieces.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
BPE = 2
UNKNOWN, CONTROL, USER, BYTE = 2, 3, 4, 6
SUFFIX_FIELD, KIND_FIELD = 24, 3
MAP_FIELD, PREFIX_FIELD, THIN_FIELD, ESCAPE_FIELD = 2, 3, 4, 5


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, raw[at : at + size]
            at += size


class CharacterMap:
    """The compiled character map: a double array whose keys are UTF-8 strings, and what each becomes."""

    def __init__(self, compiled: bytes) -> None:
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = struct.unpack_from(f"<{size // 4}I", compiled, 4) if compiled else ()
        self.becomes = compiled[4 + size :]
        self.starts: dict[str, bool] = {}

    def child(self, node: int, byte: int) -> int:
        """The unit of a node's child, or -1."""
        unit = self.units[node]
        to = node ^ ((unit >> 10) << ((unit & 512) >> 6)) ^ byte
        return to if to < len(self.units) and self.units[to] & 0x800000FF == byte else -1

    def starts_key(self, char: str) -> bool:
        """Whether some key starts with this character."""
        found = self.starts.get(char)
        if found is None:
            node = 0 if self.units else -1
            for byte in char.encode():
                node = self.child(node, byte) if node >= 0 else -1
            found = self.starts[char] = node >= 0
        return found

    def longest(self, text: str, at: int) -> tuple[str, int] | None:
        """(replacement, code points) of the longest key at a place of text."""
        node, found = 0, None
        for i in range(at, len(text)):
            for byte in text[i].encode():
                node = self.child(node, byte)
                if node < 0:
                    return found
            unit = self.units[node]
            if unit & 256:
                start = self.units[node ^ ((unit >> 10) << ((unit & 512) >> 6))] & 0x7FFFFFFF
                found = self.becomes[start : self.becomes.index(0, start)].decode(), i + 1 - at
        return found


class Pieces:
    """Ids, decoded text and byte spans by one model."""

    def __init__(self, path: str | None, proto: bytes | None = None) -> None:
        raw = proto or open(path, "rb").read()  # a vocabulary file on each worker, not an input
        parts = list(fields(raw))
        trainer = dict(fields(next((x for n, x in reversed(parts) if n == TRAINER), b"")))
        if trainer.get(KIND_FIELD, 1) != BPE or trainer.get(SUFFIX_FIELD, 0):
            raise ValueError("a BPE model whose blanks stand before words is needed")
        spec = dict(fields(next(x for n, x in reversed(parts) if n == NORMALIZER)))
        self.map = CharacterMap(spec.get(MAP_FIELD, b""))
        self.prefix, self.thin = bool(spec.get(PREFIX_FIELD, 1)), bool(spec.get(THIN_FIELD, 1))
        if not spec.get(ESCAPE_FIELD, 1):
            raise ValueError("a model that marks blanks is needed")
        self.surface: list[bytes] = []
        self.byte: list[bool] = []
        across = False
        for text, kind in ((d[1].decode(), d.get(KIND_FIELD, 1)) for d in (dict(fields(x)) for n, x in parts if n == PIECES)):
            if kind == USER:
                raise ValueError("a model without pieces of a user's own is needed")
            self.byte.append(kind == BYTE)
            self.surface.append(bytes([int(text[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else text.replace(BLANK, " ").encode())
            across |= kind not in (BYTE, CONTROL, UNKNOWN) and re.search(f"[^{BLANK}]{BLANK}", text) is not None
        #: Words are cut only where no piece reaches across.
        self.words = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+" if not across else "(?s:.+)")
        self.spelling = ["" if b else s.decode() for b, s in zip(self.byte, self.surface, strict=True)]
        self.length = [len(s) for s in self.spelling]
        self.number = [str(i) for i in range(len(self.surface))]
        self.in_bytes, self.lengths = np.array(self.byte, np.int64), np.array(self.length, "<u4")
        self.begins = np.array([s[:1] == " " for s in self.spelling])
        self.known: dict[str, tuple[str, str, bytes]] = {}
        # the library meets normalised words only, so its own steps before the merges are taken away
        spec = b"\x0a\x08identity" + b"\x18\x00\x20\x00\x28\x01"
        bare = b"".join(self._field(n, x) for n, x in parts if n != NORMALIZER)
        self.merges = sentencepiece.SentencePieceProcessor(model_proto=bare + self._field(NORMALIZER, spec))

    @staticmethod
    def _field(number: int, value: int | bytes) -> bytes:
        def varint(n: int) -> bytes:
            out = bytearray()
            while n > 127:
                out.append(n & 127 | 128)
                n >>= 7
            return bytes([*out, n])

        return varint(number << 3 | 2) + varint(len(value)) + value if isinstance(value, bytes) else varint(number << 3) + varint(value)

    def normalised(self, text: str) -> tuple[str, np.ndarray | None]:
        """(normalised text, source code point of each of its code points and of its end); None stands for text behind a blank of its own."""
        text_starts = [c for c in set(text) if self.map.starts_key(c)] if self.map.units else []
        if not text:
            return "", None
        if not text_starts and not self.thin:
            out = text.replace(" ", BLANK)
            return (BLANK + out, None) if self.prefix else (out, np.arange(len(out) + 1))
        starts = set(text_starts)
        out: list[str] = []
        source: list[int] = []
        at, blank = 0, self.thin
        if self.thin:
            while at < len(text):
                new, size = (self.map.longest(text, at) if text[at] in starts else None) or (text[at], 1)
                if new != " ":
                    break
                at += size
            if at == len(text):
                return "", np.zeros(1, np.int64)
        if self.prefix:
            out.append(BLANK)
            source.append(at)
        while at < len(text):
            new, size = (self.map.longest(text, at) if text[at] in starts else None) or (text[at], 1)
            if blank:
                new = new.lstrip(" ")
            if new:
                out.append(new.replace(" ", BLANK))
                source.extend([at] * len(new))
                blank = self.thin and new.endswith(" ")
            at += size
        done = "".join(out)
        if self.thin:
            while done.endswith(BLANK):
                done = done[:-1]
                at = source.pop()
        return done, np.array([*source, at])

    def entry(self, ids: list[int]) -> tuple[str, str, bytes]:
        """(ids as text, decoded text, lengths of the pieces in code points) of a word."""
        lengths, run = [], b""
        for i in ids:
            if not self.byte[i]:
                lengths.append(self.length[i])
                continue
            run += self.surface[i]  # the last byte of a character stands for it
            whole = len(run) == 1 if run[0] < 128 else len(run) == (2 if run[0] < 224 else 3 if run[0] < 240 else 4)
            lengths.append(int(whole))
            run = b"" if whole else run
        return ",".join(map(str, ids)), b"".join(map(self.surface.__getitem__, ids)).decode(), np.array(lengths, "<u4").tobytes()

    def learn(self, words: list[str]) -> dict[str, tuple[str, str, bytes]]:
        """Entries of words; those of one blank and other characters go to the library in one call."""
        plain = [w for w in words if w[0] == BLANK and len(w) > 1 and w[1] != BLANK]
        found: dict[str, tuple[str, str, bytes]] = {}
        ids = np.array(self.merges.encode("".join(plain), return_type="numpy"), np.int64)
        begins = np.flatnonzero(self.begins[ids])
        if plain and len(begins) == len(plain):
            spelt, lengths = np.add.reduceat(self.in_bytes[ids], begins) > 0, self.lengths[ids].tobytes()
            numbers, surfaces = [self.number[i] for i in ids.tolist()], [self.spelling[i] for i in ids.tolist()]
            for w, a, b, by_byte in zip(plain, begins.tolist(), [*begins[1:].tolist(), len(ids)], spelt, strict=True):
                found[w] = self.entry(ids[a:b].tolist()) if by_byte else (",".join(numbers[a:b]), "".join(surfaces[a:b]), lengths[4 * a : 4 * b])
        for w in words:
            if w not in found:
                found[w] = self.entry(self.merges.encode(w))
        return found

    def _dropped(self, ids: str) -> int:
        """Blanks that decoding drops where extra ones go: one of each leading piece, until something is left of a piece."""
        n = 0
        for i in ids.split(","):
            if self.surface[int(i)][:1] != b" ":
                break
            n += 1
            if len(self.surface[int(i)]) > 1:
                break
        return n

    def some(self, texts: list[str]) -> Iterator[tuple[str, str, bytes, bool]]:
        """(ids as text, decoded text, lengths, whether a blank of the model's own stands first) of normalised texts."""
        split = [self.words.findall(t) for t in texts]
        if len(self.known) > CACHED:
            self.known.clear()
        known = self.known
        asked: list[str] = []
        long: dict[str, tuple[str, str, bytes]] = {}
        size = 0
        for w in dict.fromkeys(w for words in split for w in words if w not in known):
            if len(w) > WORD:
                long |= self.learn([w])
                continue
            asked.append(w)
            size += len(w)
            if size >= TOGETHER:
                known |= self.learn(asked)
                asked, size = [], 0
        known |= self.learn(asked)
        known = known | long if long else known
        for words in split:
            entries = [known[w] for w in words]
            decoded = "".join([e[1] for e in entries])
            if (self.prefix or self.thin) and decoded[:1] == " ":
                decoded = decoded[1:] if not self.thin else decoded[self._dropped(",".join([e[0] for e in entries])) :]
            yield ",".join([e[0] for e in entries]), decoded, b"".join([e[2] for e in entries]), self.prefix

    def encoded(self, texts: list[str]) -> Iterator[tuple[str, str, np.ndarray, np.ndarray]]:
        """(ids as text, decoded text, first byte of each piece, byte behind it) of each text."""
        held: list[tuple[str, str, np.ndarray | None]] = []
        size = 0
        for t in texts:
            held.append((t, *self.normalised(t)))
            size += len(t)
            if size >= 8 * TOGETHER:
                yield from self._placed(held)
                held, size = [], 0
        yield from self._placed(held)

    def _placed(self, held: list[tuple[str, str, np.ndarray | None]]) -> Iterator[tuple[str, str, np.ndarray, np.ndarray]]:
        for (text, _, source), (ids, decoded, lengths, _) in zip(held, self.some([n for _, n, _ in held]), strict=True):
            ends = np.cumsum(np.frombuffer(lengths, "<u4"), dtype=np.int64)
            begins = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
            begins, ends = (source[begins], source[ends]) if source is not None else (np.maximum(begins - 1, 0), np.maximum(ends - 1, 0))
            if not text.isascii():
                bytes_before = np.concatenate([[0], np.cumsum(_widths(text))])
                begins, ends = bytes_before[begins], bytes_before[ends]
            yield ids, decoded, begins, ends


def _widths(text: str) -> np.ndarray:
    """Bytes of each code point in UTF-8."""
    code = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
ENCODED = "doc_id bigint, ids array<int>, first_byte array<bigint>, end_byte array<bigint>, decoded string"
DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string"


def _whole(path: str) -> Run:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            ids, firsts, ends, decoded = [], [], [], []
            for i, d, a, b in model.encoded(batch.column("text").to_pylist()):
                ids.append([int(x) for x in i.split(",")] if i else [])
                firsts.append(a)
                ends.append(b)
                decoded.append(d)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(firsts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(decoded, pa.string())],
                names=["doc_id", "ids", "first_byte", "end_byte", "decoded"],
            )

    return run


def _digests(path: str) -> Run:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            n, hashes = [], []
            for ids, decoded, begins, ends in model.encoded(batch.column("text").to_pylist()):
                n.append(len(begins))
                spans = np.stack([begins, ends], 1).astype("<u8").tobytes()
                hashes.append([hashlib.sha256(x).hexdigest() for x in (ids.encode(), decoded.encode(), spans)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), *[pa.array([h[i] for h in hashes], pa.string()) for i in range(3)]],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"],
            )

    return run


def _texts(docs: DataFrame) -> DataFrame:
    tune(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().cast("string").alias("text"))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """ids, byte spans of their pieces in the text, and the decoded text, for each row of docs.

    path is a BPE model file. Of a character that is spelt in bytes, the last
    byte's piece has its span and the others have empty ones before it.
    """
    return _texts(docs).mapInArrow(_whole(path), ENCODED)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """encode() without its arrays: counts and digests. spans_sha256 is that of (first, end) pairs as little-endian unsigned 64-bit integers."""
    return _texts(docs).mapInArrow(_digests(path), DIGESTS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
