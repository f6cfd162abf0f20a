"""Byte-level BPE of whole texts, with tree concatenation of long unsplit text.

A long text is cut where the tokenizer's own splitting cuts it. A piece that
the splitting leaves long (a run of letters, say) is halved again and again;
the halves are encoded in parallel, as rows of their own, and joined up the
tree. At each join a window around it is encoded anew and grows until its
first token is the left side's and its last the right side's. Two neighbouring
tokens that BPE leaves side by side in one context stay so in any, so a join
on which both sides agree gives exactly the ids of the whole.

Defined results: a null or empty text has no ids; repeated rows get the same
result each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tune
from .tokens import plain, tokenizer

#: Code points from which a text is cut and its parts dealt to many tasks.
LONG = 1 << 15
#: Code points of a part, at most, unless the splitting leaves a longer piece.
PART = 1 << 14
#: Code points of a half that is encoded as a whole.
LEAF = 1 << 11
#: Tokens on either side of a join in the first window.
WINDOW = 8
SPECIAL = "<|endoftext|>"


class ByteIds:
    """Ids by a byte-level tokenizer, and the bytes that each stands for."""

    def __init__(self, path: str, ranks: str) -> None:
        self.library = tokenizer(path)
        pairs = dict(line.split() for line in open(ranks, "rb"))  # a vocabulary file on each worker, not an input
        table = {base64.b64decode(k): int(v) for k, v in pairs.items()}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.bytes: list[bytes] = [b""] * self.library.get_vocab_size()
        for raw, i in table.items():
            self.bytes[i] = raw
        self.special = self.library.token_to_id(SPECIAL)
        self.bytes[self.special] = SPECIAL.encode()

    def ids(self, text: str) -> list[int]:
        """Ids of a text; a special token's string is that token."""
        if plain(text):
            return self.fast.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids

    def text_of(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def pieces(self, text: str) -> list[tuple[int, int]]:
        """Where the tokenizer's own splitting cuts a text."""
        return [span for _, span in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of the text whose two halves have the ids left and right."""
        if not left or not right:
            return left + right
        size = WINDOW
        while True:
            a, b = max(0, len(left) - size), min(len(right), size)
            while a > 0 and self.bytes[left[a]][0] & 0xC0 == 0x80:  # not inside a character
                a -= 1
            while b < len(right) and self.bytes[right[b]][0] & 0xC0 == 0x80:
                b += 1
            middle = self.ids(self.text_of(left[a:] + right[:b]).decode("utf-8"))
            if (a == 0 or middle[0] == left[a]) and (b == len(right) or middle[-1] == right[b - 1]):
                return left[:a] + middle + right[b:]
            size *= 2

    def joined(self, parts: list[list[int]]) -> list[int]:
        """Ids of a piece from its leaves' ids, joined up the tree."""
        while len(parts) > 1:
            parts = [self.join(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else []


@lru_cache(maxsize=2)
def byte_ids(path: str, ranks: str) -> ByteIds:
    return ByteIds(path, ranks)


def halves(text: str, leaf: int = LEAF) -> list[str]:
    """Leaves of a piece: it is halved until no half is longer than leaf."""
    if len(text) <= leaf:
        return [text]
    return halves(text[: len(text) // 2], leaf) + halves(text[len(text) // 2 :], leaf)


def parts(encoder: ByteIds, text: str, leaf: int = LEAF) -> Iterator[tuple[str, bool]]:
    """(part, whether it goes on the leaf before it) of a long text, in order."""
    for n, stretch in enumerate(text.split(SPECIAL)):
        if n:
            yield SPECIAL, False
        start = end = 0
        for a, b in encoder.pieces(stretch):
            if b - a > leaf:
                if end > start:
                    yield stretch[start:end], False
                for i, half in enumerate(halves(stretch[a:b], leaf)):
                    yield half, i > 0
                start = end = b
            else:
                if b - start > PART:
                    yield stretch[start:end], False
                    start = end
                end = b
        if end > start:
            yield stretch[start:end], False


def _digests(encoder: ByteIds, ids: list[int]) -> tuple[int, str, str]:
    raw = np.array(ids, "<u4").tobytes()
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(encoder.text_of(ids)).hexdigest()


def _record(docs: list[int | None], rows: list[tuple[int, str, str]]) -> pa.RecordBatch:
    columns = [pa.array(docs, pa.int64()), pa.array([r[0] for r in rows], pa.int64()), *[pa.array([r[i] for r in rows], pa.string()) for i in (1, 2)]]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


RESULT = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _whole(paths: tuple[str, str]) -> Run:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_ids(*paths)
        for batch in batches:
            yield _record(batch.column("doc_id").to_pylist(), [_digests(encoder, encoder.ids(t or "")) for t in batch.column("text").to_pylist()])

    return run


def _cut(paths: tuple[str, str], leaf: int) -> Run:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_ids(*paths)
        for batch in batches:
            for row, doc, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True):
                found = list(parts(encoder, text, leaf))
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([row] * n, pa.int64()), pa.array([doc] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([p for p, _ in found], pa.string()), pa.array([j for _, j in found], pa.bool_())], names=["row", "doc_id", "part", "text", "goes_on"])

    return run


def _encoded(paths: tuple[str, str]) -> Run:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_ids(*paths)
        for batch in batches:
            ids = pa.array([encoder.ids(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("row", "doc_id", "part")], ids, batch.column("goes_on")], names=["row", "doc_id", "part", "ids", "goes_on"])

    return run


def _assembled(paths: tuple[str, str]) -> Run:
    """Digests of each row's ids; its parts come sorted, and a row's parts follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_ids(*paths)
        now: tuple[int, int | None] | None = None
        n, ids_hash, text_hash, leaves = 0, hashlib.sha256(), hashlib.sha256(), []

        def settle() -> None:
            nonlocal n, leaves
            ids = encoder.joined(leaves)
            n += len(ids)
            ids_hash.update(np.array(ids, "<u4").tobytes())
            text_hash.update(encoder.text_of(ids))
            leaves = []

        def over() -> pa.RecordBatch:
            settle()
            return _record([now[1]], [(n, ids_hash.hexdigest(), text_hash.hexdigest())])

        for batch in batches:
            for row, doc, ids, goes_on in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "ids", "goes_on")), strict=True):
                if now is None or now[0] != row:
                    if now is not None:
                        yield over()
                    now, n, ids_hash, text_hash, leaves = (row, doc), 0, hashlib.sha256(), hashlib.sha256(), []
                elif not goes_on:
                    settle()
                leaves.append(ids)
        if now is not None:
            yield over()

    return run


def encode(docs: DataFrame, path: str, ranks: str, long: int = LONG, leaf: int = LEAF) -> DataFrame:
    """n_tokens and digests of the ids and of the decoded text, for each row of docs.

    path is a byte-level BPE file; ranks is the same vocabulary as ranks. Texts
    over long code points are cut and dealt; of those, pieces over leaf that
    the splitting leaves whole are encoded as a tree of halves.
    """
    tune(docs.sparkSession)
    paths = (path, ranks)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    short = docs.where(F.length("text") <= long).mapInArrow(_whole(paths), RESULT)
    rows = docs.withColumn("row", F.monotonically_increasing_id()).where(F.length("text") > long)
    cut = rows.mapInArrow(_cut(paths, leaf), "row bigint, doc_id bigint, part bigint, text string, goes_on boolean")
    ids = cut.repartition("row", "part").mapInArrow(_encoded(paths), "row bigint, doc_id bigint, part bigint, ids array<int>, goes_on boolean")
    return short.unionByName(ids.repartition("row").sortWithinPartitions("row", "part").mapInArrow(_assembled(paths), RESULT))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
