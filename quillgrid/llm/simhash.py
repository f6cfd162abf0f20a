"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints of whole texts are linked if they differ in at most RADIUS bits.
Two that are linked agree in at least two of five bit blocks, so every
fingerprint is dealt to ten groups by two blocks each; groups meet in blocks
of bounded size. There bit planes are stored vertically (one machine word
holds one bit of 64 fingerprints), carry-save counters add the differing
planes, and words in which every pair has passed the radius are abandoned.
From each pair of blocks a spanning forest of its links goes on, not all
pairs; components come from rounds of label exchange over these edges.

Defined results: a null or empty text has fingerprint zero and is linked like
any other; rows that repeat a doc_id share its row's result each; an empty
table gives an empty result; other columns are ignored by components() and
kept by the pipeline stage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, hot_keys, lookup, sized, table, tune

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Bits of the five blocks, lowest first.
BLOCK_BITS = (13, 13, 13, 13, 12)
#: Fingerprints of a group that meet at once.
BLOCK_ROWS = 2048
#: Shingles whose bits are counted at once.
CHUNK = 1 << 14


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """64-bit SimHash: a bit is 1 if it is set in over half the shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    firsts = starts[: len(words) - width + 1].tolist()
    lasts = (starts + lengths)[width - 1 :].tolist()
    digest, votes, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(firsts)
    for at in range(0, n, CHUNK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(firsts[at : at + CHUNK], lasts[at : at + CHUNK], strict=True)], "<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints)], names=["doc_id", "fp"])


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints)], names=[*batch.schema.names, "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of each row."""
    tune(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprinted, "doc_id bigint, fp bigint")


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes of 64-bit values: row b, word w has bit b of values 64 w to 64 w + 63."""
    n = -len(values) % 64
    bits = np.unpackbits(np.concatenate((values, np.zeros(n, np.uint64))).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def within(differing: Callable[[int, np.ndarray], np.ndarray], words: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Words with a pair at most radius apart, and the mask of such pairs in each.

    differing(b, at) gives plane b of the differing bits for the words at.
    The counters are vertical too and start at 2**k - 1 - radius, so that the
    carry out of the last one says that a pair has passed the radius.
    """
    k = radius.bit_length()
    start = 2**k - 1 - radius
    at = np.arange(words)
    counters = [np.full(words, ~np.uint64(0) if start >> i & 1 else np.uint64(0)) for i in range(k)]
    over = np.zeros(words, np.uint64)
    for b in range(64):
        carry = differing(b, at)
        for i in range(k):
            counters[i], carry = counters[i] ^ carry, counters[i] & carry
        over |= carry
        if b % 4 == 3 and len(at):
            alive = over != ~np.uint64(0)
            if not alive.any():
                return at[:0], over[:0]
            if alive.sum() * 2 < len(at):
                at, over, counters = at[alive], over[alive], [c[alive] for c in counters]
    alive = over != ~np.uint64(0)
    return at[alive], ~over[alive]


def near_pairs(left: np.ndarray, right: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of left and right at most radius bits apart."""
    flat = planes(right)
    width = flat.shape[1]
    for at in range(0, len(left), 64):
        some = left[at : at + 64]
        bits = [np.where(some >> np.uint64(b) & np.uint64(1), ~np.uint64(0), np.uint64(0)) for b in range(64)]
        words, mask = within(lambda b, w, bits=bits: flat[b][w % width] ^ bits[b][w // width], len(some) * width, radius)
        if len(words):
            hit, bit = np.nonzero(np.unpackbits(mask.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            i, j = at + words[hit] // width, words[hit] % width * 64 + bit
            ok = j < len(right)
            yield i[ok], j[ok]


def listed_pairs(a: np.ndarray, b: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Places at which a and b are at most radius bits apart."""
    flat = planes(a ^ b)
    words, mask = within(lambda k, w: flat[k][w], flat.shape[1], radius)
    if not len(words):
        return words
    hit, bit = np.nonzero(np.unpackbits(mask.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    at = words[hit] * 64 + bit
    return at[at < len(a)]


class Forest:
    """Union-find over a block's places; the smaller place is the root."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = sorted((self.root(x), self.root(y)))
        self.up[y] = x


def group_edges(values: np.ndarray, side: np.ndarray, radius: int = RADIUS) -> tuple[list[int], list[int]]:
    """A spanning forest of the links between distinct values of one pair of blocks.

    side is 0 or 1 for the two blocks, and 0 throughout where a block meets itself.
    """
    forest = Forest(len(values))
    zero, one = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(one):
        one = zero
    for i, j in near_pairs(values[zero], values[one], radius):
        for x, y in zip(zero[i].tolist(), one[j].tolist(), strict=True):
            if x != y:
                forest.join(x, y)
    roots = [forest.root(x) for x in range(len(values))]
    return [x for x, r in enumerate(roots) if x != r], [r for x, r in enumerate(roots) if x != r]


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from rows (g, side, fp) that come sorted by g."""
    rest_g, rest_s, rest_v = np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, np.uint64)

    def solve(g: np.ndarray, s: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.diff(g)) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(g)]))
        sizes = ends - starts
        src, dst = [], []
        pair = starts[sizes == 2]  # the many small groups at once
        pair = pair[(s[pair] != s[pair + 1]) | (s[pair] == 0)]
        if len(pair):
            hit = pair[listed_pairs(v[pair], v[pair + 1])]
            src.append(v[hit])
            dst.append(v[hit + 1])
        for a, b in zip(starts[sizes > 2].tolist(), ends[sizes > 2].tolist(), strict=True):
            x, y = group_edges(v[a:b], s[a:b])
            src.append(v[a:b][x])
            dst.append(v[a:b][y])
        join = lambda parts: np.concatenate([*parts, np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(join(src)), pa.array(join(dst))], names=["src", "dst"])

    for batch in batches:
        if not batch.num_rows:
            continue
        g = np.concatenate((rest_g, batch.column("g").to_numpy(zero_copy_only=False)))
        s = np.concatenate((rest_s, batch.column("side").to_numpy(zero_copy_only=False)))
        v = np.concatenate((rest_v, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)))
        last = int(np.searchsorted(g, g[-1], side="left"))
        if last:
            yield solve(g[:last], s[:last], v[:last])
        rest_g, rest_s, rest_v = g[last:], s[last:], v[last:]
    if len(rest_g):
        yield solve(rest_g, rest_s, rest_v)


def edges(prints: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """src, dst: links that connect what RADIUS connects, from distinct fp."""
    low = [sum(BLOCK_BITS[:i]) for i in range(5)]
    part = [F.shiftrightunsigned("fp", low[i]).bitwiseAND(F.lit((1 << BLOCK_BITS[i]) - 1)) for i in range(5)]
    keys = [F.lit(n << 26) + part[i] * (1 << 13) + part[j] for n, (i, j) in enumerate(combinations(range(5), 2))]
    keyed = prints.select("fp", F.explode(F.array(*keys)).alias("k"))
    big = keyed.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > block_rows)
    dealt = lookup(keyed, big, "k", hot_keys(keyed, "k")).withColumn("blocks", F.coalesce(F.ceil(F.col("n") / block_rows), F.lit(1)).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    first, second = F.least("own", "other"), F.greatest("own", "other")
    pairs = dealt.select(F.when(F.col("blocks") == 1, F.col("k")).otherwise(F.xxhash64("k", first, second)).alias("g"), (F.col("own") > F.col("other")).cast("tinyint").alias("side"), "fp")
    return pairs.repartition("g").sortWithinPartitions("g").mapInArrow(_edges, "src bigint, dst bigint").distinct()


def labels(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """fp and label (the least id that it reaches), for nodes (fp, id) that have links.

    Each round every node takes the least label around it, and the node that
    gave its own id as a label takes what its followers have found (its
    label's label). Labels only fall, and there are finitely many of them, so
    the rounds end: when none changes. A node with very many links and a label
    with very many followers are hot keys, whose rows meet them by broadcast.
    """
    both = links.select("src", "dst").unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = cut_lineage(both.distinct())
    hubs = cut_lineage(hot_keys(both, "dst"))
    touched = both.select(F.col("src").alias("fp")).distinct()
    now = cut_lineage(touched.join(nodes, "fp").select("fp", "id", F.col("id").alias("label")))
    while True:
        near = lookup(both, now.select(F.col("fp").alias("dst"), "label"), "dst", hubs).groupBy(F.col("src").alias("fp")).agg(F.min("label").alias("near"))
        step = now.join(near, "fp").select("fp", "id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        # a follower's finding goes to the node whose id was its label, and that node's label to the followers
        step = cut_lineage(step)
        back = step.groupBy(F.col("was").alias("id")).agg(F.min("label").alias("found"))
        met = cut_lineage(step.join(back, "id", "left").select("fp", "id", "was", F.least("label", "found").alias("label")))
        ahead = met.select(F.col("id").alias("key"), F.col("label").alias("far"))  # one row a node: ids are distinct
        far = lookup(met.withColumn("key", F.col("label")), ahead, "key", hot_keys(met.withColumnRenamed("label", "key"), "key"))
        now = cut_lineage(far.select("fp", "id", "was", F.least("label", "far").alias("label")))
        if now.where("label < was").isEmpty():
            return now.select("fp", "label")
        now = now.drop("was")


def components(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable) of each row of docs."""
    return grouped(cut_lineage(fingerprints(docs)))


def grouped(prints: DataFrame) -> DataFrame:
    """doc_id, fp and component_id of rows (doc_id, fp).

    A row without a doc_id links nothing; it gets the component of its fingerprint, if there is one.
    """
    nodes = cut_lineage(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id")))
    links = cut_lineage(edges(nodes.select("fp")))
    found = nodes.join(labels(links, nodes), "fp", "left").select("fp", F.coalesce("label", "id").alias("component_id"))
    return lookup(prints, found, "fp", hot_keys(prints, "fp")).select("doc_id", "fp", "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group only the document with the smallest doc_id stays.

    A row goes if its own fingerprint reaches a smaller doc_id. Rows whose
    doc_id is null belong to no group and stay. Of the rows that share the
    smallest doc_id of a group one stays. The texts are joined with the ids
    that go; only rows whose ids repeat are looked at again.
    """
    columns = docs.columns
    docs = docs.toDF(*[c if c in ("doc_id", "text") else f"_c{i}" for i, c in enumerate(columns)])  # no name of the input meets one of ours
    found = cut_lineage(components(docs.where("doc_id is not null")))
    by_id = found.groupBy("doc_id").agg(F.min(F.col("doc_id") != F.col("component_id")).alias("all_go"), F.count("*").alias("n"))
    by_id = cut_lineage(by_id.where("all_go or n > 1"))
    kept = docs.join(sized(by_id.where("all_go").select("doc_id")), "doc_id", "left_anti").select(*docs.columns)
    again = by_id.where("not all_go").select("doc_id")
    if again.isEmpty():
        return kept.toDF(*columns)
    again = sized(again)
    marked = kept.join(again, "doc_id", "left_semi").mapInArrow(_marked, ", ".join([f"`{c}` {t}" for c, t in kept.dtypes] + ["fp bigint"]))
    stay = found.where("doc_id = component_id").select("doc_id", "fp").distinct()
    one = marked.join(stay, ["doc_id", "fp"], "left_semi").groupBy("doc_id").agg(*[F.first(c).alias(c) for c in docs.columns if c != "doc_id"])
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(one.select(*docs.columns)).toDF(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
