"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model.

The model is one of character n-grams, counted over trusted texts (labels of
good quality that aren't toxic), all but a held-out share of them. Counts,
discounts, context sums and probabilities are DataFrames keyed by n-gram, so
the model is sharded and grows with the text. To score, documents meet in
blocks: each block asks for its distinct n-grams once, a join with the model's
shards answers with log-probability and back-off weight, and the block adds
them up per document. A document is kept if its perplexity lies between the
LOW_QUANTILE (text that repeats itself is below it) and the QUANTILE of the
held-out trusted texts of its language.

A text begins with blanks, and the lower orders count distinct characters to
the left, there as elsewhere. Log-probabilities pass between the model and the
blocks in thousandths.

Defined results: a null or empty text has no n-gram, perplexity null, and is
kept; a language with under MIN_HELD_OUT held-out texts is measured by all its
trusted texts, and one without any (null too) by those of all languages; without any trusted text perplexity is null and every row is kept;
texts of any length are scored whole, a piece of CHUNK_CHARS at a time; a
perplexity just at the threshold is kept; repeated rows get the same result
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, hot_keys, lookup, sized, table, tune

ORDER = 5
#: Code points of a block, about, and those that are taken at once.
BLOCK_CHARS = 24_000_000
CHUNK_CHARS = 4_000_000
#: n-grams that a task remembers before it passes their counts on.
HELD = 1_000_000
#: One of so many trusted documents is held out of the counts, and thresholds come from these.
HELD_OUT = 10
QUANTILE = 0.99
LOW_QUANTILE = 0.002
#: Fewer texts than these can't tell the quantile.
MIN_HELD_OUT = 100
#: A short text is judged as if so many characters of its language's mean stood before it.
STEADY = 100
#: Largest direct table, in places, for finding distinct n-grams.
DIRECT = 1 << 25


def padded(text: str | None) -> str:
    """Lower case, white space runs as one blank, ORDER - 1 blanks in front; empty if there is nothing."""
    words = (text or "").lower().split()
    return " " * (ORDER - 1) + " ".join(words) if words else ""


class Grams:
    """Distinct n-grams of some padded texts on end, of each order up to ORDER.

    at[k][i] is the number of the n-gram of order k + 1 that starts at i;
    strings(k) gives them by number, head[k] and tail[k] the numbers of each
    one's first and last k characters. There may be n-grams across two texts;
    real[k] says which ones lie in a text.
    """

    def __init__(self, texts: list[str]) -> None:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        self.alphabet, first = self._distinct(codes.astype(np.int64), 0x110000)
        self.matrix = [self.alphabet[:, None].astype("<u4")]
        self.at, self.head, self.tail = [first], [np.zeros(len(self.alphabet), np.int32)], [np.zeros(len(self.alphabet), np.int32)]
        for k in range(1, ORDER):
            width = len(self.alphabet)
            keys = self.at[-1][:-1].astype(np.int64) * width + first[k:]
            found, number = self._distinct(keys, len(self.matrix[-1]) * width)
            head = (found // max(1, width)).astype(np.int32)
            tail = np.zeros(len(found), np.int32)
            tail[number] = self.at[-1][1:]
            self.matrix.append(np.concatenate((self.matrix[-1][head], self.alphabet[found % max(1, width)][:, None].astype("<u4")), axis=1))
            self.at.append(number)
            self.head.append(head)
            self.tail.append(tail)
        self.real = []
        for k in range(ORDER):
            real = np.zeros(len(self.matrix[k]), bool)
            real[self.at[k][self.inside(k)]] = True
            self.real.append(real)

    @staticmethod
    def _distinct(keys: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys in order, and the number of each key."""
        if bound > DIRECT:
            found, number = np.unique(keys, return_inverse=True)
            return found, number.astype(np.int32)
        seen = np.zeros(bound, bool)
        seen[keys] = True
        found = np.flatnonzero(seen)
        rank = np.zeros(bound, np.int32)
        rank[found] = np.arange(len(found), dtype=np.int32)
        return found, rank[keys]

    def inside(self, k: int) -> np.ndarray:
        """Where an n-gram of order k + 1 lies in one text."""
        edge = np.zeros(len(self.at[k]) + 1, np.int32)
        stop = self.ends - k
        full = stop > self.starts
        np.add.at(edge, self.starts[full], 1)
        np.add.at(edge, np.minimum(stop[full], len(self.at[k])), -1)
        return np.cumsum(edge)[:-1] > 0

    def strings(self, k: int, which: np.ndarray) -> list[str]:
        joined = self.matrix[k][which].tobytes().decode("utf-32-le", "surrogatepass")
        return [joined[i : i + k + 1] for i in range(0, len(joined), k + 1)]

    def scores(self, number: dict[str, int], logs: np.ndarray, unknown: float) -> np.ndarray:
        """Summed log-probability of each text. logs[number[gram]]: log-probability (NaN if not counted) and back-off weight."""
        lower = backs = np.zeros(0)
        for k in range(ORDER):
            which = np.flatnonzero(self.real[k])
            found = np.full((len(self.real[k]), 2), (np.nan, 0.0))
            found[which] = logs[np.fromiter(map(number.__getitem__, self.strings(k, which)), np.int64, len(which))]
            logp, back = found[:, 0], found[:, 1]
            missing = np.isnan(logp)
            logp[missing] = unknown if k == 0 else (backs[self.head[k][missing]] + lower[self.tail[k][missing]])
            lower, backs = logp, back
        total = np.concatenate(([0.0], np.cumsum(lower[self.at[-1]])))
        stop = np.maximum(self.starts, self.ends - ORDER + 1)
        return total[np.minimum(stop, len(total) - 1)] - total[np.minimum(self.starts, len(total) - 1)]


def chunks(texts: Iterable[str | None]) -> Iterator[tuple[list[int], Grams]]:
    """Grams of some texts at a time, with the places of the texts among all; empty ones are left out.

    A long text comes in pieces that share ORDER - 1 characters, so that each n-gram of the highest order is in one.
    """
    at, held, size = [], [], 0
    for i, text in enumerate(texts):
        p = padded(text)
        for start in range(0, len(p) - ORDER + 1, CHUNK_CHARS):
            piece = p[start : start + CHUNK_CHARS + ORDER - 1]
            at.append(i)
            held.append(piece)
            size += len(piece)
            if size >= CHUNK_CHARS:
                yield at, Grams(held)
                at, held, size = [], [], 0
    if held:
        yield at, Grams(held)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, int] = {}

    def record() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["gram", "n"])

    texts = (t for batch in batches for t in batch.column("text").to_pylist())
    for _, grams in chunks(texts):
        counts = np.bincount(grams.at[-1][grams.inside(ORDER - 1)], minlength=len(grams.real[-1]))
        which = np.flatnonzero(counts)
        for g, n in zip(grams.strings(ORDER - 1, which), counts[which].tolist(), strict=True):
            held[g] = held.get(g, 0) + n
        if len(held) > HELD:
            yield record()
            held.clear()
    yield record()


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from how many n-grams occur 1 to 4 times."""
    if min(n[:3]) == 0:
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(i - 0.05, max(0.05, i - (i + 1) * y * n[i] / n[i - 1])) for i in (1, 2, 3)]


def fit(trusted: DataFrame) -> tuple[DataFrame, float]:
    """The model (gram, logp, back) of trusted texts, and the log-probability of an unknown character.

    Below the highest order counts are of distinct characters to the left.
    """
    levels = {ORDER: cut_lineage(trusted.select("text").mapInArrow(_counted, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n")))}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = cut_lineage(levels[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n")))
    steps = {}
    for k, level in levels.items():
        r = level.agg(*[F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]).collect()[0]
        steps[k] = discounts([r[f"n{i}"] for i in (1, 2, 3, 4)])
    size = levels[1].count()

    def off(k: int) -> F.Column:
        d = steps[k]
        return F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])

    def contexts(k: int) -> DataFrame:
        return levels[k].groupBy(F.substring("gram", 1, k - 1).alias("context")).agg(F.sum("n").alias("total"), (F.sum(off(k)) / F.sum("n")).alias("gamma"))

    root = contexts(1).collect()
    if not root:
        return levels[1].select("gram", F.lit(0.0).alias("logp"), F.lit(0.0).alias("back")), 0.0
    total, gamma = root[0]["total"], root[0]["gamma"]
    p = levels[1].select("gram", ((F.col("n") - off(1)) / total + gamma / (size + 1)).alias("p"))
    model = []
    for k in range(1, ORDER + 1):
        if k > 1:
            above = levels[k].withColumn("context", F.substring("gram", 1, k - 1)).withColumn("less", F.substring("gram", 2, k - 1))
            p = above.join(around, "context").join(p.select(F.col("gram").alias("less"), F.col("p").alias("q")), "less")
            p = cut_lineage(p.select("gram", ((F.col("n") - off(k)) / F.col("total") + F.col("gamma") * F.col("q")).alias("p")))
        if k < ORDER:
            around = cut_lineage(contexts(k + 1))
            weights = around.select(F.col("context").alias("gram"), F.log("gamma").alias("back"))
            # a context that was never counted itself (blanks before a text) still has a weight
            model.append(p.join(weights, "gram", "full").select("gram", F.log("p").alias("logp"), F.coalesce("back", F.lit(0.0)).alias("back")))
        else:
            model.append(p.select("gram", F.log("p").alias("logp"), F.lit(0.0).alias("back")))
    whole = model[0]
    for level in model[1:]:
        whole = whole.unionByName(level)
    return cut_lineage(whole), math.log(gamma / (size + 1))


def _shrunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(3)
    for batch in batches:
        packed = pa.array([None if t is None else pack.compress(t.encode("utf-8")) for t in batch.column("text").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "lang", "block")], packed], names=["doc_id", "lang", "block", "packed"])


def _texts(rows: pa.Table) -> Iterator[str | None]:
    unpack = zstandard.ZstdDecompressor()
    for x in rows.column("packed"):
        yield None if (raw := x.as_py()) is None else unpack.decompress(raw).decode("utf-8")


def _wanted(rows: pa.Table) -> list[str]:
    """The distinct n-grams of a block, in order."""
    wanted: set[str] = set()
    for _, grams in chunks(_texts(rows)):
        for k in range(ORDER):
            wanted.update(grams.strings(k, np.flatnonzero(grams.real[k])))
    return sorted(wanted)


def _asked(rows: pa.Table) -> pa.Table:
    wanted, block = _wanted(rows), rows.column("block")[0].as_py()
    return pa.table({"block": pa.array([block] * len(wanted), pa.int32()), "number": pa.array(range(len(wanted)), pa.int32()), "gram": pa.array(wanted, pa.string())})


def scored(docs: DataFrame, model: DataFrame, unknown: float) -> DataFrame:
    """doc_id, lang, n (characters) and logp of each row of docs (doc_id, lang, text)."""
    total = docs.agg(F.sum(F.length("text")).alias("n")).collect()[0]["n"] or 0
    blocks = max(1, -(-total // BLOCK_CHARS))
    dealt = docs.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))
    dealt = dealt.mapInArrow(_shrunk, "doc_id bigint, lang string, block int, packed binary").repartition(blocks, "block")
    asked = dealt.groupBy("block").applyInArrow(_asked, "block int, number int, gram string")
    told = asked.join(model, "gram").select("block", "number", *[F.round(F.col(c) * 1000).cast("smallint").alias(c) for c in ("logp", "back")])

    def answer(rows: pa.Table, told: pa.Table) -> pa.Table:
        number = {g: i for i, g in enumerate(_wanted(rows))}
        logs = np.full((len(number), 2), (np.nan, 0.0))
        for i, name in enumerate(("logp", "back")):
            known = told.column(name)
            some = known.is_valid().to_numpy()
            logs[told.column("number").to_numpy()[some], i] = known.drop_null().to_numpy() / 1000
        logp, n = np.zeros(rows.num_rows), np.zeros(rows.num_rows, np.int64)
        for at, grams in chunks(_texts(rows)):
            np.add.at(logp, at, grams.scores(number, logs, unknown))
            np.add.at(n, at, grams.ends - grams.starts - (ORDER - 1))
        return pa.table({"doc_id": rows.column("doc_id"), "lang": rows.column("lang"), "n": pa.array(n), "logp": pa.array(logp)})

    return dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(answer, "doc_id bigint, lang string, n bigint, logp double")


def held_out() -> F.Column:
    return F.pmod(F.xxhash64(F.col("doc_id"), F.lit("held out")), F.lit(HELD_OUT)) == 0


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, perplexity, least, threshold and kept of each row of docs (doc_id, text, lang)."""
    tune(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    ids = cut_lineage(labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id is not null").distinct())
    few = sized(ids)
    model, unknown = fit(docs.where(~held_out()).join(few, "doc_id", "left_semi"))
    if model.isEmpty():
        return docs.select("doc_id", "lang", *[F.lit(None).cast("double").alias(c) for c in ("perplexity", "least", "threshold")], F.lit(True).alias("kept"))
    scores = cut_lineage(scored(docs, model, unknown))
    trusted = cut_lineage(scores.where("n > 0").join(few, "doc_id", "left_semi"))
    hot = cut_lineage(hot_keys(scores, "lang"))
    enough = trusted.where(held_out()).groupBy("lang").agg((F.count("*") >= MIN_HELD_OUT).alias("enough"))
    measure = cut_lineage(lookup(trusted, enough, "lang", hot).where(held_out() | ~F.coalesce("enough", F.lit(False))))
    means = measure.groupBy("lang").agg((-F.sum("logp") / F.sum("n")).alias("mean"))
    whole = measure.agg((-F.sum("logp") / F.sum("n")).alias("mean")).collect()[0]["mean"]

    def steadied(rows: DataFrame) -> DataFrame:
        rows = lookup(rows, means, "lang", hot).withColumn("mean", F.coalesce("mean", F.lit(whole)))
        return rows.withColumn("steady", (F.col("mean") * STEADY - F.col("logp")) / (STEADY + F.col("n")))

    own = cut_lineage(steadied(measure))
    bounds = F.percentile_approx("steady", [LOW_QUANTILE, QUANTILE], 10_000).alias("bounds")
    overall = own.agg(bounds).collect()[0]["bounds"]
    rows = lookup(steadied(scores), own.groupBy("lang").agg(bounds), "lang", hot).withColumn("bounds", F.coalesce("bounds", F.array(*map(F.lit, overall))))
    low, high = F.element_at("bounds", 1), F.element_at("bounds", 2)
    kept = (F.col("n") == 0) | F.col("steady").between(low, high)
    return rows.select("doc_id", "lang", F.when(F.col("n") > 0, F.exp(-F.col("logp") / F.col("n"))).alias("perplexity"), F.exp(low).alias("least"), F.exp(high).alias("threshold"), kept.alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "lang", *[F.round(c, 4).alias(c) for c in ("perplexity", "least", "threshold")], "kept")
