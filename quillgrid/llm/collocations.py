"""Collocations of whole corpora from depth-truncated suffix subtrees, partitioned by word prefixes.

One pass over the texts turns words into keys (a hash of language and word) and
counts them; later passes read the keys alone, eight bytes a word. A suffix is
the run of up to four words that starts at a place of a piece. Counts of words
and pairs are the frequencies of prefixes: a prefix met under `least` times
starts no candidate, so suffixes end before it. Prefixes are then partitioned
vertically: one word, unless its suffixes pass the budget of a group, then two,
then the whole suffix. Groups share out the prefixes, and each group's subtree
is built on its own from its sorted suffixes and the lengths that neighbours
share; a phrase's count is the sum of the leaves below its node.

Counts are exact. Two filters of a fixed size are broadcast (words and pairs
that may be frequent); what they let through by chance is counted and dropped.
Prefixes over an eighth of a budget are broadcast too: there are at most
8 * GROUPS of each length, since the budget grows with the corpus beyond
GROUPS groups. Keys of two words that meet in one hash would spoil counts; this
is looked for, and another seed is taken.

Defined results: a null text counts as empty, a null language as `und`; texts
of any length are read whole; ties of score and count go by the bytes of the
phrase, of cuts to the first; equal and repeated rows count each time; a language
without candidates and an empty table give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, hot_keys, lookup, table, text_or_empty, tune, written

#: Words of a suffix.
DEPTH = 4
#: Suffixes of a group, unless that makes more than GROUPS groups.
BUDGET, GROUPS = 1 << 18, 1 << 16
#: Bits of the filters of words and of pairs, as powers of two.
WORD_BITS, PAIR_BITS = 24, 26
#: Bytes that are split into words at a time, words in a row of keys, and distinct words that a task counts before it gives them out.
SLICE, ROW, HELD = 1 << 20, 1 << 18, 150_000
#: Places of the text that are counted together, and rows that are given out together.
TOGETHER, GIVEN = 1 << 19, 1 << 15
# Fixed values of the task: characters that end a piece, the least count, and the factors of score and cover.
ENDS = b".,;:!?\n\x0b\x0c\r"
LEAST, FACTOR, COVER, TOP = 30, 2_000_000, 80, 2000
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + ENDS, b"abcdefghijklmnopqrstuvwxyz " + b"." * len(ENDS))

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
KEYS = ("k1", "k2", "k3", "k4")
READ = "lang string, key bigint, word string, n bigint, keys binary, starts int"


def split(folded: bytes) -> Iterator[list[bytes]]:
    """Words of a folded text in order, some SLICE bytes at a time; the end of a piece is a word '.', which no word can be."""
    at = 0
    while at < len(folded):
        end = at + SLICE
        if end < len(folded):
            end = folded.rfind(b" ", at, end) + 1 or (folded.find(b" ", end) + 1 or len(folded))
        yield folded[at:end].replace(b".", b" . ").split()
        at = end


def _read(seed: int) -> Run:
    """Rows of keys (keys, starts), counts of words (key, word, n), and each language's number of words (n alone)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("key", pa.int64()), ("word", pa.string()), ("n", pa.int64()), ("keys", pa.binary()), ("starts", pa.int32())])
        counts: dict[str, Counter] = {}
        known: dict[str, dict[bytes, int]] = {}

        def rows(**columns: list) -> pa.RecordBatch:
            size = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * size), f.type) for f in schema], schema=schema)

        def words() -> Iterator[pa.RecordBatch]:
            for lang, found in counts.items():
                found.pop(b".", None)
                spelt = list(found)
                yield rows(lang=[lang], n=[found.total()])
                for i in range(0, len(spelt), 50_000):
                    some = spelt[i : i + 50_000]
                    yield rows(lang=[lang] * len(some), key=[known[lang][w] for w in some], word=[w.decode() for w in some], n=[found[w] for w in some])
            counts.clear()
            known.clear()

        for batch in batches:
            texts: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                texts.setdefault(lang, []).append(text)
            for lang, some in texts.items():
                seen, counter, parts = known.setdefault(lang, {b".": 0}), counts.setdefault(lang, Counter()), []
                salt = lang.encode() + b"\0"
                for found in split(b"\n".join(some).translate(FOLD)):
                    fresh = Counter(found)
                    for w in fresh.keys() - seen.keys():
                        seen[w] = xxhash.xxh3_64_intdigest(salt + w, seed) >> 1 or 1
                    counter.update(fresh)
                    parts.append(np.fromiter(map(seen.__getitem__, found), np.int64, len(found)))
                keys = np.concatenate(parts) if parts else np.zeros(0, np.int64)
                for at in range(0, len(keys), ROW):
                    yield rows(lang=[lang], keys=[keys[at : at + ROW + DEPTH - 1].tobytes()], starts=[min(ROW, len(keys) - at)])
            if sum(map(len, counts.values())) > HELD:
                yield from words()
        yield from words()

    return run


def mixed(*keys: np.ndarray) -> np.ndarray:
    """One number for the keys of a phrase; different phrases may share one."""
    h = np.zeros(len(keys[0]), np.uint64)
    for k in keys:
        h = (h ^ k.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _bits(names: tuple[str, ...], power: int) -> Run:
    """(place, bits) of a filter of 2 ** power bits, by 64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = mixed(*(batch.column(n).to_numpy(zero_copy_only=False) for n in names)) >> np.uint64(64 - power)
            place, bit = (at >> np.uint64(6)).astype(np.int64), (np.uint64(1) << (at & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(bit)], names=["place", "bit"])

    return run


def filter_of(phrases: DataFrame, names: tuple[str, ...], power: int) -> Broadcast:
    """A broadcast filter that holds all phrases and maybe others. What the driver gets has 2 ** (power - 6) rows at most, at any size."""
    parts = phrases.select(*names).mapInArrow(_bits(names, power), "place bigint, bit bigint").groupBy("place").agg(F.bit_or("bit").alias("bit"))
    found = parts.toArrow()
    bits = np.zeros(1 << (power - 6), np.uint64)
    bits[found.column("place").to_numpy()] = found.column("bit").to_numpy().view(np.uint64)
    return phrases.sparkSession.sparkContext.broadcast(bits)


def may_hold(bits: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    at = mixed(*keys) >> np.uint64(64 - (len(bits).bit_length() + 5))
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def counted(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of some columns and how often each is there. A row may come twice where numbers of mixed() meet."""
    order = np.argsort(mixed(*columns))
    columns = [c[order] for c in columns]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(new)
    return [c[at] for c in columns], np.diff(np.append(at, len(order)))


def _gathered(batches: Iterator[pa.RecordBatch], made: Callable[[np.ndarray, int], list[np.ndarray]]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """counted() columns that made() gives for rows of keys, some TOGETHER places at a time."""
    held: list[list[np.ndarray]] = []
    size = 0
    for batch in batches:
        for raw, starts in zip(batch.column("keys").to_pylist(), batch.column("starts").to_pylist(), strict=True):
            keys = np.concatenate([np.frombuffer(raw, np.int64), np.zeros(DEPTH, np.int64)])
            held.append(made(keys, starts))
            size += len(held[-1][0])
            if size >= TOGETHER:
                yield counted([np.concatenate(c) for c in zip(*held, strict=True)])
                held, size = [], 0
    if size:
        yield counted([np.concatenate(c) for c in zip(*held, strict=True)])


def _given(names: list[str], columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), GIVEN):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + GIVEN]) for c in columns], names=names)


def _pairs(words: Broadcast) -> Run:
    """Pairs of words that may be frequent, with their counts."""

    def made(keys: np.ndarray, starts: int) -> list[np.ndarray]:
        keys = np.where((keys != 0) & may_hold(words.value, keys), keys, 0)
        a, b = keys[:starts], keys[1 : starts + 1]
        both = (a != 0) & (b != 0)
        return [a[both], b[both]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (a, b), n in _gathered(batches, made):
            yield from _given(["k1", "k2", "n"], [a, b, n])

    return run


class Heavy:
    """Prefixes of one and two words whose suffixes would overfill a group."""

    def __init__(self, ones: np.ndarray, twos: np.ndarray, groups: int) -> None:
        self.ones, self.twos, self.groups = np.sort(ones), np.sort(twos), groups

    @staticmethod
    def _held(values: np.ndarray, by: np.ndarray) -> np.ndarray:
        at = np.searchsorted(by, values)
        return (by[np.minimum(at, len(by) - 1)] == values) if len(by) else np.zeros(len(values), bool)

    def group(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(group of each suffix by its prefix, whether that prefix is the whole suffix)."""
        one, two = mixed(columns[0]), mixed(*columns[:2])
        longer = self._held(one, self.ones)
        longest = longer & self._held(two, self.twos)
        prefix = np.where(longest, mixed(*columns), np.where(longer, two, one))
        return (prefix % np.uint64(self.groups)).astype(np.int32), longest


def _suffixes(pairs: Broadcast, heavy: Broadcast) -> Run:
    """Suffixes of three or four words whose neighbours may be frequent pairs, with their counts, group, and whether the prefix is whole."""

    def made(keys: np.ndarray, starts: int) -> list[np.ndarray]:
        size = starts + DEPTH - 2
        a, b = keys[:size], keys[1 : size + 1]
        goes_on = (a != 0) & (b != 0)
        goes_on[goes_on] = may_hold(pairs.value, a[goes_on], b[goes_on])
        ok = goes_on[:starts] & goes_on[1 : starts + 1]
        fourth = np.where(goes_on[2 : starts + 2], keys[3 : starts + 3], 0)
        return [keys[:starts][ok], keys[1 : starts + 1][ok], keys[2 : starts + 2][ok], fourth[ok]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, n in _gathered(batches, made):
            group, whole = heavy.value.group(columns)
            yield from _given(["group", *KEYS, "n", "whole"], [group, *columns, n, whole])

    return run


class Subtree:
    """A suffix tree of sorted suffixes: its leaves, what each shares with the one before it, and totals of leaves."""

    def __init__(self, columns: list[np.ndarray], totals: np.ndarray) -> None:
        shared, equal = np.zeros(len(totals), np.int8), np.ones(max(len(totals) - 1, 0), bool)
        for c in columns:
            equal = equal & (c[1:] == c[:-1])
            shared[1:] += equal
        self.columns, self.totals, self.shared = columns, totals, shared

    def nodes(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(first leaf, count) of each node at a depth: it starts where less is shared and sums the leaves up to the next."""
        at = np.flatnonzero(self.shared < depth)
        return at, np.add.reduceat(self.totals, at) if len(at) else self.totals[:0]


def _phrases(least: int) -> Run:
    """Phrases of three and four words with their counts, from the sorted suffixes of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def grown(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            group, *columns, totals, whole = rows
            tree = Subtree([group, *columns], totals)  # the groups' subtrees side by side: suffixes of two groups share nothing
            for depth in (3, 4):
                at, counts = tree.nodes(1 + depth)
                there = (columns[depth - 1][at] != 0) & ((counts >= least) | whole[at])  # what is dealt by the whole suffix is summed later
                words = [c[at[there]] if i < depth else np.zeros(int(there.sum()), np.int64) for i, c in enumerate(columns)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, words), pa.array(counts[there])], names=[*KEYS, "n"])

        for batch in batches:
            rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("group", *KEYS, "n", "whole")]
            if rest is not None:
                rows = [np.concatenate([a, b]) for a, b in zip(rest, rows, strict=True)]
            same = np.ones(len(rows[0]), bool)
            for c in rows[:4]:
                same &= c == c[-1]
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0  # the last three words may go on in the next batch
            if cut:
                yield from grown([r[:cut] for r in rows])
            rest = merged([r[cut:] for r in rows])
        if rest is not None:
            yield from grown(rest)

    return run


def merged(rows: list[np.ndarray]) -> list[np.ndarray]:
    """Sorted rows of one beginning, equal suffixes added up: no more are held than different words follow it."""
    at = np.flatnonzero(np.append(True, rows[4][1:] != rows[4][:-1]))
    return [*(r[at] for r in rows[:5]), np.add.reduceat(rows[5], at), rows[6][at]]


def _id(*keys: Column) -> Column:
    return F.concat_ws(" ", *keys)


def _part(start: int, size: int) -> Column:
    return _id(*[F.col(KEYS[i]) for i in range(start, start + size)])


def frequent(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, size, keys, n) of each phrase of one to four words met `least` times, (key, lang, word) of their words, (lang, n) of all words."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_or_empty().cast("string").alias("text"))
    for seed in range(64):
        read = written(texts.mapInArrow(_read(seed), READ))
        spelt = read.where("word is not null").select("key", "lang", "word", "n").repartition("key").groupBy("key", "lang", "word").agg(F.sum("n").alias("n"))
        words = spelt.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"), F.min("lang").alias("lang"), F.min("word").alias("word"))
        words = cut_lineage(words.where(F.col("n") >= least))
        if not words.where("kinds > 1").limit(1).count():
            break
    totals = cut_lineage(read.where("word is null and keys is null").groupBy("lang").agg(F.sum("n").alias("n")))
    keys = read.where("keys is not null").select("keys", "starts")
    pairs = keys.mapInArrow(_pairs(filter_of(words, ("key",), WORD_BITS)), "k1 bigint, k2 bigint, n bigint")
    # tasks have counted their own pairs, most of which are met once there: a second partial count would only fill memory
    pairs = cut_lineage(pairs.repartition("k1", "k2").groupBy("k1", "k2").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
    ones = pairs.groupBy("k1").agg(F.sum("n").alias("n"))
    total = pairs.agg(F.sum("n")).first()[0] or 0
    budget = max(BUDGET, -(-total // GROUPS))
    column = lambda df, *names: [np.array(c.to_pylist(), np.int64) for c in (df.select(*names).toArrow().column(n) for n in names)]
    # at most 8 * total / budget prefixes of a length have so many suffixes
    heavy_ones = mixed(*column(ones.where(F.col("n") * 8 >= budget), "k1"))
    heavy_twos = mixed(*column(pairs.where(F.col("n") * 8 >= budget), "k1", "k2"))
    heavy = spark.sparkContext.broadcast(Heavy(heavy_ones, heavy_twos, max(1, -(-2 * total // budget))))
    columns = "k1 bigint, k2 bigint, k3 bigint, k4 bigint, n bigint"
    suffixes = keys.mapInArrow(_suffixes(filter_of(pairs, ("k1", "k2"), PAIR_BITS), heavy), f"group int, {columns}, whole boolean")
    longer = suffixes.repartition("group").sortWithinPartitions("group", *KEYS).mapInArrow(_phrases(least), columns)
    longer = longer.groupBy(*KEYS).agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    zero = F.lit(0).cast("bigint")
    found = longer.select(*KEYS, "n").unionByName(pairs.select("k1", "k2", zero.alias("k3"), zero.alias("k4"), "n")).unionByName(words.select(F.col("key").alias("k1"), *[zero.alias(k) for k in KEYS[1:]], "n"))
    size = sum((F.when(F.col(k) != 0, 1).otherwise(0) for k in KEYS[1:]), F.lit(1))
    found = found.withColumn("size", size)
    return found.withColumn("id", _id(*[F.when(F.col(k) != 0, F.col(k)) for k in KEYS])), words.select("key", "lang", "word"), totals


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The first `top` phrases of each language by the score of their weakest cut, without those that a longer one covers."""
    tune(docs.sparkSession)
    phrases, words, totals = frequent(docs, least)
    phrases = cut_lineage(phrases)
    candidates = phrases.where("size > 1")
    counts = phrases.select("id", "n")
    cuts = [F.struct(F.lit(k).alias("k"), _part(0, k).alias("first"), F.when(F.col("size") == s, _part(k, s - k)).alias("rest"), F.lit(s).alias("of")) for s in (2, 3, 4) for k in range(1, s)]
    cut = candidates.select("id", F.col("n").alias("a"), "size", F.explode(F.filter(F.array(*cuts), lambda c: c["of"] == F.col("size"))).alias("c")).select("id", "a", F.col("c.k").alias("k"), F.col("c.first").alias("first"), F.col("c.rest").alias("rest"))
    cut = cut_lineage(cut)  # a look-up reads its input for the hot keys and for both sides, so that plans would double at each
    cut = lookup(cut, counts.select(F.col("id").alias("first"), F.col("n").alias("l")), "first", hot_keys(cut, "first"))
    cut = cut_lineage(cut)
    cut = lookup(cut, counts.select(F.col("id").alias("rest"), F.col("n").alias("r")), "rest", hot_keys(cut, "rest"))
    cut = cut_lineage(cut)
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cut = cut.withColumn("both", wide("l") + wide("r")).withColumn("score", F.expr(f"cast(a as decimal(19,0)) * {FACTOR} div both"))
    scored = cut.groupBy("id").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("c")).select("id", "c.a", "c.l", "c.r", "c.score")
    inner = [F.struct(_part(i, w).alias("id"), F.lit(s).alias("of")) for s in (3, 4) for w in range(2, s) for i in range(s - w + 1)]
    covers = candidates.where("size > 2").select(F.col("n").alias("longer"), F.explode(F.filter(F.array(*inner), lambda c: c["of"] == F.col("size"))).alias("c"))
    covers = covers.groupBy(F.col("c.id").alias("id")).agg(F.max("longer").alias("longer"))
    kept = scored.join(covers, "id", "left").where(F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * COVER)).drop("longer")
    spelt = cut_lineage(kept).select("*", F.posexplode(F.split("id", " ")).alias("place", "w")).withColumn("key", F.col("w").cast("bigint")).drop("w")
    spelt = lookup(spelt, words, "key", hot_keys(spelt, "key"))
    spelt = spelt.groupBy("id", "a", "l", "r", "score").agg(F.min("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("place", "word"))).alias("words"))
    spelt = spelt.select("lang", F.array_join(F.transform("words", lambda w: w["word"]), " ").alias("phrase"), "a", "l", "r", "score")
    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = spelt.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("bigint").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, row_number() over () as p, regexp_extract_all(piece, '[^\x20\x09]+') as w
  from (select lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents)
), grams as (
  select lang, w[i : i + s - 1] as g
  from (select lang, w, unnest(range(1, len(w) + 1)) as i from pieces), (values (1), (2), (3), (4)) as sizes(s)
  where i + s - 1 <= len(w)
), counts as (select lang, g, count(*)::hugeint as a from grams group by all),
totals as (select lang, sum(a) as n from counts where len(g) = 1 group by lang),
candidates as (select * from counts where len(g) > 1 and a >= 30),
cuts as (
  select c.lang, c.g, c.a, c.k, l.a as l, r.a as r, 2000000 * c.a // (l.a + r.a) as score
  from (select *, unnest(range(1, len(g))) as k from candidates) c
  join counts l on l.lang = c.lang and l.g = c.g[1 : c.k]
  join counts r on r.lang = c.lang and r.g = c.g[c.k + 1 :]
), scored as (select * from cuts qualify row_number() over (partition by lang, g order by score, k) = 1),
covers as (
  select lang, g[i : i + s - 1] as g, max(a) as longer
  from (select lang, g, a, s, unnest(range(1, len(g) - s + 2)) as i from candidates, (values (2), (3)) as sizes(s) where s < len(g))
  group by all
)
select s.lang, row_number() over (partition by s.lang order by s.score desc, s.a desc, array_to_string(s.g, ' ')) as rank,
  array_to_string(s.g, ' ') as phrase, s.a::bigint as a, s.l::bigint as l, s.r::bigint as r, t.n::bigint as n, s.score::bigint as score
from scored s join totals t using (lang) left join covers c on c.lang = s.lang and c.g = s.g
where c.longer is null or 100 * c.longer < 80 * s.a
qualify rank <= 2000
"""
