"""Language identification by Bayesian evidence fusion.

Four kinds of evidence add up as log-probabilities for each language: the
text under a character trigram model (counts of all texts by declared
language, without the text itself where it is judged), the declared markup
language under its measured reliability, and a prior of the host that is
smoothed towards its address suffix, which is smoothed towards the whole
table. The counts behind the reliability and the priors come from grouped
aggregations over all rows. One more class stands for text of no declared
language: under it all trigrams are equally likely. A language's model is mixed
with that one, the more the less text there is of it, so that no language wins
by having few counts. A row is kept if a language is its best class and has at
least MIN_POSTERIOR. A row is left out of every count that it is judged by: of
its language's trigrams, of the reliability, and of its host's rows.

A trigram has a letter in its middle; what is no letter counts as a blank. A
text with hardly any letters is judged as trigrams that no language has.

Languages are all declared values. They are scored in blocks of
BLOCK_LANGUAGES, with a pass over the texts for each block, so that what is
broadcast doesn't grow with their number. Trigrams are hashed to BUCKETS
places, which bounds a language's model.

Defined results: the first language by name wins a tie; long texts are taken
in pieces of CHUNK characters; a null or empty text adds no text evidence; a null declared
language and a null host add none either; a text that fits no language has
language null, the posterior of that, and isn't kept; a language that only one
row declares has no other text to be known by; if nothing is declared in the
whole table, language is null, posterior zero and every row is kept, as there
is nothing to judge by; repeated rows are judged alike; an empty table gives an
empty result.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, hot_keys, lookup, sized, table, tune

BUCKETS = 1 << 14
#: Languages that are counted, broadcast and scored together.
BLOCK_LANGUAGES = 100
MIN_POSTERIOR = 0.5
#: Trigrams of a text overlap, and a model is never right to the last digit. Their evidence is that of all of them, on
#: average, times their number, but of this number at most, so that a long text doesn't drown the other evidence.
INDEPENDENT = 60
#: Characters whose trigrams are found at once.
CHUNK = 1 << 22
#: Rows that a suffix's or host's parent counts for.
STRENGTH = 20.0
#: Least share of the equally likely trigrams in each language's model.
MIX = 0.01
#: Prior of text in no declared language.
UNKNOWN = 0.01
#: Share of letters among characters that aren't blank, below which a text is none of words.
MIN_LETTERS = 0.1


@functools.cache
def _kinds() -> np.ndarray:
    """For each code point: 0 blank, 1 letter or mark, 2 other."""
    kinds = np.full(0x110000, 2, np.uint8)
    for c in range(0x33480):
        kinds[c] = 0 if chr(c).isspace() else 1 if unicodedata.category(chr(c))[0] in "LM" else 2
    return kinds


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the trigrams of all texts on end, where each text's begin and end, and each text's other characters.

    A text is taken in lower case, between two blanks. A trigram for each
    letter; other characters are neither letters nor blanks.
    """
    padded = [f" {t.lower()} " if t else "" for t in texts]
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    stops = np.cumsum(sizes)
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4")
    if len(codes) < 3:
        none = np.zeros(len(texts), np.int64)
        return np.zeros(0, np.int32), none, none, none
    buckets, centres, kinds = _centred(codes)
    letters, others = (np.concatenate(([0], np.cumsum(x))) for x in (kinds == 1, kinds == 2))
    starts, ends, odd = letters[stops - sizes], letters[stops], others[stops] - others[stops - sizes]
    return buckets, starts, ends, odd


def _centred(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the trigrams around the letters between the first and the last character, where these letters are, and the kind of each character."""
    kinds = _kinds()[codes]
    letter = kinds == 1
    codes = np.where(letter, codes, np.uint32(32))
    mixed = codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x85EBCA77) + codes[2:] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    return (mixed >> np.uint32(18)).astype(np.int32)[letter[1:-1]], letter[1:-1], kinds


Profile = tuple[np.ndarray, np.ndarray, int, int]


def profile(text: str) -> Profile:
    """Buckets of one long text's trigrams in order, how often each occurs, how many they are, and the other characters."""
    padded, counts, size, other = f" {text.lower()} ", np.zeros(BUCKETS, np.int64), 0, 0
    for at in range(1, len(padded) - 1, CHUNK):
        part = padded[at - 1 : at + CHUNK + 1]
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4")
        buckets, letters, kinds = _centred(codes)
        counts += np.bincount(buckets, minlength=BUCKETS)
        size, other = size + int(letters.sum()), other + int((kinds[1:-1] == 2).sum())
    found = np.flatnonzero(counts)
    return found, counts[found], size, other


def profiles(texts: list[str | None]) -> Iterator[Profile]:
    """The profile of each text; short ones are taken together."""
    short = [t if t and len(t) <= CHUNK else None for t in texts]
    buckets, starts, ends, odd = trigrams(short)
    for text, a, b, other in zip(texts, starts.tolist(), ends.tolist(), odd.tolist(), strict=True):
        if text and len(text) > CHUNK:
            yield profile(text)
        else:
            yield *np.unique(buckets[a:b], return_counts=True), b - a, other


def _counted(languages: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {x: i for i, x in enumerate(languages)}
        counts = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            texts, declared = batch.column("text").to_pylist(), batch.column("declared").to_pylist()
            for language in set(declared) & number.keys():
                own = [t for t, d in zip(texts, declared, strict=True) if d == language and t]
                counts[number[language]] += np.bincount(trigrams([t for t in own if len(t) <= CHUNK])[0], minlength=BUCKETS)
                for t in own:
                    if len(t) > CHUNK:
                        found, times, _, _ = profile(t)
                        counts[number[language], found] += times
        i, b = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(b, pa.int32()), pa.array(counts[i, b])], names=["i", "b", "n"])

    return run


def text_model(rows: DataFrame, languages: list[str]) -> np.ndarray:
    """Counts of trigrams by language over all rows; BLOCK_LANGUAGES times BUCKETS numbers at most."""
    own = rows.select("text", "declared").where(F.col("declared").between(languages[0], languages[-1]))
    counted = own.mapInArrow(_counted(languages), "i int, b int, n bigint").groupBy("i", "b").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(languages), BUCKETS), np.int64)
    counts[counted.column("i").to_numpy(), counted.column("b").to_numpy()] = counted.column("n").to_numpy()
    return counts


def logs(counts: np.ndarray, total: np.ndarray | float, kinds: np.ndarray | float) -> np.ndarray:
    """log P(trigram | language) of trigrams with these counts, for languages of total trigrams of so many kinds."""
    mix = np.maximum(MIX, kinds / np.maximum(total + kinds, 1))
    mix = np.where(total > 0, mix, 1.0)
    return np.log((1 - mix) * counts / np.maximum(total, 1) + mix / BUCKETS)


def _likelihoods(model: object, languages: list[str], ids: tuple[str, ...], last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = model.value
        totals, kinds = counts.sum(axis=1), (counts > 0).sum(axis=1)
        whole = np.ascontiguousarray(logs(counts, totals[:, None], kinds[:, None]).T)
        number = {x: i for i, x in enumerate(languages)}
        for batch in batches:
            sums, unknown = np.zeros((batch.num_rows, len(languages))), np.zeros(batch.num_rows)
            for r, ((found, times, size, other), declared) in enumerate(zip(profiles(batch.column("text").to_pylist()), batch.column("declared").to_pylist(), strict=True)):
                if size < MIN_LETTERS * (size + other):
                    n = min(size + other, INDEPENDENT)
                    sums[r], unknown[r] = n * np.log(MIX / BUCKETS), -n * np.log(BUCKETS)
                elif size:
                    sums[r] = times @ whole[found]
                    if (i := number.get(declared)) is not None:  # the text doesn't speak for itself
                        left = counts[i, found] - times
                        sums[r, i] = times @ logs(left, totals[i] - size, kinds[i] - np.count_nonzero(left == 0))
                    n = min(size, INDEPENDENT)
                    sums[r] *= n / size
                    unknown[r] = -n * np.log(BUCKETS)
            before = batch.column("ll")
            done = np.asarray(before.flatten()).reshape(batch.num_rows, -1) if len(before.flatten()) else np.zeros((batch.num_rows, 0))
            sums = np.concatenate((done, sums), axis=1)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(sums.reshape(-1)), sums.shape[1]).cast(pa.list_(pa.float64()))
            same = [c for c in (*ids, "declared", "host", "text") if c != "text" or not last]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in same], flat, pa.array(unknown)], names=[*same, "ll", "unknown"])

    return run


def identify(rows: DataFrame, ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The bigint columns ids, language, posterior and kept, from rows (ids, text, declared, host)."""
    spark = rows.sparkSession
    tune(spark)
    rows = rows.select(*[F.col(c).cast("bigint").alias(c) for c in ids], F.col("text").cast("string").alias("text"), F.lower("declared").alias("declared"), F.lower("host").alias("host"))
    languages = sorted((r["declared"] for r in rows.where("declared is not null").select("declared").distinct().collect()), key=lambda x: x.encode("utf-8", "surrogatepass"))
    if not languages:
        return rows.select(*ids, F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("posterior"), F.lit(True).alias("kept"))
    scored = rows.withColumn("ll", F.array().cast("array<double>"))
    front = "".join(f"{c} bigint, " for c in ids)
    for at in range(0, len(languages), BLOCK_LANGUAGES):
        block, last = languages[at : at + BLOCK_LANGUAGES], at + BLOCK_LANGUAGES >= len(languages)
        model = spark.sparkContext.broadcast(text_model(rows, block))
        scored = scored.mapInArrow(_likelihoods(model, block, ids, last), f"{front}declared string, host string, " + "text string, " * (not last) + "ll array<double>, unknown double")
        if not last:
            scored = cut_lineage(scored.drop("unknown"))
    best = F.when(F.array_max("ll") > F.col("unknown"), F.expr("cast(array_position(ll, array_max(ll)) as int) - 1"))
    scored = cut_lineage(scored.withColumn("best", best))
    kept = F.col("language").isNotNull() & (F.col("posterior") >= MIN_POSTERIOR)
    return fused(scored, languages).select(*ids, "language", "posterior", kept.alias("kept"))


def fused(scored: DataFrame, languages: list[str]) -> DataFrame:
    """Add language and posterior to rows (declared, host, ll, unknown, best); best is null where no language fits the text."""
    n = len(languages)
    spark = scored.sparkSession
    by_best = (F.map_from_entries(F.collect_list(F.when(F.col("best").isNotNull(), F.struct("best", "n")))), F.coalesce(F.sum(F.when(F.col("best").isNotNull(), F.col("n"))), F.lit(0)))

    def smoothed(counts: str, size: str, parent: F.Column, own: Callable[[F.Column], F.Column] = lambda i: F.lit(0)) -> F.Column:
        """Shares of the languages in counts, drawn towards those of the parent; own(i) is left out of the counts of language i."""
        all_own = F.coalesce(F.col(size), F.lit(0)) - own(F.col("best"))
        return F.transform(parent, lambda p, i: (F.coalesce(F.try_element_at(F.col(counts), i), F.lit(0)) - own(i) + STRENGTH * p) / (all_own + STRENGTH))

    def own(i: F.Column) -> F.Column:
        return F.coalesce(F.col("best").eqNullSafe(i) & F.col("best").isNotNull(), F.lit(False)).cast("int")

    # reliability: of rows whose text is best in language i, the share that declares j
    pairs = scored.where("declared is not null and best is not null").groupBy("best", "declared").agg(F.count("*").alias("n"))
    sums = {r["best"]: r["n"] for r in pairs.groupBy("best").agg(F.sum("n").alias("n")).collect()}
    said = pairs.groupBy("declared").agg(by_best[0].alias("said"))
    overall = {r["best"]: r["n"] for r in scored.where("best is not null").groupBy("best").agg(F.count("*").alias("n")).collect()}
    top = [(overall.get(i, 0) + 1.0) / (sum(overall.values()) + n) for i in range(n)]
    one = F.broadcast(spark.createDataFrame([(top, [sums.get(i, 0) + float(n) for i in range(n)], languages)], "top array<double>, sums array<double>, names array<string>"))

    named = scored.where("host is not null").withColumn("suffix", F.regexp_extract("host", r"\.([^.]+)$", 1))
    counted = named.groupBy("host", "suffix", "best").agg(F.count("*").alias("n"))
    suffixes = counted.where("suffix <> ''").groupBy("suffix", "best").agg(F.sum("n").alias("n")).groupBy("suffix").agg(by_best[0].alias("sc"), by_best[1].alias("ss"))
    hosts = cut_lineage(counted.groupBy("host", "suffix").agg(by_best[0].alias("hc"), by_best[1].alias("hs")))
    hosts = lookup(hosts, suffixes, "suffix", hot_keys(hosts, "suffix")).crossJoin(one)
    hosts = hosts.select("host", "hc", "hs", smoothed("sc", "ss", F.col("top")).alias("above"))
    rows = lookup(scored, hosts, "host", hot_keys(scored, "host"))
    rows = rows.join(F.broadcast(said), "declared", "left") if n <= BLOCK_LANGUAGES else lookup(rows, said, "declared", hot_keys(scored, "declared"))
    rows = rows.crossJoin(one)
    prior = F.when(F.col("above").isNotNull(), smoothed("hc", "hs", F.col("above"), own)).otherwise(F.col("top"))
    told = F.transform("sums", lambda s, i: (F.coalesce(F.try_element_at(F.col("said"), i), F.lit(0)) - own(i) + 1.0) / (s - own(i)))
    told = F.when(F.col("declared").isNotNull(), told).otherwise(F.array_repeat(F.lit(1.0), n))
    parts = F.zip_with(prior, told, lambda a, b: F.log(a) + F.log(b) + float(np.log(1 - UNKNOWN)))
    rows = rows.withColumn("score", F.zip_with("ll", parts, lambda a, b: a + b))
    rows = rows.withColumn("none", F.col("unknown") + float(np.log(UNKNOWN)) + F.when(F.col("declared").isNotNull(), -float(np.log(n))).otherwise(0.0))
    rows = rows.withColumn("first", F.array_max("score")).withColumn("most", F.greatest("first", "none"))
    best = F.when(F.col("first") > F.col("none"), F.element_at("names", F.array_position("score", F.col("first")).cast("int")))
    mass = F.aggregate("score", F.exp(F.col("none") - F.col("most")), lambda a, x: a + F.exp(x - F.col("most")))
    return rows.withColumn("language", best).withColumn("posterior", 1 / mass)


def of_documents(docs: DataFrame) -> DataFrame:
    """Documents as identify() takes them: lang is what was declared, source the host."""
    return docs.select("doc_id", "text", F.col("lang").alias("declared"), F.col("source").alias("host"))


def of_pages(pages: DataFrame) -> DataFrame:
    """Web pages as identify() takes them: the html element's language, else that of a meta element; the host of the address."""
    html = F.coalesce("html", F.lit(""))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<!--.*?-->|<[^>]*>", " ")
    markup = F.nullif(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1), F.lit(""))
    meta = F.nullif(F.regexp_extract(html, r"(?is)<meta\b(?=[^>]*content-language)[^>]*?\bcontent\s*=\s*[\"']?([a-z]{2,3})\b", 1), F.lit(""))
    return pages.select(F.col("page_id").alias("doc_id"), text.alias("text"), F.coalesce(markup, meta).alias("declared"), F.expr("try_parse_url(url, 'HOST')").alias("host"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows that are rejected go; columns stay as they are.

    Each row has its own verdict, whatever other rows share its doc_id, and
    rows without a doc_id have theirs. Ids and digests of the rejected rows
    are joined back; the texts are shuffled only if these are too many.
    """
    columns = docs.columns
    docs = docs.toDF(*[c if c in ("doc_id", "text", "lang", "source") else f"_c{i}" for i, c in enumerate(columns)])
    id_, mark = F.col("doc_id").cast("bigint"), F.xxhash64("text", "lang", "source")
    found = identify(docs.select("doc_id", mark.alias("mark"), "text", F.col("lang").alias("declared"), F.col("source").alias("host")), ("doc_id", "mark"))
    gone = cut_lineage(found.where("not kept").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct())
    return docs.join(sized(gone), id_.eqNullSafe(F.col("_id")) & (mark == F.col("_mark")), "left_anti").toDF(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages together, so that the languages that pages' markup declares, their addresses' suffixes and hosts all speak.

    A page's doc_id is -1 - page_id, which no document has.
    """
    docs = of_documents(table(spark, sf_dir, "documents")).withColumn("page_id", F.lit(None).cast("bigint"))
    pages = of_pages(table(spark, sf_dir, "pages")).withColumn("page_id", F.col("doc_id")).withColumn("doc_id", -1 - F.col("page_id"))
    found = identify(docs.unionByName(pages), ("doc_id", "page_id"))
    return found.select("doc_id", "page_id", "language", F.round("posterior", 6).alias("posterior"), "kept")
