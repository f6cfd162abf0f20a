"""Quality rules combined by weak supervision.

Each rule votes good, votes bad or abstains. Expectation-maximisation over
the counts of vote patterns (all documents, a fixed number of patterns)
estimates how often each rule is right, and a document stays if its posterior
probability of being good reaches the threshold. A document that fails a base
rule (too short, or mostly repeated) goes without a vote.

Defined results: a null or empty text has no words and fails the base rule;
repeated rows are judged alike; an empty table gives an empty result; with_measures()
replaces a column of the input that has the name of a measure, and the
pipeline stage leaves all columns as they were.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, table, tune

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letter_words", "n_stops")
RULES = ("length", "word_length", "symbols", "dup_lines", "repeats", "letters", "sentences")
KEEP_FROM = 0.5


def measure(text: str | None) -> tuple[int, ...]:
    """MEASURES of one text. A word is a run of other than ASCII white space."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text or "") - sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        often = {w for w, k in Counter(windows).items() if k > 1}
        covered = 0  # the first word that no earlier window has counted
        for i, w in enumerate(windows):
            if w in often:
                repeated += i + 3 - max(i, covered)
                covered = i + 3
    symbols = sum(raw.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))
    letters = sum(map(bytes.isalpha, words)) + sum(1 for w in words if not w.isalpha() and w[:-1].isalpha() and w[-1:] in b".,;:!?") if raw.isascii() else _letter_words(words)
    stops = raw.count(b".") + raw.count(b"!") + raw.count(b"?")
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), letters, stops


def _letter_words(words: list[bytes]) -> int:
    """Words of letters alone, but for one closing mark. Letters beyond ASCII count."""
    return sum(1 for w in words if (w if w[-1] not in b".,;:!?" else w[:-1]).decode("utf-8", "replace").isalpha())


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measure(t) for t in batch.column("text").to_pylist()]
        kept = [(f, batch.column(f.name)) for f in batch.schema if f.name not in MEASURES]
        new = [(pa.field(m, pa.int64()), pa.array([r[i] for r in rows], pa.int64())) for i, m in enumerate(MEASURES)]
        yield pa.RecordBatch.from_arrays([a for _, a in kept + new], schema=pa.schema([f for f, _ in kept + new]))


def with_measures(docs: DataFrame) -> DataFrame:
    """docs with MEASURES of each whole text."""
    tune(docs.sparkSession)
    docs = docs.drop(*MEASURES)
    return docs.mapInArrow(_measured, ", ".join([f"`{c}` {t}" for c, t in docs.dtypes] + [f"{m} bigint" for m in MEASURES]))


def base_failed() -> Column:
    n = F.col("n_words")
    return (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n)


def votes() -> dict[str, Column]:
    """Each rule as a column: 1 good, 0 bad, null if it abstains."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))

    def vote(value: Column, good: Column, bad: Column) -> Column:
        return F.when(bad, 0).when(good, 1)

    def band(value: Column, low: float, high: float, least: float, most: float) -> Column:
        return vote(value, (value >= low) & (value <= high), (value < least) | (value > most))

    length, symbols = F.col("word_chars") / n, F.col("n_symbols") / n
    repeats, dup, letters = F.col("n_repeat_words") / n, F.col("n_dup_lines") / lines, F.col("n_letter_words") / n
    return {
        "length": vote(n, n >= 60, n < MIN_WORDS),
        "word_length": band(length, 3, 10, 2, 14),
        "symbols": vote(symbols, symbols <= 0.05, symbols > 0.1),
        "dup_lines": vote(dup, dup <= 0.1, dup > 0.4),
        "repeats": vote(repeats, repeats <= 0.2, repeats > 0.4),
        "letters": vote(letters, letters >= 0.85, letters < 0.7),
        "sentences": vote(n, F.col("n_stops") * 60 >= n, F.col("n_stops") * 400 < n),
    }


#: P(good vote | good document) and P(bad vote | bad document) of each rule.
Model = tuple[float, list[float], list[float]]


def fit(patterns: list[tuple[tuple[int | None, ...], int]], rounds: int = 300) -> Model:
    """Prior and accuracies by expectation-maximisation over (votes, count) pairs.

    Each rule has one accuracy on good and one on bad documents, since most
    rules see only one kind of fault. A bad vote always speaks against a
    document (its rate among bad ones is at least 0.05 above that among good
    ones), so the classes can't change places; the prior stays between 0.05
    and 0.95. Without any pattern the start values come back.
    """
    prior, on_good, on_bad = 0.8, [0.9] * len(RULES), [0.6] * len(RULES)
    for _ in range(rounds):
        good = total = 0.0
        sums = [[1.8, 2.0, 1.2, 2.0] for _ in RULES]  # as if each rule had cast two more votes on either kind
        for pattern, count in patterns:
            p = posterior((prior, on_good, on_bad), pattern)
            good, total = good + p * count, total + count
            for s, v in zip(sums, pattern, strict=True):
                if v is not None:
                    s[0] += count * p * v
                    s[1] += count * p
                    s[2] += count * (1 - p) * (1 - v)
                    s[3] += count * (1 - p)
        if not total:
            break
        new_good = [min(0.995, max(0.6, s[0] / s[1])) for s in sums]
        new_bad = [min(0.995, max(1.05 - g, s[2] / s[3])) for s, g in zip(sums, new_good, strict=True)]
        moved = max(abs(x - y) for x, y in zip(new_good + new_bad, on_good + on_bad, strict=True))
        prior, on_good, on_bad = min(0.95, max(0.05, good / total)), new_good, new_bad
        if moved < 1e-9:
            break
    return prior, on_good, on_bad


def weights(model: Model) -> list[tuple[float, float]]:
    """Log-odds that a good and a bad vote of each rule add."""
    return [(math.log(g / (1 - b)), math.log((1 - g) / b)) for g, b in zip(*model[1:], strict=True)]


def posterior(model: Model, pattern: tuple[int | None, ...]) -> float:
    logit = math.log(model[0] / (1 - model[0])) + sum(w[0] if v else w[1] for w, v in zip(weights(model), pattern, strict=True) if v is not None)
    return 1 / (1 + math.exp(-logit))


def learn(measured: DataFrame) -> Model:
    """Fit on all rows with MEASURES. At most 3 ** len(RULES) counts reach the driver."""
    rows = measured.where(~base_failed()).select(*[v.alias(k) for k, v in votes().items()]).groupBy(*RULES).agg(F.count("*").alias("n")).collect()
    return fit(sorted(((tuple(r[k] for k in RULES), r["n"]) for r in rows), key=str))


def judged(measured: DataFrame, model: Model, keep_from: float = KEEP_FROM) -> DataFrame:
    """Add base_failed, quality (posterior) and kept."""
    logit = F.lit(math.log(model[0] / (1 - model[0])))
    for (good, bad), v in zip(weights(model), votes().values(), strict=True):
        logit = logit + F.coalesce(F.when(v == 1, good).when(v == 0, bad), F.lit(0.0))
    out = measured.withColumn("base_failed", base_failed()).withColumn("quality", 1 / (1 + F.exp(-logit)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep_from))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go; columns stay as they are. Texts are measured once."""
    columns = docs.columns
    aside = [c if c == "text" else f"_c{i}" for i, c in enumerate(columns)]  # no name of the input meets one of ours
    measured = cut_lineage(with_measures(docs.toDF(*aside)))
    return judged(measured, learn(measured)).where("kept").select(*aside).toDF(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    measured = cut_lineage(with_measures(docs).drop("text"))
    out = judged(measured, learn(measured))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))
