"""Cheapest repair of conversations' turns, by dynamic programming over a Re-Pair grammar.

Each row becomes one letter for its role's initial and its fault, and a
conversation a string of them. Re-Pair rules are learnt from the strings of all
conversations: in each round the commonest pairs of symbols that share none are
replaced. Every symbol has one min-plus transfer matrix: for each state of the
wanted roles before and after it, the least cost and the audit as a rope. A
letter's matrix is made directly, a rule's is the product of its two symbols'
matrices, and both are made once in a worker for all conversations there. A
conversation is folded from its end over the few symbols that are left of it.

Of audits of one cost, a matrix keeps the ASCII-least and those that start with
it and go on (they hold more insertions): with more rows behind, one of these
may turn out less. Nothing else can, so that the answer is exact.

Defined results: a null in a column of conversations counts as one space, but
for turn's order and gaps, where it comes first and is ignored; a null conv_id is a
conversation. Rows of one turn are taken by role, then text; equal rows stand
side by side, and the later ones are duplicates. A role that doesn't start
with s, u or a (an empty one too) has to be changed or deleted. A
conversation without rows has zeros, an empty audit and the hash of nothing;
an empty table gives an empty result; other columns are ignored. Texts are
only streamed, whatever their length; of one conversation, a task holds a
byte a row (its audit is one value) and hashes its rows in order, since
SHA-256 has no parallel form.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, table, tune

#: Rules of the grammar and rounds of its learning, at most.
RULES, ROUNDS = 64, 16
#: A pair that is met less often gets no rule.
LEAST = 4
# Fixed values of the task: costs of the edits, and the share of rows that are damaged.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
KINDS = 20
BLANK = r"^[\x20\x09-\x0D]*\z"
CUT = r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z"
#: Letters of rows: initial s, u, a or another, whole and truncated, and a row that must go.
WHOLE, BROKEN, GONE = "suao", "SUAO", "x"
#: States: nothing yet, behind s, behind u, behind a.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
WORDS = {"u": "user", "a": "assistant"}

# Hash of a rope, by which two ropes are compared without spelling them out.
MODULUS, BASE = (1 << 61) - 1, 1_000_003


class Rope:
    """An audit as a tree of two parts; a leaf holds one to a few letters."""

    __slots__ = ("hash", "leaf", "left", "power", "right", "size")

    def __init__(self, leaf: str = "", left: Rope | None = None, right: Rope | None = None) -> None:
        self.leaf, self.left, self.right = leaf, left, right
        if left is None:
            self.size, self.hash, self.power = len(leaf), 0, pow(BASE, len(leaf), MODULUS)
            for c in leaf:
                self.hash = (self.hash * BASE + ord(c)) % MODULUS
        else:
            self.size, self.power = left.size + right.size, left.power * right.power % MODULUS
            self.hash = (left.hash * right.power + right.hash) % MODULUS

    def __add__(self, other: Rope) -> Rope:
        return self if not other.size else other if not self.size else Rope("", self, other)

    def letters(self) -> Iterator[str]:
        """Leaves from left to right."""
        rest = [self]
        while rest:
            node = rest.pop()
            if node.left is None:
                yield node.leaf
            else:
                rest += [node.right, node.left]


def order(a: Rope, b: Rope) -> tuple[int, bool]:
    """(-1, 0 or 1 as a stands before, at or behind b in ASCII order, whether one starts with the other).

    Both are walked from the left; parts of one size and hash are passed over whole.
    """
    mine, yours = [a], [b]
    while mine and yours:
        x, y = mine.pop(), yours.pop()
        if x is y or (x.size == y.size and x.hash == y.hash):
            continue
        if x.left is None and y.left is None:
            n = min(x.size, y.size)
            if x.leaf[:n] != y.leaf[:n]:
                return (-1 if x.leaf < y.leaf else 1), False
            if x.size > n:
                mine.append(Rope(x.leaf[n:]))
            if y.size > n:
                yours.append(Rope(y.leaf[n:]))
        elif y.left is None or (x.left is not None and x.size >= y.size):
            mine += [x.right, x.left]
            yours.append(y)
        else:
            yours += [y.right, y.left]
            mine.append(x)
    left, right = any(x.size for x in mine), any(y.size for y in yours)
    return (int(left) - int(right)), True


Entry = tuple[int, list[Rope]]
Matrix = dict[tuple[int, int], Entry]


def least(ropes: list[Rope]) -> list[Rope]:
    """Of audits of one cost, the least and those that go on from it, one of each length."""
    best: dict[int, Rope] = {}
    for r in ropes:
        if r.size not in best or order(r, best[r.size])[0] < 0:
            best[r.size] = r
    first = None
    for r in best.values():
        if first is None or order(r, first)[0] < 0:
            first = r
    return [first, *(r for r in best.values() if r is not first and r.size > first.size and order(first, r)[1])]


def product(left: Matrix, right: Matrix) -> Matrix:
    """The matrix of one stretch of rows behind another."""
    costs: dict[tuple[int, int], int] = {}
    ways: dict[tuple[int, int], list[tuple[Entry, Entry]]] = {}
    for (a, b), x in left.items():
        for (c, d), y in right.items():
            if b == c:
                cost = x[0] + y[0]
                if cost < costs.get((a, d), cost + 1):
                    costs[a, d], ways[a, d] = cost, []
                if cost == costs[a, d]:
                    ways[a, d].append((x, y))
    return {k: (costs[k], least([p + q for x, y in pairs for p in x[1] for q in y[1]])) for k, pairs in ways.items()}


def inserts() -> Matrix:
    """Insertions before a row: none, one, or more, by the states that they join."""
    one: Matrix = {(a, b): (INSERT, [Rope("I")]) for (a, c), b in NEXT.items() if c in WORDS}
    none: Matrix = {(a, a): (0, [Rope()]) for a in range(4)}
    found = none
    for _ in range(3):  # states are joined by two insertions at most; the third shows nothing new
        step = product(found, one)
        for k, (cost, ropes) in step.items():
            if k not in found or cost < found[k][0]:
                found = found | {k: (cost, ropes)}
    return found


def letter(symbol: str) -> Matrix:
    """The matrix of one row, with the insertions before it."""
    found: Matrix = {(a, a): (DELETE, [Rope("D")]) for a in range(4)}
    if symbol != GONE:
        extra = TRUNCATED if symbol in BROKEN else 0
        for (a, role), b in NEXT.items():
            if role == symbol.lower():
                found[a, b] = (extra, [Rope("K")])
            elif role in WORDS:
                found[a, b] = (extra + REROLE, [Rope("R")])
    return product(inserts(), found)


Rules = tuple[tuple[str, str], ...]


class Repairs:
    """Audits of strings of symbols; a matrix is made once for each symbol, from the bottom up."""

    def __init__(self, rules: Rules) -> None:
        self.rules = rules
        self.matrix = {c: letter(c) for c in WHOLE + BROKEN + GONE}
        for pair, symbol in rules:
            self.matrix[symbol] = product(self.matrix[pair[0]], self.matrix[pair[1]])
        self.end: dict[int, tuple[int, Rope]] = {}
        for (a, b), (cost, ropes) in inserts().items():
            if b in (START, ASSISTANT) and (a not in self.end or cost < self.end[a][0]):
                self.end[a] = (cost, ropes[0])
        self.known: dict[str, tuple[int, str]] = {}

    def compressed(self, text: str) -> str:
        for pair, symbol in self.rules:
            text = text.replace(pair, symbol)
        return text

    def audit(self, text: str) -> tuple[int, str]:
        """(cost, audit) of a conversation's letters."""
        if (found := self.known.get(text)) is not None:
            return found
        state = self.end
        for symbol in reversed(self.compressed(text)):
            new: dict[int, tuple[int, Rope]] = {}
            for (a, b), (cost, ropes) in self.matrix[symbol].items():
                if b in state:
                    rest, tail = state[b]
                    for rope in ropes:
                        whole = rope + tail
                        if a not in new or cost + rest < new[a][0] or (cost + rest == new[a][0] and order(whole, new[a][1])[0] < 0):
                            new[a] = (cost + rest, whole)
            state = new
        cost, rope = state[START]
        found = cost, "".join(rope.letters())
        if len(text) <= 256:
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[text] = found
        return found


@lru_cache(maxsize=2)
def repairs(rules: Rules) -> Repairs:
    return Repairs(rules)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, alive) of rows after the fixed damage; a dropped row stays without text, for its conversation's sake."""
    spaced = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    rows = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), spaced(F.col("role")).alias("role"), spaced(F.col("text")).alias("text"))
    kind = F.crc32(F.concat(spaced(F.col("conv_id")), F.lit(":"), spaced(F.col("turn"))).cast("binary")) % KINDS
    text = F.when(kind.isin(0, 1), "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (kind != 0).alias("alive"), F.explode(copies).alias("copy")).drop("copy")


def lettered(rows: DataFrame) -> DataFrame:
    """Adds letter to damaged rows: the role's initial and the first fault. A row's earlier equals are found among rows of its role and text alone."""
    same = Window.partitionBy("conv_id", "role", "text", "alive").orderBy(F.col("turn").asc_nulls_first())
    first = F.substring("role", 1, 1)
    role = F.when(first.isin(*"sua"), first).otherwise("o")
    fault = F.when(F.col("text").rlike(BLANK), "blank").when(F.col("nth") > 1, "duplicate").when(F.col("text").rlike(CUT), "truncated")
    rows = rows.withColumn("nth", F.row_number().over(same)).withColumn("fault", F.when(F.col("alive"), fault)).drop("nth")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", F.upper(role)).otherwise(role)
    return rows.withColumn("letter", F.when(F.col("alive"), symbol))


def ordered(rows: DataFrame, *first: Column) -> DataFrame:
    """Rows dealt by conversation, and each conversation's in order."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *first, F.col("turn").asc_nulls_first(), "role", "text")


STRINGS = "conv_id bigint, letters string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint"
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation: its letters, and counts of faults, gaps and wrong neighbours."""
    schema = pa.schema([("conv_id", pa.int64()), ("letters", pa.string()), *[(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal")]])
    done: list[list] = []
    now: list | None = None  # conversation, letters, first and last turn, distinct turns, faults, wrong neighbours, last initial

    def over() -> None:
        conv, letters, low, high, kinds, faults, illegal, _ = now
        done.append([conv, "".join(letters), high - low + 1 - kinds if kinds else 0, *(faults[k] for k in ("blank", "duplicate", "truncated")), illegal])

    def flushed() -> pa.RecordBatch:
        found = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), schema.types, strict=True)], schema=schema)
        done.clear()
        return found

    for batch in batches:
        for conv, turn, letter_, fault, initial in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "letter", "fault", "initial")), strict=True):
            if now is None or now[0] != conv:
                if now is not None:
                    over()
                now = [conv, [], None, None, 0, {"blank": 0, "duplicate": 0, "truncated": 0}, 0, None]
            if letter_ is None:
                continue
            now[1].append(letter_)
            if turn is not None:
                now[2] = turn if now[2] is None else now[2]
                now[4] += turn != now[3]
                now[3] = turn
            if fault is not None:
                now[5][fault] += 1
            now[6] += now[7] is not None and (now[7], initial) not in LEGAL
            now[7] = initial
        if done:
            yield flushed()
    if now is not None:
        over()
        yield flushed()


def grammar(strings: DataFrame) -> Rules:
    """Re-Pair rules from the letters of all conversations. What comes to the driver is one count for each pair of symbols."""
    texts = strings.where(F.length("letters") > 1).groupBy(F.col("letters").alias("t")).agg(F.count("*").alias("n"))
    texts = cut_lineage(texts)
    rules: list[tuple[str, str]] = []
    for _ in range(ROUNDS):
        twos = F.transform(F.sequence(F.lit(1), F.length("t") - 1), lambda i: F.substring(F.col("t"), i, F.lit(2)))
        pairs = texts.where(F.length("t") > 1).select(F.explode(twos).alias("pair"), "n")
        counts = pairs.groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST).collect()  # (9 + RULES)² pairs at most
        used: set[str] = set()
        new: list[tuple[str, str]] = []
        for r in sorted(counts, key=lambda r: (-r.n, r.pair)):
            if len(rules) + len(new) < RULES and not used & set(r.pair):
                new.append((r.pair, chr(0x100 + len(rules) + len(new))))
                used |= set(r.pair)
        if not new:
            break
        for pair, symbol in new:
            texts = texts.withColumn("t", F.replace(F.col("t"), F.lit(pair), F.lit(symbol)))
        rules += new
    return tuple(rules)


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
AUDITED = STRINGS.replace("letters string, ", "") + ", cost bigint, audit string"


def _audited(rules: Rules) -> Run:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = repairs(rules)
        for batch in batches:
            found = [known.audit(t) for t in batch.column("letters").to_pylist()]
            kept = [n for n in batch.schema.names if n != "letters"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], names=[*kept, "cost", "audit"])

    return run


def repaired(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) of each row after an audit's edits. What stands next tells the role that an edit gives."""
    after = ""
    for edit in audit:
        wanted = "a" if after == "u" else "u"
        if edit == "I":
            yield WORDS[wanted], ""
            after = wanted
            continue
        role, text = next(rows)
        if edit == "D":
            continue
        if edit == "R":
            role = WORDS[wanted]
        yield role, text
        after = role[:1]


RESULT = AUDITED + ", repaired_sha256 string"


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results with the hash of the repaired rows. A conversation's result comes first, then its rows in order, which only pass by."""
    names = [c.split()[0] for c in AUDITED.split(", ")]

    def all_rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in [*names, "role", "text"]), strict=True)

    types = [pa.int64()] * (len(names) - 1) + [pa.string()] * 2
    held: list[list] = []
    rows = all_rows()
    row = next(rows, None)
    while row is not None:
        result = row[:-2]

        def own() -> Iterator[tuple[str, str]]:
            nonlocal row
            while (row := next(rows, None)) is not None and row[names.index("cost")] is None:
                yield row[-2:]

        following, hashed, first = own(), hashlib.sha256(), True
        for role, text in repaired(result[-1], following):
            hashed.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
            first = False
        for _ in following:  # moves on to the next result
            pass
        held.append([*result, hashed.hexdigest()])
        if len(held) == 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=[*names, "repaired_sha256"])
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=[*names, "repaired_sha256"])


def prepared(rows: DataFrame) -> DataFrame:
    """Lettered rows of a conversations table as it is: no damage, nulls as one space."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return lettered(rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), spaced("role"), spaced("text"), F.lit(True).alias("alive")))


def audits(rows: DataFrame) -> DataFrame:
    """One row per conversation of lettered rows: faults, gaps, cost and audit."""
    tune(rows.sparkSession)
    narrow = ordered(rows.select("conv_id", "turn", "letter", "fault", F.substring("role", 1, 1).alias("initial"), "role", "text")).select("conv_id", "turn", "letter", "fault", "initial")
    strings = cut_lineage(narrow.mapInArrow(_strings, STRINGS))
    return strings.mapInArrow(_audited(grammar(strings)), AUDITED)


def repair(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of each conversation after its edits, as (conv_id, place, role, text)."""
    mixed = _mixed(rows, found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def all_rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text")), strict=True)

        rows = all_rows()
        row = next(rows, None)
        while row is not None:
            conv, audit = row[:2]

            def own() -> Iterator[tuple[str, str]]:
                nonlocal row
                while (row := next(rows, None)) is not None and row[1] is None:
                    yield row[2:]

            following, out = own(), []
            for place, (role, text) in enumerate(repaired(audit, following)):
                out.append((conv, place, role, text))
                if len(out) == 1000:
                    yield _repaired_batch(out)
                    out = []
            for _ in following:
                pass
            if out:
                yield _repaired_batch(out)

    return mixed.mapInArrow(run, "conv_id bigint, place bigint, role string, text string")


def _repaired_batch(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["conv_id", "place", "role", "text"])


def _mixed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's result, and behind it its rows in order."""
    rows = rows.where(F.col("letter").isNotNull()).select("conv_id", "turn", "role", "text", F.lit(1).alias("part"))
    mixed = found.withColumn("part", F.lit(0)).unionByName(rows, allowMissingColumns=True)
    return ordered(mixed, F.col("part"))


def digests(rows: DataFrame) -> DataFrame:
    """audits() of lettered rows, with the hash of each conversation's repaired rows."""
    rows = cut_lineage(rows)
    return _mixed(rows, cut_lineage(audits(rows))).mapInArrow(_hashed, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(lettered(damaged(table(spark, sf_dir, "conversations"))))


def crc(conv: object, turn: object) -> int:
    """The damage of one row, as damaged() has it."""
    return zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % KINDS
