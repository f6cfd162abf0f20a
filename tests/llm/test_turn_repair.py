"""Repair of turns against a plain search over edits, with damage, faults and grammar checked on their own."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from quillgrid.llm import turn_repair
from quillgrid.llm.turn_repair import BROKEN, GONE, WHOLE, Repairs, Rope, order

SF = "/root/testdata/sf0.001"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SHAPE = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(letters):
    """Least (cost, audit) by a search from the end, over rows and the initial before them."""

    @lru_cache(maxsize=None)
    def best(i, after, inserted):
        found = [(0, "")] if i == len(letters) and after in ("", "a") else []
        if inserted < 2:  # more than two insertions in a row can't help
            for (a, b) in SHAPE:
                if a == after and b != "s":
                    cost, audit = best(i, b, inserted + 1)
                    found.append((cost + 5, "I" + audit))
        if i < len(letters):
            cost, audit = best(i + 1, after, 0)
            found.append((cost + 2, "D" + audit))
            if letters[i] != GONE:
                extra = 5 if letters[i] in BROKEN else 0
                for (a, b) in SHAPE:
                    if a == after:
                        cost, audit = best(i + 1, b, 0)
                        if b == letters[i].lower():
                            found.append((cost + extra, "K" + audit))
                        if b != "s":
                            found.append((cost + extra + 1, "R" + audit))
        return min(found, default=(10**9, ""))

    return best(0, "", 0)


def test_audits_are_the_least_of_the_cheapest():
    rng = random.Random(11)
    texts = ["".join(rng.choice(rng.choice([WHOLE + BROKEN + GONE, "sua", "uaUA", "ua", "uuaS", "aAx"])) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    texts += ["ua" * 60, "a" * 40, "aU" * 30, "x" * 20, "sS" * 10]
    rules, used = [], WHOLE + BROKEN + GONE
    for i in range(40):
        pair = rng.choice(used) + rng.choice(used)
        rules.append((pair, chr(0x100 + i)))
        used += rules[-1][1]
    plain, shared = Repairs(()), Repairs(tuple(rules))
    for t in texts:
        assert plain.audit(t) == shared.audit(t) == cheapest(t), t


def test_ropes_compare_as_their_letters():
    rng = random.Random(1)

    def rope(n):
        return Rope("".join(rng.choice("DK") for _ in range(n))) if n < 3 else rope(n // 2) + rope(n - n // 2)

    for _ in range(2000):
        a, b = rope(rng.randint(0, 7)), rope(rng.randint(0, 7))
        x, y = "".join(a.letters()), "".join(b.letters())
        assert order(a, b) == ((x > y) - (x < y), x.startswith(y) or y.startswith(x))


def plain_results(rows):
    """The contract's columns by conversation, row by row."""
    convs = {}
    for conv, turn, role, text in rows:
        kept = convs.setdefault(conv, [])
        show = lambda v: " " if v is None else str(v)
        role, text, kind = show(role), show(text), zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        letters, seen, faults = "", set(), {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in kept:
            bare = text.rstrip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            c = role[:1] if role[:1] in ("s", "u", "a") else "o"
            letters += GONE if fault in ("blank", "duplicate") else c.upper() if fault else c
        cost, audit = cheapest(letters)
        turns = {t for t, _, _ in kept if t is not None}
        rest, result, after = list(kept), [], ""
        for e in audit:
            new = "a" if after == "u" else "u"
            if e == "I":
                result.append(({"u": "user", "a": "assistant"}[new], ""))
            else:
                _, role, text = rest.pop(0)
                if e == "D":
                    continue
                result.append((role if e == "K" else {"u": "user", "a": "assistant"}[new], text))
            after = result[-1][0][:1]
        assert not rest and re.fullmatch("(s?(ua)+)?", "".join(r[0][:1] for r in result))
        initials = [r[1][:1] for r in kept]
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:], strict=False))
        whole = "\n".join(f"{r}:{t}" for r, t in result)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *faults.values(), illegal, cost, audit, hashlib.sha256(whole.encode()).hexdigest())
    return out


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def results(frame):
    rows = turn_repair.digests(turn_repair.lettered(turn_repair.damaged(frame))).collect()
    found = {r.conv_id: tuple(r[n] for n in NAMES) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_whole_tables_by_brute_force(spark, sf):
    table = spark.read.parquet(f"/root/testdata/sf{sf}/conversations.parquet")
    assert results(table) == plain_results([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
    assert turn_repair.query(spark, f"/root/testdata/sf{sf}").columns == ["conv_id", *NAMES[:5], "cost", "audit", "repaired_sha256"]


def test_odd_rows(spark):
    """Nulls in any column, repeated rows, ties of a turn, odd roles, long texts, gaps, clashing names and no rows."""
    rng = random.Random(12)
    words = ["Hi there.", "Yes!", "and then", None, "", " \t\n", "So?\n", " ", "ok.\u0085", "long " * 30_000 + "end."]
    rows = [(c, rng.choice([None, *range(12)]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, "", "uncle"]), rng.choice(words)) for c in [None, *range(60)] for _ in range(rng.randint(1, 9))]
    rows += rows[:20] + [(1000, None, None, None), (2000, 5, "user", "x"), (2000, 9, "user", "x")]
    rows += [(3000, t, "user" if t % 2 else "assistant", f"Turn {t % 50}.") for t in range(3000)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("audit", F.lit("mine")).withColumn("letter", F.lit(1)).repartition(5)
    found = results(frame)
    expected = plain_results([r for r in rows if r[0] != 3000])
    assert {k: v for k, v in found.items() if k != 3000} == expected
    assert found[3000][1] + found[3000][2] > 2000 and len(found[3000][6]) >= 2800
    assert turn_repair.query.__module__ and results(frame.limit(0)) == {}


def test_repaired_rows_have_the_wanted_shape(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = turn_repair.lettered(turn_repair.damaged(table))
    found = turn_repair.audits(rows)
    hashes = {r.conv_id: r.repaired_sha256 for r in turn_repair.digests(rows).collect()}
    groups = {}
    for r in sorted(turn_repair.repair(rows, found).collect(), key=lambda r: (r.conv_id, r.place)):
        groups.setdefault(r.conv_id, []).append((r.role, r.text))
    for conv, turns in groups.items():
        assert re.fullmatch("s?(ua)+", "".join(r[0] for r, _ in turns))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest() == hashes[conv]
    undamaged = turn_repair.audits(turn_repair.prepared(table)).collect()
    assert sum(r.cost == 0 and set(r.audit) == {"K"} for r in undamaged) >= 5  # endings of a user are no damage, but cost a deletion


def test_rules_are_learnt_from_all_conversations(spark):
    strings = spark.createDataFrame([(i, t) for i, t in enumerate(["suauaua"] * 50 + ["uaua"] * 50 + ["xS"] * 3)], "conv_id bigint, letters string")
    rules = turn_repair.grammar(strings)
    assert rules[0][0] in ("ua", "au") and "xS" not in [p for p, _ in rules]
    assert len(Repairs(rules).compressed("suauaua")) <= 2
