"""Fuzzy ratios against plain versions of their definitions."""

import random

import pytest
from pyspark.sql import functions as F

from quillgrid.functions import fuzzy
from quillgrid.operators import finance
from quillgrid.plans import catalogue


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        new = [0]
        for j, d in enumerate(b):
            new.append(row[j] + 1 if c == d else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def share(apart, whole):
    return 100.0 - 100.0 * apart / whole if whole else 100.0


def indel(a, b):
    return len(a) + len(b) - 2 * lcs(a, b)


def ratio(a, b):
    return share(indel(a, b), len(a) + len(b))


def part(a, b):
    s, t = sorted((a, b), key=len)
    if not s:
        return 0.0 if t else 100.0
    n = len(s)
    return max(ratio(s, t[max(0, i) : i + n]) for i in range(1 - n, len(t)))


def token(a, b):
    x, y = a.split(), b.split()
    shared, p, q = set(x) & set(y), sorted(set(x) - set(y)), sorted(set(y) - set(x))
    sect, p, q = " ".join(sorted(shared)), " ".join(p), " ".join(q)
    if not x or not y:
        sets = 0.0
    elif shared and (not p or not q):
        sets = 100.0
    else:
        n = bool(sect)
        u, v = len(sect) + n + len(p), len(sect) + n + len(q)
        sets = share(indel(p, q), u + v)
        if sect:
            sets = max(sets, share(n + len(p), len(sect) + u), share(n + len(q), len(sect) + v))
    return max(sets, ratio(" ".join(sorted(x)), " ".join(sorted(y))))


def token_part(a, b):
    x, y = a.split(), b.split()
    if set(x) & set(y):
        return 100.0
    return max(part(" ".join(sorted(x)), " ".join(sorted(y))), part(" ".join(sorted(set(x))), " ".join(sorted(set(y)))))


def weighted(a, b):
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    if longer < 1.5:
        return max(ratio(a, b), 0.95 * token(a, b))
    scale = 0.9 if longer <= 8 else 0.6
    return max(ratio(a, b), scale * part(a, b), 0.95 * scale * token_part(a, b))


def test_ratios_are_those_of_their_definitions(spark):
    rng = random.Random(7)
    words = ["GRAND", "TOTAL", "NET", "AMT", "GRAN", "TOTL", "SUB", "A", "PAYABLE", "é"]
    texts = [("GRAND TOTAL", "TOTAL GRAND"), ("", ""), ("", "NET"), ("NET", "NET"), ("GRAND TOTAL", "GRAND T0TAL"), ("TOTAL", "THE GRAND TOTAL OF IT ALL IS HERE"), ("A", "PAYABLE NOW"), ("fuzzy was a bear", "fuzzy fuzzy was a bear")]
    texts += [tuple(" ".join(rng.choice(words) for _ in range(rng.randint(0, 4))) for _ in range(2)) for _ in range(600)]
    columns = {"ratio": ratio, "part_ratio": part, "token_ratio": token, "token_part_ratio": token_part, "weighted": weighted}
    for a, b in texts:
        for name, plain in columns.items():
            assert getattr(fuzzy, name)(a, b) == pytest.approx(plain(a, b)), (name, a, b)
    frame = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(texts)], "i int, a string")
    for r in frame.withColumn("v", fuzzy.best_weighted(F.col("a"), ("NET AMT", "GRAND TOTAL"))).collect():
        assert r.v == pytest.approx(max(weighted(r.a, p) for p in ("NET AMT", "GRAND TOTAL")))
    assert ratio("this is a test", "this is a test!") == pytest.approx(96.55, abs=0.01)


def test_totals_are_ranked_by_the_plain_weighted_ratio(spark):
    rows = catalogue.QUERIES["weighted_total_rank"](spark, "/root/testdata/sf0.001").collect()
    scores = {}
    for t in {r.text for r in rows}:
        up = t.upper().strip()
        sure = any(p in up for p in finance.SURE_TOTALS)
        scores[t] = 100.0 if sure else max(max(weighted(up, p) for p in finance.SURE_TOTALS), 0.8 * max(weighted(up, p) for p in finance.LIKELY_TOTALS))
    last = {r.doc_id: 0 for r in rows}
    for r in rows:
        last[r.doc_id] = max(last[r.doc_id], r.row_no)
        assert abs(r.words - 1000 * scores[r.text]) <= 0.51 and (scores[r.text] >= 65 or "TOTAL" in r.text.upper())
    assert {r.text for r in rows} >= {"GRAND TOTL", "GRAN TOTAL", "NET TOTAL", "Bill Amnt", "GRAND T0TAL"}
    assert {r.row_no for r in rows if r.place == 1 and r.doc_id % 7 in (0, 2)} <= set(last.values())


def test_totals_of_odd_cells(spark):
    cells = spark.createDataFrame([(1, 1, None, 10), (1, 2, "", 20), (1, 3, "to  pay", 30), (2, 1, "grand total", 0), (2, 2, "grand total", 0)], "doc_id bigint, row_no int, text string, center_y bigint")
    found = sorted((r.doc_id, r.row_no, r.place, r.score) for r in finance.weighted_total_rank(cells).collect())
    assert found == [(1, 3, 1, found[0][3]), (2, 1, 1, 80_000), (2, 2, 2, 80_000)]
    assert finance.weighted_total_rank(cells.limit(0)).count() == 0
