"""Collocations against SQL over whole tables and against plain counting of small ones."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgrid.llm import collocations

SF = "/root/testdata/sf0.001"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, least=30, top=2000):
    """The contract's rows, by counting all n-grams."""
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            w = re.findall("[^ \t]+", piece)
            totals[lang] += len(w)
            counts.setdefault(lang, Counter()).update(tuple(w[i : i + s]) for s in (1, 2, 3, 4) for i in range(len(w) - s + 1))
    out = []
    for lang, c in counts.items():
        found = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        covered = {}
        for g, a in found.items():
            for s in range(2, len(g)):
                for i in range(len(g) - s + 1):
                    covered[g[i : i + s]] = max(covered.get(g[i : i + s], 0), a)
        rows = []
        for g, a in found.items():
            score, k = min((2_000_000 * a // (c[g[:k]] + c[g[k:]]), k) for k in range(1, len(g)))
            if 100 * covered.get(g, 0) < 80 * a:
                rows.append((-score, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        out += [(lang, n, p.decode(), -a, x, y, totals[lang], -s) for n, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def mined(frame, **kw):
    return sorted(tuple(r[c] for c in COLUMNS) for r in collocations.mine(frame, **kw).collect())


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_whole_tables_by_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as from '/root/testdata/sf{sf}/documents.parquet'")
    expected = sorted(con.execute(f"select {', '.join(COLUMNS)} from ({collocations.ORACLE_SQL})").fetchall())
    rows = collocations.query(spark, f"/root/testdata/sf{sf}").collect()
    assert len(expected) > 20 and sorted(tuple(r[c] for c in COLUMNS) for r in rows) == expected


def test_groups_and_heavy_prefixes_change_nothing(spark, monkeypatch):
    frame = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    expected = plain([(r.lang, r.text) for r in frame.collect()], least=5)
    for budget, groups, row, together in ((64, 1 << 16, 50, 300), (2000, 1 << 16, 1 << 20, 1 << 21), (1, 3, 7, 1000)):
        for name, value in (("BUDGET", budget), ("GROUPS", groups), ("ROW", row), ("TOGETHER", together), ("SLICE", 500), ("HELD", 200)):
            monkeypatch.setattr(collocations, name, value)
        assert mined(frame, least=5) == expected


def test_full_filters_and_meeting_hashes_change_nothing(spark, monkeypatch):
    """Filters that let everything through, and a first seed under which words meet."""
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    monkeypatch.setattr(collocations, "WORD_BITS", 7)
    monkeypatch.setattr(collocations, "PAIR_BITS", 7)
    hashed, seeds = collocations._read, []

    def read(seed):
        seeds.append(seed)
        run = hashed(seed)

        def weak(batches):
            for batch in run(batches):
                key = batch.column("key").to_numpy(zero_copy_only=False)
                fields = {n: batch.column(n) for n in batch.schema.names}
                if seed == 0 and not np.isnan(key.astype(float)).any():
                    fields["key"] = type(fields["key"]).from_pandas(key % 50 + 1)
                yield type(batch).from_arrays(list(fields.values()), schema=batch.schema)

        return weak

    monkeypatch.setattr(collocations, "_read", read)
    assert mined(frame, least=8) == plain([(r.lang, r.text) for r in frame.collect()], least=8)
    assert seeds == [0, 1]


def test_odd_rows(spark):
    """Nulls, empty and long texts, ties, repeats, characters beyond ASCII, one phrase that holds most, clashing names, no rows."""
    rows = [("en", "New York, new york! NEW\tYORK city hall. " * 20), (None, "le ça va ÇA VA\x0bçA va " * 40), ("und", "ça va " * 3), ("en", None), ("en", ""), ("de", "a b c d e " * 70_000), ("xx", "tie one tie two " * 31)]
    rows += [("en", "x\x1cy z w x\x1cy z w\x0ca b " * 33)] + [("en", "tie one two, tie three four\n" * 30)] * 2 + [("fr", "no")]
    frame = spark.createDataFrame(rows, "lang string, text string").withColumn("key", F.lit("mine")).withColumn("n", F.lit(3)).repartition(4)
    assert mined(frame) == plain(rows)
    assert mined(frame.limit(0)) == []
    assert mined(frame, top=2) == plain(rows, top=2)
    odd = [r for r in mined(frame) if r[0] == "und"]
    assert odd and all(r[6] == 40 * 7 + 2 * 3 for r in odd)
