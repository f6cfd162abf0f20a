"""The vote for a page's header line, on small pages."""

from quillgrid.operators import headers

SCHEMA = "doc_id bigint, ord bigint, text string, min_x bigint, max_x bigint, min_y bigint, max_y bigint"


def test_two_lines_make_one_header_and_strays_none(spark):
    words = [("Qty.", 400, 440, 100), ("Item Description", 150, 250, 112), ("NET AMT", 700, 760, 100), ("QTY", 10, 30, 300), (None, 0, 900, 50)]
    rows = [(1, i, t, a, b, y - 5, y + 5) for i, (t, a, b, y) in enumerate(words)] + [(2, 0, "alone", 0, 100, 20, 40), (2, 1, "below", 0, 50, 60, 70)]
    lines = {r.doc_id: r for r in headers.header_line(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (lines[1].qty, lines[1].description, lines[1].net_amt, lines[1].header_y) == (420.0, 200.0, 730.0, 104.0)
    assert lines[2].header_y == 30.0 and lines[2].qty is None
    bands = {(r.doc_id, r.band): (r.min_x, r.max_x) for r in headers.column_bands(headers.header_line(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert len(bands) == 26 and bands[1, "qty"] == (402.0, 442.0) and bands[2, "qty"] == (390.0, 430.0) and bands[2, "net_amt"] == (696.0, 108.0)


def test_roles_and_empty_pages(spark):
    want = {"P CODE": "pcode", "HSN/SAC": "hsn", "M.R.P": "mrp", "Gross Amt": "gross", "CGST %": "cgst", "Unhsn": None, None: None}
    texts = spark.createDataFrame([(t,) for t in want], "text string")
    assert {r.text: r.role for r in texts.withColumn("role", headers.header_role(texts.text)).collect()} == want
    assert headers.column_bands(headers.header_line(spark.createDataFrame([], SCHEMA))).collect() == []
