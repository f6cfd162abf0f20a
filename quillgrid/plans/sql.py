"""DuckDB SQL for the derived pages of sources.derived, as common table expressions."""

LINES = """lines AS (
  SELECT doc_id, ord, part, supplier, p_name || ' ' || (['TAB', 'SYP', 'INJ', 'CAP'])[CAST(part % 4 AS INTEGER) + 1] AS product, qty, gross, disc, tax,
         (gross + qty // 2) // qty AS rate, (gross * (100 - disc) + 50) // 100 AS amount,
         'B' || lpad(CAST(supplier AS VARCHAR), 5, '0') AS batch, strftime(l_shipdate, '%m/%y') AS expiry, CAST(30040000 + part % 1000 AS VARCHAR) AS hsn
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY l_linenumber, part, supplier, gross, qty, disc, tax, l_shipdate) AS INTEGER) AS ord
        FROM (SELECT l_orderkey AS doc_id, l_linenumber, l_partkey AS part, l_suppkey AS supplier, l_shipdate, CAST(round(l_extendedprice * 100) AS BIGINT) AS gross,
                     CAST(round(l_quantity) AS BIGINT) AS qty, CAST(round(l_discount * 100) AS BIGINT) AS disc, CAST(round(l_tax * 100) AS BIGINT) AS tax FROM lineitem))
  JOIN part ON part = p_partkey)"""

FOOTERS = """sums AS (SELECT doc_id, max(ord) AS n, sum(amount)::BIGINT AS sub, sum((amount * tax + 100) // 200)::BIGINT AS half FROM lines GROUP BY doc_id),
footers AS (
  SELECT doc_id, CAST(n + 1 + k AS INTEGER) AS row_no, (['SUB TOTAL', 'SGST', 'CGST', 'GRAND TOTAL'])[k + 1] AS label, ([sub, half, half, sub + 2 * half])[k + 1] AS value
  FROM sums, (SELECT CAST(range AS INTEGER) AS k FROM range(4)))"""

TOKENS = """money AS (SELECT *, CAST(amount // 100 AS VARCHAR) || '.' || lpad(CAST(amount % 100 AS VARCHAR), 2, '0') AS amount_text,
                             CAST(rate // 100 AS VARCHAR) || '.' || lpad(CAST(rate % 100 AS VARCHAR), 2, '0') AS rate_text FROM lines),
eight AS (SELECT CAST(range AS INTEGER) AS c FROM range(8)),
written AS (
  SELECT doc_id, ord AS row_no, c AS col_no,
         CASE c WHEN 0 THEN product WHEN 1 THEN batch WHEN 2 THEN expiry WHEN 3 THEN hsn
                WHEN 4 THEN CASE part % 10 WHEN 0 THEN CAST(qty AS VARCHAR) || '+1' WHEN 1 THEN '1*10 ' || CAST(qty AS VARCHAR) ELSE CAST(qty AS VARCHAR) END
                WHEN 5 THEN rate_text WHEN 6 THEN CAST(disc AS VARCHAR) || '.00'
                ELSE CASE WHEN part % 17 = 0 THEN replace(amount_text, '.', ',') ELSE amount_text END END AS text,
         (part * 31 + c) % 3 - 1 AS jitter FROM money, eight
  UNION ALL SELECT doc_id, 0, c, (['PRODUCT', 'BATCH', 'EXP', 'HSN', 'QTY', 'RATE', 'DISC', 'AMOUNT'])[c + 1], 0 FROM lines, eight WHERE ord = 1
  UNION ALL SELECT doc_id, row_no, 5, label, 0 FROM footers
  UNION ALL SELECT doc_id, row_no, 7, CAST(value // 100 AS VARCHAR) || '.' || lpad(CAST(value % 100 AS VARCHAR), 2, '0'), 0 FROM footers),
tokens AS (
  SELECT doc_id, row_no, col_no, CAST(row_no * 8 + col_no AS BIGINT) AS ord, text, CAST(x AS BIGINT) AS min_x, CAST(x + 7 * length(text) AS BIGINT) AS max_x, CAST(y AS BIGINT) AS min_y, CAST(y + 14 AS BIGINT) AS max_y
  FROM (SELECT *, CASE WHEN col_no >= 4 THEN ([252, 332, 392, 472, 532, 612, 692, 792])[col_no + 1] - 7 * length(text) ELSE ([40, 260, 340, 400, 480, 540, 620, 700])[col_no + 1] END AS x,
               106 + 24 * row_no + jitter AS y FROM written))"""

ROWS = """visual AS (SELECT doc_id, row_no, string_agg(text, ' ' ORDER BY min_x, ord) AS text, count(*) AS n_tokens, min(min_x) AS min_x, max(max_x) AS max_x, min(min_y) AS min_y, max(max_y) AS max_y FROM tokens GROUP BY doc_id, row_no)"""


def with_lines(body: str) -> str:
    return f"WITH {LINES} {body}"


def with_footers(body: str) -> str:
    return f"WITH {LINES},\n{FOOTERS} {body}"


def with_tokens(body: str, *more: str) -> str:
    return "WITH " + ",\n".join((LINES, FOOTERS, TOKENS, *more)) + f"\n{body}"
