"""What tokens, cells and rows look like, as column expressions.

The word lists and patterns below are fixed values that define the classes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that head a column; words of a totals row; words of a medicine row.
HEAD_WORDS = r"(?i)\b(?:S\.?|SR\.?|NO\.?|QTY\.?|QUANTITY|MFG\.?|PRODUCT|PARTICULARS|DESCRIPTION|BATCH|EXP|EXPIRY|HSN|MRP|RATE|AMOUNT|VALUE|T\.?D%?|DISC\.?%?|GST%?|TAX%?|FREE|PACK|UOM|UNIT)\b"
FOOT_WORDS = r"(?i)\b(?:TOTAL|GRAND|SUB\s*TOTAL|NET\s+AMT|NET\s+AMOUNT|NET\s+PAYABLE|DISCOUNT|ROUND\s*OFF|ROUNDOFF|PAYABLE|CR/?DR|NOTE|BILL\s+AMOUNT|RUPEES?\b.*\bONLY)\b"
MEDICINE_WORDS = r"\b(?:TABS?|CAPS?|INJ|MG|ML|TABLETS?|CAPSULES?|SYRUPS?|OINTS?|\d+'S)\b"
#: Words by which a row of upper-case text gets its role. What a word may begin with is looked at first, which leaves most places of a text untried.
ROLE_HEAD = r"(?=[PIBEHMRQAVT])\b(?:PRODUCT|ITEM|BATCH|EXP|HSN|MRP|RATE|QTY|AMOUNT|VALUE|T\.?D%?)\b"
ROLE_FOOT = r"(?=[SGTRDLCNA])\b(?:SUB\s*TOTAL|SUBTOTAL|GRAND\s*TOTAL|TOTAL|ROUND\s*OFF|ROUNDOFF|DISCOUNT|LESS\s+TD|TRADE\s+DISCOUNT|LESS\s+TRADE\s+DISCOUNT|CR\s*/?\s*DR|CR\s+NOTE|DR\s+NOTE|NET\s*(?:AMT|AMOUNT|PAYABLE)?|AMOUNT\s+IN\s+WORDS)\b|(?=[RI])(?:\b(?:RS\.?|RUPEES|INR)\b.*\b(?:ONLY|PAISE)\b)"
ROLE_TAX = r"(?=[CSIGT])\b(?:CGST|SGST|IGST|GST|CESS|TAXABLE|TAX)\b"
ROLE_METADATA = r"(?=[GIDTCAP])\b(?:GSTIN|GST\s+NO|INVOICE\s+NO|D\.?L\.?\s*NO|TRANSPORT|TERMS|CONDITIONS|ADDRESS|PHONE)\b"
ROLE_QUANTITY = r"(?=\d)\b\d+(?:\.\d+)?(?:\+\d+(?:\.\d+)?)?\s*(?:S|PCS?|STRIPS?|TAB|CAP|ML|MG)?\b"
ROLE_BATCH = r"\b(?=[A-Z0-9-]{5,20}\b)(?=[A-Z0-9-]*[A-Z])(?=[A-Z0-9-]*\d)[A-Z0-9-]+\b"
PRODUCT_MARKS = r"(?i)\b(?:TABS?|CAPS?|INJ|SYP|SYRUP|SUSP|DROPS?|CREAM|OINT|GEL|LOTION|SOLUTION|SOAP|ML|MG|GM|MCG|DT|XR|SR|MR)\b"
#: Error messages: (type, action, parts of a message), in the order in which they are tried.
ERRORS = (
    ("TRANSIENT", "reduce_batch_size", ("cuda out of memory", "out of memory", "gpu memory")),
    ("TRANSIENT", "retry_with_timeout", ("timeout", "timed out", "connection timeout")),
    ("TRANSIENT", "retry_with_timeout", ("temporarily unavailable", "connection reset")),
    ("RECOVERABLE", "use_heuristic_tsr", ("ppstructure returned 0 cells", "pp-structure returned 0 cells", "ppstructure 0 cells")),
    ("RECOVERABLE", "use_heuristic_tsr", ("tsr returned 0 cells", "0 cells", "zero cells")),
    ("RECOVERABLE", "upscale_and_retry", ("ocr confidence too low", "low ocr confidence")),
    ("RECOVERABLE", "use_graph_fallback", ("token mapping failed", "token coverage failure", "token coverage failed")),
    ("RECOVERABLE", "use_graph_fallback", ("topology validation failed",)),
    ("RECOVERABLE", "continue_with_unknown_semantics", ("semantic classification failed",)),
    ("FATAL", "reject_image", ("invalid file format", "cannot identify image file", "image corrupted", "corrupted image", "unsupported image")),
    ("FATAL", "reject_image", ("validation failed", "missing required input", "permission denied")),
)


def compact(text: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), r"\s+", "")


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once."""
    return F.transform(F.array(value), then)[0]


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def is_number(text: Column) -> Column:
    """Whether a whole text is an integer or a number with grouping and two decimals."""
    return text.rlike(r"^(?:[\d,]+\.\d{2}|\d+)$")


def is_numeric_like(text: Column) -> Column:
    """A decimal, a percentage or an integer, without blanks and currency."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), r"[ ₹$]|RS", "")
    return clean.rlike(r"\d+[\d,]*\.\d+") | (F.contains(clean, F.lit("%")) & clean.rlike(r"\d")) | F.regexp_replace(clean, "[,.]", "").rlike(r"^\d+$")


def token_flags(text: Column) -> dict[str, Column]:
    c = compact(text)
    return {"is_decimal": c.rlike(r"^[₹$]?\d[\d,]*\.\d+%?$"), "is_date": c.rlike(r"^\d{1,2}[/-]\d{2,4}$"), "is_batch": c.rlike(r"[A-Z]\d|\d[A-Z]"), "is_hsn": c.rlike(r"^\d{6,8}$")}


def token_features(text: Column, c: Column | None = None) -> dict[str, Column]:
    """What a token may be, and its shares of letters and digits (4 decimals); c is compact(text), where it is at hand."""
    c = compact(text) if c is None else c
    solid = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", "")
    size = F.greatest(F.length(solid), F.lit(1))
    expiry = c.rlike(r"^\d{1,2}[/-]\d{2,4}$")
    return {
        "alpha": F.when(text.rlike(r"\p{L}"), F.round(F.length(F.regexp_replace(solid, r"[^\p{L}]", "")) / size, 4)).otherwise(0.0), "digit": F.round(F.length(F.regexp_replace(solid, r"[^\d]", "")) / size, 4),
        "is_money": c.rlike(r"^[₹$]?\d[\d,]*\.\d{1,3}%?$"), "is_integer": c.rlike(r"^\d+$"), "is_qty": c.rlike(r"^\d+(?:[+*xX]\d+|\.\d+)?$") & (F.length(c) <= 5),
        "is_expiry": expiry, "is_hsn": c.rlike(r"^\d{6,8}$"), "is_batch": c.rlike(r"^[A-Z0-9-]{5,16}$") & c.rlike("[A-Z]") & c.rlike(r"\d") & ~expiry,
    }


def feature_vote(f: dict[str, Column]) -> Column:
    """The first feature that holds, in order of strength."""
    return F.when(f["is_expiry"], "expiry").when(f["is_batch"], "batch").when(f["is_hsn"], "hsn").when(f["is_money"], "money").when(f["is_qty"] | f["is_integer"], "qty").when(f["alpha"] > 0.55, "text")


def token_vote(text: Column) -> Column:
    """feature_vote() of a text."""
    return bound(compact(text), lambda c: feature_vote(token_features(text, c)))


def anchor_x(vote: Column, center_x: Column, max_x: Column) -> Column:
    return F.when(vote.isin("money", "qty"), max_x).otherwise(center_x)


def row_class(text: Column) -> Column:
    """Class of a visual row by its upper-case text."""
    up = F.upper(text)
    price, date, hsn = up.rlike(r"\b\d+\.\d{2}\b"), up.rlike(r"\b\d{2}[-/]\d{2,4}\b"), up.rlike(r"\b\d{4,8}\b")
    foot = up.rlike(FOOT_WORDS)
    totals = F.contains(up, F.lit("TOTAL")) | (F.contains(up, F.lit("AMOUNT")) & foot) | F.contains(up, F.lit("TAX")) | (F.contains(up, F.lit("GST")) & foot)
    return (
        F.when((count(up, HEAD_WORDS) >= 3) & ~foot, "Column Header").when(totals, "Totals").when(up.rlike(MEDICINE_WORDS) | (price & (hsn | date)), "Medicine Table Row")
        .when(up.rlike("INVOICE|DATE|PARTY"), "Header").otherwise("Unknown")
    )


#: A sum of money, and two words of three letters or more, in a row's text.
ROLE_MONEY, TWO_WORDS = r"\b\d+[\d,]*[.,]\d{2}\b", r"[A-Za-z]{3}[A-Za-z]*+[^A-Za-z](?s:.*?)[A-Za-z]{3}"


def right_heavy(text: Column, money: Column, alpha: Column, populated: Column, x_share: Column, y_share: Column) -> Column:
    """A sparse row of sums at the right and bottom of its table."""
    return (populated <= 4) & (x_share >= 0.45) & (y_share >= 0.55) & (money >= 2) & (alpha < 3) & ~text.rlike(PRODUCT_MARKS)


def row_role(text: Column, populated: Column, x_share: Column, y_share: Column, up: Column | None = None) -> Column:
    """Role of a table row by its text, its populated cells and where it begins and lies in its table; up is the upper-case text, where a column holds it.

    Patterns are tried in the order in which most rows are told; numbers are only counted in rows that need their count.
    """
    if up is None:
        return bound(F.upper(text), lambda up: row_role(text, populated, x_share, y_share, up))
    money, alpha = count(text, ROLE_MONEY), count(text, "[A-Za-z]{3,}")
    priced = text.rlike(ROLE_MONEY)
    # a sum is one sign, so that an item needs one of the others
    sign = up.rlike(ROLE_QUANTITY) | up.rlike(r"(?=\d)\b\d{6,8}\b") | up.rlike(r"(?=\d)\b\d{1,2}[/-]\d{2,4}\b") | up.rlike(ROLE_BATCH) | up.rlike(ROLE_TAX)
    return (
        F.when(up.rlike(ROLE_FOOT) | right_heavy(text, money, alpha, populated, x_share, y_share), "footer_summary_row")
        .when(priced & text.rlike(TWO_WORDS) & sign, "item_row").when((populated >= 3) & ~priced & (count(up, ROLE_HEAD) >= 2), "header_row")
        .when(up.rlike(ROLE_TAX), "tax_summary_row").when(up.rlike(ROLE_METADATA) & (money < 2), "metadata_row")
        .when(priced & (alpha >= 1), "item_row").when((populated >= 3) & (money >= 2), "item_row").otherwise("unknown_row")
    )


def error_class(message: Column) -> Column:
    """Type and action of an error message, as a struct (type, action, retryable)."""
    low = F.lower(F.coalesce(message, F.lit("")))
    kind, action = F.lit("FATAL"), F.lit("unknown_error")
    for t, a, parts in reversed(ERRORS):
        hit = low.rlike("|".join(parts))
        kind, action = F.when(hit, t).otherwise(kind), F.when(hit, a).otherwise(action)
    return F.struct(kind.alias("type"), action.alias("action"), (kind == "TRANSIENT").alias("retryable"))


def gate(confidence: Column) -> Column:
    return F.when(confidence >= 0.75, "accept").when(confidence >= 0.45, "repair_candidate").otherwise("quarantine")
