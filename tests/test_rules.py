"""Vectors of single rules."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from apchecks.functions import keys, numbers
from apchecks.operators import classify, ingest, matching, validate


def one(spark, column, **values):
    """The value of a column expression over one row."""
    literals = [(F.lit(v) if not isinstance(v, tuple) else F.lit(v[0]).cast(v[1])).alias(k) for k, v in values.items()] or [F.lit(1).alias("x")]
    return spark.range(1).select(*literals).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("text,key", [("INV-1043", "INV1043"), ("inv 1043", "INV1043"), (" #1043 ", "1043"), ("Ré-12", "RÉ12"), ("---", ""), (None, "")])
def test_number_key(spark, text, key):
    assert one(spark, keys.number_key("t"), t=(text, "string")) == key


@pytest.mark.parametrize("key,canonical", [("INV0043", "INV43"), ("000", "0"), ("A00B007", "A0B7"), ("100", "100")])
def test_canonical_key(spark, key, canonical):
    assert one(spark, keys.canonical_key("t"), t=key) == canonical


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


@pytest.mark.parametrize("a,b", [("INV1043", "INV1034"), ("", "A"), ("", ""), ("ABC", "ABC"), ("12345", "54321"), ("X", "Y")])
def test_ratio(spark, a, b):
    expected = 100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b))
    assert one(spark, keys.ratio_200("a", "b"), a=a, b=b) == pytest.approx(expected)


@pytest.mark.parametrize(
    "text,limit,value,error",
    [
        ("1,234.56", 2, "1234.56", None), ("1.234,56", 2, "1234.56", None), ("1 234,56", 2, "1234.56", None), ("12,5", None, "12.5", None),
        ("0,500", None, "0.5", None), ("1.200", None, None, "AMBIGUOUS"), ("1,200", 2, "1200", None), ("1.200", 2, None, "AMBIGUOUS"),
        ("12,34,567", None, None, "NOT_A_NUMBER"), ("01.5", None, None, "NOT_A_NUMBER"), ("-7", None, "-7", None), ("", None, None, "NOT_A_NUMBER"),
        ("1.234", 0, None, "AMBIGUOUS"), ("1.23", 0, None, "TOO_PRECISE"), ("1,234,567", 2, "1234567", None), (None, None, None, "NOT_A_NUMBER"),
    ],
)
def test_parse_number(spark, text, limit, value, error):
    r = one(spark, numbers.parse_number(F.col("t"), limit), t=(text, "string"))
    assert r["error"] == error
    assert r["value"] == (None if value is None else Decimal(value))


@pytest.mark.parametrize(
    "text,currency,minor,error",
    [
        ("$1,105.92", "USD", 110592, None), ("7.620,05 EUR", "EUR", 762005, None), ("(12.00)", "USD", -1200, None), ("€5", "USD", None, "OTHER_CURRENCY"),
        ("5 GBP", "USD", None, "OTHER_CURRENCY"), ("100", "JPY", 100, None), ("1.5", "JPY", None, "TOO_PRECISE"), ("5", "XXX", None, "UNSUPPORTED_CURRENCY"),
    ],
)
def test_parse_money(spark, text, currency, minor, error):
    r = one(spark, numbers.parse_money(F.col("t"), F.col("c")), t=text, c=currency)
    assert (r["value"], r["error"]) == (minor, error)


@pytest.mark.parametrize(
    "text,hint,value,error",
    [
        ("2026-03-13", None, "2026-03-13", None), ("13/03/2026", None, "2026-03-13", None), ("03/13/2026", None, "2026-03-13", None), ("03/04/2026", None, None, "AMBIGUOUS"),
        ("03/04/2026", True, "2026-04-03", None), ("03/04/2026", False, "2026-03-04", None), ("07.06.2026", None, "2026-06-07", None), ("5/5/2026", None, "2026-05-05", None),
        ("13 Mar 2026", None, "2026-03-13", None), ("March 13, 2026", None, "2026-03-13", None), ("31.02.2026", None, None, "NOT_REAL"), ("13/03/26", None, None, "NOT_A_DATE"),
        ("13 Foo 2026", None, None, "NOT_A_DATE"), (None, None, None, "NOT_A_DATE"),
    ],
)
def test_parse_date(spark, text, hint, value, error):
    r = one(spark, numbers.parse_date(F.col("t"), hint), t=(text, "string"))
    assert (None if r["value"] is None else r["value"].isoformat(), r["error"]) == (value, error)


@pytest.mark.parametrize("base,bp,tax", [(102400, 800, 8192), (5, 1000, 1), (-5, 1000, -1), (0, 800, 0), (15, 1000, 2)])
def test_tax_of(spark, base, bp, tax):
    assert one(spark, validate.tax_of(F.col("b"), F.col("r")), b=base, r=bp) == tax


@pytest.mark.parametrize(
    "own,text,rule,master,expected",
    [("high", True, True, True, "1.0000"), ("high", None, None, None, "0.7500"), ("medium", True, None, None, "0.7000"), ("low", True, False, True, "0.4000"), (None, True, True, True, "0.0000")],
)
def test_score_field(spark, own, text, rule, master, expected):
    score = numbers.score_field(F.col("o"), F.col("t"), F.col("r"), F.col("m"))
    assert one(spark, score, o=(own, "string"), t=(text, "boolean"), r=(rule, "boolean"), m=(master, "boolean")) == Decimal(expected)


@pytest.mark.parametrize("name,safe", [("a/b\\c<d>.pdf", "cd.pdf"), ("...", "upload"), ("x" * 300, "x" * 200), ("", "upload")])
def test_safe_name(spark, name, safe):
    assert one(spark, ingest.safe_name(F.col("n")), n=name) == safe


@pytest.mark.parametrize("head,mime", [(b"%PDF-1.4", "application/pdf"), (b"\xff\xd8\xff\xe0", "image/jpeg"), (b"II*\0", "image/tiff"), (b"GIF89a", None), (b"", None)])
def test_detect_mime(spark, head, mime):
    assert one(spark, ingest.detect_mime(F.col("c")), c=bytearray(head)) == mime


def _orders(spark):
    return spark.createDataFrame([("t", 1, "PO-7", 9, "USD", 1000, "open")], "tenant_id string, po_id long, po_number string, supplier_id long, currency string, total_minor long, status string")


_INVOICE = "tenant_id string, invoice_id long, supplier_id long, currency string, subtotal_minor long, po_number string, status string, created_at timestamp, matched_po_id long"


def test_earlier_billing_counts_in_received_order(spark):
    from datetime import datetime

    rows = [("t", i, 9, "USD", 600, "PO-7", status, datetime(2026, 1, day), 1) for i, day, status in ((3, 1, "checking"), (2, 2, "failed"), (1, 3, "checking"))]
    for order in (rows, rows[::-1]):
        got = {r["invoice_id"]: (r["outcome"], r["over_minor"]) for r in matching.check_overbilled(spark.createDataFrame(order, _INVOICE), _orders(spark)).collect()}
        assert got == {3: ("pass", -400), 2: ("fail", 200), 1: ("fail", 200)}


def test_unknown_earlier_billing_is_no_pass(spark):
    from datetime import datetime

    rows = [("t", 1, 9, None, 100, "PO-7", "checking", datetime(2026, 1, 1), 1), ("t", 2, 9, "USD", 100, "PO-7", "checking", datetime(2026, 1, 2), 1)]
    got = {r["invoice_id"]: (r["outcome"], r["reason"]) for r in matching.check_overbilled(spark.createDataFrame(rows, _INVOICE), _orders(spark)).collect()}
    assert got == {1: ("skipped", "CURRENCY_UNKNOWN"), 2: ("skipped", "EARLIER_BILLING_UNKNOWN")}


def test_skips_that_repeat_another_exception_are_dropped(spark):
    rows = [(1, "UNKNOWN_SUPPLIER", "fail", None), (1, "CURRENCY_MISMATCH", "skipped", "UNKNOWN_SUPPLIER"), (1, "TAX_MISMATCH", "skipped", "MISSING_AMOUNTS"), (2, "CURRENCY_MISMATCH", "skipped", "UNKNOWN_SUPPLIER"), (2, "LINE_MATH_MISMATCH", "pass", None)]
    got = {(r["invoice_id"], r["code"], r["severity"]) for r in classify.exceptions(spark.createDataFrame(rows, "invoice_id long, check_code string, outcome string, reason string")).collect()}
    assert got == {(1, "UNKNOWN_SUPPLIER", "review"), (1, "TAX_MISMATCH", "review"), (2, "CURRENCY_MISMATCH", "review")}
