"""Sentences for failed checks, with their numbers, from fixed templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentence templates of failed checks; %s are filled in order.
TEMPLATES = {
    "TOTAL_MISMATCH": "The subtotal plus tax comes to %s, but the invoice total is %s.",
    "TAX_MISMATCH": "Tax is %s, but %s is %s.",
    "PRICE_VARIANCE": "Line %s is billed at %s per unit, but the PO says %s (%s, limit %s).",
    "PO_OVERBILLED": "Invoices against %s now total %s, which is more than the PO total of %s.",
}


def money(minor: Column, currency: Column) -> Column:
    """An amount with its currency and grouped digits; without a currency two decimals are shown."""
    sign = F.when(minor < 0, "-").otherwise("")
    size = F.abs(minor)
    whole = F.format_number(F.floor(size / 100).cast("long"), 0)
    cents = F.lpad((size % 100).cast("string"), 2, "0")
    plain = F.concat(sign, whole, F.lit("."), cents)
    return F.when(currency == "JPY", F.concat(F.lit("JPY "), sign, F.format_number(size, 0))).when(currency.isNotNull(), F.concat(currency, F.lit(" "), plain)).otherwise(plain)


def basis_points(bp: Column) -> Column:
    """1250 as "12.5%", without trailing zeros."""
    text = (bp.cast("decimal(12,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(12,2)").cast("string")
    return F.concat(F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", ""), F.lit("%"))


def signed_percent(actual: Column, expected: Column) -> Column:
    """The difference in tenths of a percent, half away from zero."""
    d = F.round((actual - expected).cast("decimal(18,0)") * 100 / expected.cast("decimal(18,0)"), 1).cast("decimal(18,1)")
    return F.when(expected == 0, "no percentage, the PO price is zero").otherwise(F.concat(F.when(d > 0, "+").otherwise(""), d.cast("string"), F.lit("%")))


def total_mismatch(totals: DataFrame) -> DataFrame:
    """``totals`` holds invoice_id, currency, expected_minor, actual_minor and total_bad."""
    text = F.format_string(TEMPLATES["TOTAL_MISMATCH"], money(F.col("expected_minor"), F.col("currency")), money(F.col("actual_minor"), F.col("currency")))
    return totals.filter("total_bad").select("invoice_id", text.alias("sentence"))


def tax_mismatch(taxes: DataFrame) -> DataFrame:
    """``taxes`` holds invoice_id, currency, outcome, source, rate_bp, subtotal_minor, expected_minor, actual_minor."""
    cur = F.col("currency")
    basis = F.when(F.col("source") == "supplier", F.concat(basis_points(F.col("rate_bp")), F.lit(" of "), money(F.col("subtotal_minor"), cur))).otherwise("the tax on each line")
    text = F.format_string(TEMPLATES["TAX_MISMATCH"], money(F.col("actual_minor"), cur), basis, money(F.col("expected_minor"), cur))
    return taxes.filter("outcome = 'fail'").select("invoice_id", text.alias("sentence"))


def price_variance(prices: DataFrame, limit_bp: int = 200) -> DataFrame:
    """One sentence per invoice over all its lines, in line order. ``prices`` is `matching.check_price` with currency."""
    cur = F.col("currency")
    variance = signed_percent(F.col("unit_price_minor"), F.col("po_unit_price_minor"))
    text = F.format_string(
        TEMPLATES["PRICE_VARIANCE"], F.col("line_no").cast("string"), money(F.col("unit_price_minor"), cur), money(F.col("po_unit_price_minor"), cur), variance, basis_points(F.lit(limit_bp))
    )
    per = prices.filter("outcome = 'fail'").groupBy("invoice_id").agg(F.array_sort(F.collect_list(F.struct("line_no", text.alias("t")))).alias("s"))
    return per.select("invoice_id", F.array_join(F.transform("s", lambda x: x["t"]), " ").alias("sentence"))


def overbilled(bills: DataFrame) -> DataFrame:
    """``bills`` is `matching.check_overbilled` with po_number, currency and po_total_minor."""
    cur = F.col("currency")
    text = F.format_string(TEMPLATES["PO_OVERBILLED"], F.col("po_number"), money(F.col("billed_before_minor") + F.col("billed_minor"), cur), money(F.col("po_total_minor"), cur))
    return bills.filter("outcome = 'fail'").select("invoice_id", text.alias("sentence"))
