"""The seven validation checks. Every check gives one row per invoice: pass, fail or skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import name_key, tax_key

PASS, FAIL, SKIPPED = "pass", "fail", "skipped"
# Currencies that a symbol stands for.
SYMBOL_CURRENCY = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY"}

KEYS = ["tenant_id", "invoice_id"]


def tax_of(base: Column, rate_bp: Column) -> Column:
    """Tax on an amount at a rate in basis points, half a unit rounded away from zero."""
    return F.round(base.cast("decimal(38,0)") * rate_bp.cast("decimal(10,0)") / F.lit(10000).cast("decimal(10,0)"), 0).cast("long")


def line_amount(qty: Column, unit_minor: Column) -> Column:
    """Quantity times unit price, half a unit rounded away from zero."""
    return F.round(qty * unit_minor.cast("decimal(18,0)"), 0).cast("long")


def line_rollup(lines: DataFrame, line_tolerance: int = 1) -> DataFrame:
    """One row per invoice with lines: counts, sums and what could not be read. One shuffle."""
    expected = line_amount(F.col("qty"), F.col("unit_price_minor"))
    readable = F.col("qty").isNotNull() & F.col("unit_price_minor").isNotNull() & F.col("amount_minor").isNotNull()
    wrong = readable & (F.abs(expected - F.col("amount_minor")) > line_tolerance)
    line_tax = F.round(F.col("amount_minor").cast("decimal(18,0)") * F.col("tax_rate") / 100, 0).cast("long")
    return lines.groupBy(*KEYS).agg(
        F.count("*").alias("n_lines"),
        F.count_if(readable).alias("checked"),
        F.count_if(~readable).alias("unchecked"),
        F.count_if(wrong).alias("wrong"),
        F.array_sort(F.collect_list(F.when(wrong, F.struct("line_no", expected.alias("expected_minor"), "amount_minor")))).alias("wrong_lines"),
        F.sum("amount_minor").alias("lines_sum_minor"),
        F.count_if(F.col("amount_minor").isNull()).alias("amounts_missing"),
        F.count_if(F.col("tax_rate").isNull() | F.col("amount_minor").isNull()).alias("taxes_missing"),
        F.sum(line_tax).alias("lines_tax_minor"),
    )


def _when(*rules: tuple[Column, str], otherwise: str) -> Column:
    """The first rule that holds; a null condition doesn't hold."""
    out = F.lit(otherwise)
    for condition, value in reversed(rules):
        out = F.when(F.coalesce(condition, F.lit(False)), value).otherwise(out)
    return out


def with_lines(invoices: DataFrame, lines: DataFrame, line_tolerance: int = 1) -> DataFrame:
    zero = {c: 0 for c in ("n_lines", "checked", "unchecked", "wrong", "amounts_missing", "taxes_missing")}
    return invoices.join(line_rollup(lines, line_tolerance), KEYS, "left").fillna(zero)


def line_math_outcome() -> Column:
    return _when((F.col("wrong") > 0, FAIL), ((F.col("checked") > 0) & (F.col("unchecked") == 0), PASS), otherwise=SKIPPED)


def check_line_math(facts: DataFrame) -> DataFrame:
    return facts.select(*KEYS, line_math_outcome().alias("outcome"), "checked", "unchecked", "wrong")


def totals_rule(line_tolerance: int = 1, total_tolerance: int = 1) -> tuple[Column, Column, Column, Column]:
    """Outcome, whether lines or total disagree, and the expected total; only a compared total passes."""
    lines_read = F.col("subtotal_minor").isNotNull() & (F.col("n_lines") > 0) & (F.col("amounts_missing") == 0)
    lines_bad = lines_read & (F.abs(F.col("lines_sum_minor") - F.col("subtotal_minor")) > F.col("n_lines") * line_tolerance)
    expected = F.col("subtotal_minor") + F.col("tax_minor")
    compared = expected.isNotNull() & F.col("total_minor").isNotNull()
    total_bad = compared & (F.abs(expected - F.col("total_minor")) > total_tolerance)
    outcome = _when((lines_bad, FAIL), (total_bad, FAIL), (compared, PASS), otherwise=SKIPPED)
    return outcome, lines_bad, total_bad, expected


def check_totals(facts: DataFrame, line_tolerance: int = 1, total_tolerance: int = 1) -> DataFrame:
    """Lines against the subtotal, and subtotal plus tax against the total."""
    outcome, lines_bad, total_bad, expected = totals_rule(line_tolerance, total_tolerance)
    return facts.select(
        *KEYS, outcome.alias("outcome"), F.coalesce(lines_bad, F.lit(False)).alias("lines_bad"),
        F.coalesce(total_bad, F.lit(False)).alias("total_bad"), expected.alias("expected_minor"), F.col("total_minor").alias("actual_minor"),
    )


def tax_rule(per_line: int = 1) -> tuple[Column, Column, Column, Column]:
    """Outcome, reason, source and expected tax: by the supplier's rate, else by the lines' own rates."""
    by_supplier = F.col("s_tax_rate_bp").isNotNull()
    by_lines = (F.col("n_lines") > 0) & (F.col("taxes_missing") == 0)
    expected = F.when(by_supplier, tax_of(F.col("subtotal_minor"), F.col("s_tax_rate_bp"))).when(by_lines, F.col("lines_tax_minor"))
    tolerance = F.when(by_supplier, F.lit(per_line)).otherwise(F.col("n_lines") * per_line)
    unread = F.col("subtotal_minor").isNull() | F.col("tax_minor").isNull()
    reason = F.when(unread, "MISSING_AMOUNTS").when(~by_supplier & ~by_lines, "NO_RATE_TO_COMPARE")
    outcome = _when((reason.isNotNull(), SKIPPED), (F.abs(expected - F.col("tax_minor")) <= tolerance, PASS), otherwise=FAIL)
    source = F.when(reason.isNull(), F.when(by_supplier, "supplier").otherwise("lines"))
    return outcome, reason, source, F.when(reason.isNull(), expected)


def check_tax(facts: DataFrame, per_line: int = 1) -> DataFrame:
    """The tax amount; ``facts`` holds s_tax_rate_bp."""
    outcome, reason, source, expected = tax_rule(per_line)
    return facts.select(
        *KEYS, outcome.alias("outcome"), reason.alias("reason"), source.alias("source"), expected.alias("expected_minor"), F.col("tax_minor").alias("actual_minor"),
    )


def dates_rule(today: str, max_age_days: int = 365, future_days: int = 0) -> tuple[Column, Column]:
    """Outcome, and all reasons."""
    now, day = F.lit(today).cast("date"), F.col("invoice_date")
    reasons = F.array_compact(
        F.array(
            F.when(day > F.date_add(now, future_days), "FUTURE_INVOICE_DATE"),
            F.when(F.datediff(now, day) > max_age_days, "INVOICE_TOO_OLD"),
            F.when(F.col("due_date") < day, "DUE_BEFORE_INVOICE"),
        )
    )
    outcome = _when((day.isNull(), SKIPPED), (F.size(reasons) > 0, FAIL), otherwise=PASS)
    text = F.when(day.isNull(), "NO_INVOICE_DATE").otherwise(F.array_join(reasons, ","))
    return outcome, text


def check_dates(invoices: DataFrame, today: str, max_age_days: int = 365, future_days: int = 0) -> DataFrame:
    outcome, text = dates_rule(today, max_age_days, future_days)
    return invoices.select(*KEYS, outcome.alias("outcome"), text.alias("reasons"))


def currency_outcome() -> Column:
    """Against the supplier's currency; an unsettled symbol or code counts as printed."""
    printed = F.trim(F.coalesce("printed_currency", F.lit("")))
    symbols = F.create_map(*(F.lit(x) for kv in SYMBOL_CURRENCY.items() for x in kv))
    seen = F.coalesce(F.upper("currency"), symbols[printed], F.when(printed.rlike("^[A-Za-z]{3}$"), F.upper(printed)))
    return _when(
        (F.col("s_supplier_id").isNull(), SKIPPED), (seen.isNull(), SKIPPED), (seen == F.upper("s_default_currency"), PASS), otherwise=FAIL
    )


def check_currency(facts: DataFrame) -> DataFrame:
    return facts.select(*KEYS, currency_outcome().alias("outcome"), F.col("currency").alias("invoice_currency"), F.col("s_default_currency").alias("supplier_currency"))


def bank_rule() -> tuple[Column, Column]:
    """Outcome and reason, hash against hash. Nothing printed passes only where that is certain."""
    known, mine, theirs = F.col("s_supplier_id").isNotNull(), F.col("bank_account_hash"), F.col("s_bank_account_hash")
    reason = (
        F.when(~known, "UNKNOWN_SUPPLIER")
        .when(mine.isNull() & ~F.coalesce("bank_absence_certain", F.lit(False)), "BANK_NOT_READ")
        .when(mine.isNotNull() & theirs.isNull(), "NO_BANK_ON_FILE")
    )
    outcome = _when((reason.isNotNull(), SKIPPED), (mine.isNull(), PASS), (mine == theirs, PASS), otherwise=FAIL)
    return outcome, reason


def check_bank(facts: DataFrame) -> DataFrame:
    outcome, reason = bank_rule()
    return facts.select(*KEYS, outcome.alias("outcome"), reason.alias("reason"))


def supplier_outcome() -> Column:
    nothing = (F.trim(F.coalesce("supplier_name", F.lit(""))) == "") & (F.coalesce("supplier_tax_id", F.lit("")) == "")
    return _when((nothing, SKIPPED), (F.col("s_supplier_id").isNotNull(), PASS), otherwise=FAIL)


def check_supplier(resolved: DataFrame) -> DataFrame:
    return resolved.select(*KEYS, supplier_outcome().alias("outcome"), F.col("s_supplier_id").alias("supplier_id"), "matched_by", "conflict")


def resolve_suppliers(invoices: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Link invoices to suppliers by exact tax id and exact name or alias, which must agree.

    Adds s_supplier_id, s_name, s_default_currency, s_tax_rate_bp, s_bank_account_hash, matched_by and
    conflict. Of several suppliers with one key the smallest id counts. Suppliers are joined on keys;
    the optimizer broadcasts them while they are small.
    """
    tenant = "tenant_id"
    by_tax = suppliers.filter(F.col("tax_id").isNotNull()).groupBy(tenant, tax_key("tax_id").alias("k_tax")).agg(F.min("supplier_id").alias("tax_supplier"))
    names = suppliers.select(tenant, "supplier_id", F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array()))).alias("n"))
    by_name = names.withColumn("k_name", name_key("n")).filter("k_name <> ''").groupBy(tenant, "k_name").agg(F.min("supplier_id").alias("name_supplier"))
    i = invoices.withColumns({"k_name": name_key("supplier_name"), "k_tax": tax_key("supplier_tax_id")})
    i = i.join(by_tax, [tenant, "k_tax"], "left").join(by_name, [tenant, "k_name"], "left")
    details = suppliers.select(
        tenant, F.col("supplier_id").alias("candidate"), F.col("name").alias("s_name"), F.col("tax_id").alias("s_tax_id"),
        F.col("default_currency").alias("s_default_currency"), F.col("tax_rate_bp").alias("s_tax_rate_bp"),
        F.col("bank_account_hash").alias("s_bank_account_hash"),
    )
    i = i.withColumn("candidate", F.coalesce("tax_supplier", "name_supplier")).join(details, [tenant, "candidate"], "left")
    tax_differs = F.col("tax_supplier").isNotNull() & (F.col("k_name") != "") & ~F.col("tax_supplier").eqNullSafe(F.col("name_supplier"))
    name_differs = F.col("tax_supplier").isNull() & F.col("name_supplier").isNotNull() & (F.col("k_tax") != "") & F.col("s_tax_id").isNotNull()
    conflict = F.when(tax_differs, "NAME_DIFFERS_FROM_TAX_ID").when(name_differs, "TAX_ID_DIFFERS_FROM_RECORD")
    known = F.col("candidate").isNotNull() & ~tax_differs & ~name_differs
    out = i.withColumns(
        {
            "conflict": conflict,
            "matched_by": F.when(known, F.when(F.col("tax_supplier").isNotNull(), "tax_id").otherwise("name")),
            "s_supplier_id": F.when(known, F.col("candidate")),
            **{c: F.when(known, F.col(c)) for c in ("s_default_currency", "s_tax_rate_bp", "s_bank_account_hash")},
            "closest_name": F.when(~known, F.col("s_name")),
        }
    )
    return out.drop("k_name", "k_tax", "tax_supplier", "name_supplier", "candidate", "s_tax_id")


def all_checks(facts: DataFrame, today: str) -> DataFrame:
    """All seven checks of ``facts`` as one long table (check_code, outcome, reason of a skip).

    ``facts`` stays wide, one row per invoice; the rows of the codes come from one array at the end,
    so there is no join and no shuffle between the checks.
    """
    tax_outcome, tax_reason, _, _ = tax_rule()
    date_outcome, date_reason = dates_rule(today)
    bank_outcome, bank_reason = bank_rule()
    none = F.lit(None).cast("string")
    rules = {
        "LINE_MATH_MISMATCH": (line_math_outcome(), none),
        "TOTAL_MISMATCH": (totals_rule()[0], none),
        "TAX_MISMATCH": (tax_outcome, tax_reason),
        "INVALID_DATE": (date_outcome, date_reason),
        "CURRENCY_MISMATCH": (currency_outcome(), F.when(F.col("s_supplier_id").isNull(), "UNKNOWN_SUPPLIER")),
        "UNKNOWN_SUPPLIER": (supplier_outcome(), F.lit("NOTHING_TO_MATCH")),
        "BANK_DETAILS_CHANGED": (bank_outcome, bank_reason),
    }
    rows = [
        F.struct(F.lit(code).alias("check_code"), outcome.alias("outcome"), F.when(outcome == SKIPPED, reason).alias("reason"))
        for code, (outcome, reason) in rules.items()
    ]
    return facts.select(*KEYS, F.explode(F.array(*rows)).alias("c")).select(*KEYS, "c.*")
