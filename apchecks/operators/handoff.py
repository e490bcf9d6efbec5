"""Approved invoices to draft bills, and contacts of the accounting system."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import name_key
from .validate import line_amount

# Minor digits of the currencies that are supported.
CURRENCY_EXPONENT = {"USD": 2, "EUR": 2, "GBP": 2, "JPY": 0, "AUD": 2, "NZD": 2}


def map_bills(invoices: DataFrame, lines: DataFrame, tax_types: dict[int, str]) -> DataFrame:
    """The draft bill of each invoice or every problem that stops it, in a fixed order without repeats.

    Line facts are rolled up by invoice first; rates without a tax type are never guessed.
    """
    rate_bp = F.when((F.col("tax_rate") * 100) == F.round(F.col("tax_rate") * 100, 0), (F.col("tax_rate") * 100).cast("long"))
    known = F.coalesce(rate_bp.isin(*tax_types), F.lit(False))
    no_text = F.trim(F.coalesce("description", F.lit(""))) == ""
    good = ~no_text & F.col("amount_minor").isNotNull() & known
    line_tax = F.round(F.col("amount_minor").cast("decimal(18,0)") * rate_bp.cast("decimal(10,0)") / 10000, 0).cast("long")
    exact = F.coalesce(line_amount(F.col("qty"), F.col("unit_price_minor")) == F.col("amount_minor"), F.lit(False))
    per = lines.groupBy("invoice_id").agg(
        F.count("*").alias("n_lines"), F.count_if(good).alias("n_good"), F.max(no_text).alias("text_missing"),
        F.max(F.col("amount_minor").isNull()).alias("amount_missing"), F.max(~known).alias("rate_missing"),
        F.sum(F.when(good, F.col("amount_minor"))).alias("lines_sum"), F.sum(F.when(good, line_tax)).alias("tax_sum"),
        F.count_if(good & exact).alias("lines_with_quantity"),
    )
    i = invoices.join(per, "invoice_id", "left")
    n = F.coalesce("n_lines", F.lit(0))
    sub, tax, total = F.col("subtotal_minor"), F.col("tax_minor"), F.col("total_minor")
    have = sub.isNotNull() & tax.isNotNull() & total.isNotNull()
    whole = F.coalesce("n_good", F.lit(0)) == n
    mismatch = have & ((sub + tax != total) | (whole & (F.coalesce("lines_sum", F.lit(0)) != sub)))
    rules: list[tuple[Column, str]] = [
        (F.trim(F.coalesce("invoice_number", F.lit(""))) == "", "INVOICE_NUMBER_MISSING"),
        (F.col("invoice_date").isNull(), "INVOICE_DATE_MISSING"),
        (~F.coalesce(F.col("currency").isin(*CURRENCY_EXPONENT), F.lit(False)), "CURRENCY_UNSUPPORTED"),
        (n == 0, "NO_LINES"),
        (F.col("text_missing"), "LINE_DESCRIPTION_MISSING"),
        (F.col("amount_missing"), "LINE_AMOUNT_MISSING"),
        (F.col("rate_missing"), "TAX_MAPPING_MISSING"),
        (~have, "TOTALS_MISSING"),
        (have & ((total <= 0) | (sub <= 0)), "NOT_A_BILL"),
        (mismatch, "TOTALS_MISMATCH"),
        (have & ~mismatch & whole & (F.coalesce("tax_sum", F.lit(0)) != tax), "TAX_MISMATCH"),
    ]
    problems = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), name) for c, name in rules)))
    ready = F.size(problems) == 0
    return i.select(
        "invoice_id", ready.alias("ready"), F.array_join(problems, ",").alias("problems"),
        F.when(ready, F.col("n_lines")).alias("bill_lines"), F.when(ready, F.col("lines_with_quantity")).alias("lines_with_quantity"),
        F.when(ready, total).alias("total_minor"),
    )


def match_contacts(suppliers: DataFrame, contacts: DataFrame) -> DataFrame:
    """Contacts of suppliers: a stored link, then the tax number, then the exact name; never one of several.

    ``suppliers`` (supplier_id, name, tax_id, linked_contact_id), ``contacts`` (contact_id, name,
    tax_number, active). Candidates of all three routes come from equi-joins and are counted per supplier.
    """
    tax = lambda c: F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9A-Za-z]", ""))
    live = contacts.filter("active").select("contact_id", tax(F.col("tax_number")).alias("c_tax"), name_key("name").alias("c_name"))
    s = suppliers.select("supplier_id", "linked_contact_id", tax(F.col("tax_id")).alias("want"), name_key("name").alias("key"))
    link = s.filter("linked_contact_id is not null").join(live, F.col("linked_contact_id") == F.col("contact_id")).select("supplier_id", F.lit("l").alias("route"), "contact_id", "c_tax")
    by_tax = s.filter("want <> ''").join(live, F.col("want") == F.col("c_tax")).select("supplier_id", F.lit("t").alias("route"), "contact_id", "c_tax")
    by_name = s.filter("key <> ''").join(live, F.col("key") == F.col("c_name")).select("supplier_id", F.lit("n").alias("route"), "contact_id", "c_tax")
    found = link.unionByName(by_tax).unionByName(by_name).groupBy("supplier_id").agg(
        *(F.count_if(F.col("route") == r).alias(f"n_{r}") for r in "ltn"),
        *(F.min(F.when(F.col("route") == r, F.struct("contact_id", "c_tax"))).alias(f"f_{r}") for r in "ltn"),
    )
    x = s.join(found, "supplier_id", "left")
    n = {r: F.coalesce(f"n_{r}", F.lit(0)) for r in "ltn"}
    conflict = lambda r: (F.col("want") != "") & ~F.col(f"f_{r}.c_tax").isin("") & (F.col(f"f_{r}.c_tax") != F.col("want"))
    linked = F.col("linked_contact_id").isNotNull()
    problem = (
        F.when(linked & (n["l"] == 0), "CONTACT_NOT_FOUND").when(linked & conflict("l"), "CONTACT_CONFLICT").when(linked, None)
        .when(n["t"] > 1, "CONTACT_AMBIGUOUS").when(n["t"] == 1, None).when(n["n"] > 1, "CONTACT_AMBIGUOUS")
        .when(n["n"] == 0, "CONTACT_NOT_FOUND").when(conflict("n"), "CONTACT_CONFLICT")
    )
    route = F.when(problem.isNotNull(), None).when(linked, "link").when(n["t"] == 1, "tax_id").otherwise("name")
    chosen = F.when(route == "link", F.col("f_l.contact_id")).when(route == "tax_id", F.col("f_t.contact_id")).when(route == "name", F.col("f_n.contact_id"))
    return x.select("supplier_id", chosen.alias("contact_id"), route.alias("matched_by"), problem.alias("problem"))
