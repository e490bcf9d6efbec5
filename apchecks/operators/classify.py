"""Exceptions from check results, and routing to straight-through or review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Code, severity, subject of the check, suggested fix, in taxonomy order.
TAXONOMY = (
    ("UNREADABLE_DOCUMENT", "block", "the document", "Ask the supplier for a clearer copy"),
    ("LOW_CONFIDENCE_FIELD", "review", "the field confidence", "Check the highlighted field and confirm or correct it"),
    ("LINE_MATH_MISMATCH", "review", "the line arithmetic", "Confirm with the supplier; possibly a typo"),
    ("TOTAL_MISMATCH", "review", "the totals", "Ask the supplier for a corrected invoice"),
    ("TAX_MISMATCH", "review", "the tax", "Check the tax rate for this supplier"),
    ("INVALID_DATE", "review", "the dates", "Confirm the date with the supplier"),
    ("UNKNOWN_SUPPLIER", "review", "the supplier", "Link to an existing supplier or create a new one"),
    ("BANK_DETAILS_CHANGED", "block", "the bank account", "Verify by phone using a known contact before approving. This is a common fraud pattern"),
    ("POSSIBLE_DUPLICATE", "block", "the duplicate check", "Compare them side by side; reject if duplicate"),
    ("NO_PO", "review", "the purchase order lookup", "Ask the requester for the PO, or approve as a non-PO invoice"),
    ("PO_NOT_FOUND", "review", "the purchase order lookup", "Check for a typo or ask purchasing"),
    ("PRICE_VARIANCE", "review", "the price comparison with the PO", "Accept the variance, or ask the supplier to correct it"),
    ("QTY_VARIANCE", "review", "the quantity comparison with the PO", "Ask the supplier or purchasing"),
    ("RECEIPT_MISSING", "review", "the goods receipt check", "Wait for the goods receipt or confirm delivery with the requester"),
    ("QTY_NOT_RECEIVED", "review", "the received quantity comparison", "Hold, or pay partially once the rest arrives"),
    ("PO_OVERBILLED", "block", "the PO billing total", "Stop and check with purchasing"),
    ("CURRENCY_MISMATCH", "review", "the currency", "Confirm the currency with the supplier"),
    ("ABOVE_APPROVAL_LIMIT", "review", "the approval limit", "Needs manager approval"),
)
# Words for the reasons why a check could not be done.
REASON_WORDS = {
    "MISSING_AMOUNTS": "the subtotal or the tax amount was not read",
    "NO_RATE_TO_COMPARE": "there is no tax rate on file for this supplier or on the lines",
    "NO_INVOICE_DATE": "the invoice date was not read",
    "UNKNOWN_SUPPLIER": "the supplier is not known",
    "NOTHING_TO_MATCH": "neither a supplier name nor a tax ID was read",
    "BANK_NOT_READ": "the bank account on the invoice could not be read",
    "NO_BANK_ON_FILE": "there is no bank account on file for this supplier to compare with",
    "NO_SUPPLIER": "the supplier is not known",
    "NO_INVOICE_NUMBER": "the invoice number was not read",
    "INCOMPLETE_FOR_SOFT_MATCH": "a similar earlier invoice, or this one, is missing its total, date or currency",
    "SUPPLIER_UNCERTAIN": "a similar earlier invoice has a supplier that could be the same company written another way",
    "EARLIER_INVOICES_STILL_PENDING": "earlier invoices were still being read when the wait ended",
    "TOO_MANY_TO_COMPARE": "there are too many earlier invoices to compare",
    "NO_PO": "no purchase order was found",
    "CANNOT_INFER_PO": "no PO number was printed and the supplier, currency or subtotal is missing",
    "PO_INFERRED": "no PO number was printed, so the PO was guessed from the amount",
    "SUPPLIER_UNKNOWN": "the PO number was found but the supplier of this invoice is not known",
    "AMBIGUOUS_PO": "more than one purchase order fits",
    "CREDIT_NOTE": "the invoice has a negative amount or quantity (a credit note)",
    "NO_LINES": "no invoice lines were read",
    "PO_HAS_NO_LINES": "the purchase order has no lines",
    "NO_RECEIPT": "nothing has been received yet",
    "NO_MATCHED_LINES": "no invoice line could be matched to a PO line",
    "UNREADABLE_LINE": "a line's price or quantity could not be read",
    "CURRENCY_DIFFERS_FROM_PO": "the invoice currency differs from the PO currency",
    "CURRENCY_UNKNOWN": "the invoice currency was not read",
    "NO_SUBTOTAL": "the subtotal could not be read",
    "TOO_MANY_POS_TO_COMPARE": "there are too many purchase orders to search",
    "EARLIER_BILLING_UNKNOWN": "an earlier invoice on the same PO has an unreadable amount",
}
# Skips that only repeat another exception.
DERIVED_FROM = {
    "UNKNOWN_SUPPLIER": ("UNKNOWN_SUPPLIER",),
    "NO_PO": ("NO_PO", "PO_NOT_FOUND"),
    "NO_RECEIPT": ("RECEIPT_MISSING",),
}
SEVERITY_RANK = {"block": 3, "review": 2, "info": 1}


def _map(pairs: dict[str, object]) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def missing_checks(results: DataFrame, invoices: DataFrame, expected: tuple[str, ...]) -> DataFrame:
    """Expected checks without a result, per invoice; the expected codes are an array, not a join."""
    have = results.groupBy("invoice_id").agg(F.collect_set("check_code").alias("have"))
    codes = F.array(*map(F.lit, expected))
    left = invoices.select("invoice_id").join(have, "invoice_id", "left")
    missing = F.array_except(codes, F.coalesce("have", F.array().cast("array<string>")))
    return left.select("invoice_id", F.explode(missing).alias("check_code"))


def exceptions(results: DataFrame) -> DataFrame:
    """Every failed and skipped check as an exception, without skips that repeat another one.

    A skip is dropped when its reason derives from a code that was raised by another check; a credit
    note gives one card. All rules look at one invoice, so one shuffle by invoice is enough.
    """
    severity = _map({c: s for c, s, _, _ in TAXONOMY})
    subject = _map({c: s for c, _, s, _ in TAXONOMY})
    fix = _map({c: f for c, _, _, f in TAXONOMY})
    ordinal = _map({c: i for i, (c, *_) in enumerate(TAXONOMY)})
    derived = F.create_map(*(x for k, v in DERIVED_FROM.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    r = results.filter(F.col("outcome") != "pass").withColumn("roots", F.coalesce(derived[F.coalesce("reason", F.lit(""))], F.array().cast("array<string>")))
    is_root = (F.col("outcome") == "fail") | (F.size("roots") == 0) | F.array_contains("roots", F.col("check_code"))
    card = F.struct(ordinal[F.col("check_code")].alias("ordinal"), "check_code", "outcome", "reason", "roots")
    per = r.groupBy("invoice_id").agg(F.array_sort(F.collect_list(card)).alias("cards"), F.collect_set(F.when(is_root, F.col("check_code"))).alias("raised"))
    repeated = lambda c: (c["outcome"] == "skipped") & ~F.array_contains(c["roots"], c["check_code"]) & F.arrays_overlap(c["roots"], F.col("raised"))
    kept = F.filter("cards", lambda c: ~repeated(c))
    first_credit = F.array_min(F.transform(F.filter(kept, lambda c: c["reason"].eqNullSafe(F.lit("CREDIT_NOTE")) & (c["outcome"] == "skipped")), lambda c: c["ordinal"]))
    kept = F.filter(kept, lambda c: ~(c["reason"].eqNullSafe(F.lit("CREDIT_NOTE")) & (c["outcome"] == "skipped")) | (c["ordinal"] == first_credit))
    x = per.select("invoice_id", F.explode(kept).alias("c")).select("invoice_id", F.col("c.check_code").alias("code"), F.col("c.outcome").alias("outcome"), F.col("c.reason").alias("reason"))
    unchecked = F.col("outcome") == "skipped"
    words = F.when(F.col("reason").isNull(), "no reason was recorded").otherwise(F.coalesce(_map(REASON_WORDS)[F.col("reason")], F.concat(F.lit("unrecognised reason "), F.substring("reason", 1, 40))))
    about = subject[F.col("code")]
    sentence = F.concat(F.upper(F.substring(about, 1, 1)), F.substring(about, 2, 200), F.lit(" could not be checked ("), words, F.lit("), so a person needs to look at it."))
    return x.select(
        "invoice_id", "code", F.when(unchecked, "review").otherwise(severity[F.col("code")]).alias("severity"), unchecked.alias("unchecked"),
        F.when(unchecked, sentence).alias("unchecked_words"), fix[F.col("code")].alias("suggested_fix"),
    )


def route(invoices: DataFrame, raised: DataFrame, limits: dict[str, int], missing: DataFrame | None = None) -> DataFrame:
    """Cleared only when nothing is in doubt; otherwise the ordered reasons for review."""
    e = raised.groupBy("invoice_id").agg(
        F.count("*").alias("open_exceptions"),
        F.max(((F.col("code") == "BANK_DETAILS_CHANGED") & ~F.col("unchecked"))).alias("bank"),
        F.max(_map(SEVERITY_RANK)[F.col("severity")]).alias("worst"),
    )
    i = invoices.join(e, "invoice_id", "left")
    if missing is not None:
        i = i.join(missing.groupBy("invoice_id").agg(F.count("*").alias("missing")), "invoice_id", "left")
    else:
        i = i.withColumn("missing", F.lit(0))
    total, limit = F.col("total_minor"), _map(limits)[F.coalesce("currency", F.lit(""))]
    reasons = F.array_compact(
        F.array(
            F.when(F.col("bank"), "BANK_DETAILS_CHANGED"),
            F.when(F.col("worst") >= 2, "OPEN_EXCEPTIONS"),
            F.when(total.isNull(), "NO_TOTAL").when(total < 0, "CREDIT_NOTE").when(total == 0, "ZERO_TOTAL"),
            F.when(limit.isNull(), "NO_LIMIT").when(total > limit, "ABOVE_LIMIT"),
            F.when(F.col("missing") > 0, "MISSING_CHECKS"),
        )
    )
    clear = F.size(reasons) == 0
    return i.select(
        "tenant_id", "invoice_id", "created_at", F.when(clear, "cleared").otherwise("needs_review").alias("status"),
        F.when(clear, "straight_through").otherwise("review").alias("route"), F.array_join(reasons, ",").alias("reasons"),
        F.coalesce("open_exceptions", F.lit(0)).alias("open_exceptions"), F.coalesce("worst", F.lit(0)).alias("worst"),
    )


def review_queue(routed: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Invoices that need a person: worst exception first, then the oldest."""
    waiting = routed.filter(F.col("status").isin("needs_review", "failed"))
    page = waiting.orderBy(F.desc("worst"), "created_at", "invoice_id").offset(offset).limit(limit)
    return page.select("invoice_id", "worst", "open_exceptions", "reasons")
