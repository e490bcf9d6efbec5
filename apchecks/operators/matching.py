"""Three-way matching: invoices against purchase orders, receipts and earlier billing.

Line pairing uses neither receipts nor earlier billing, and what an invoice bills depends only on its own
order and subtotal. So all invoices are paired at once, and "matched in received order" is one running
window per order and one per order line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import number_key
from ..sources.shared import written
from .duplicates import PENDING
from .line_pairs import pair_rest

#: Invoices that bill nothing: those never to be paid, and those not matched yet.
NEVER_BILLED = ("failed", "rejected", *PENDING)
RECEIVED_ORDER = ("created_at", "invoice_id")


def find_orders(invoices: DataFrame, orders: DataFrame) -> DataFrame:
    """Orders that invoices name: one row per invoice with a number, and its outcome.

    Adds po_reason (null when one open order of the invoice's supplier was found), matched_po_id and the
    number of orders of that name. Numbers are compared without punctuation and case.
    """
    named = invoices.withColumn("po_key", number_key("po_number")).filter("po_key <> ''")
    o = orders.select(
        "tenant_id", number_key("po_number").alias("po_key"), F.col("po_id").alias("o_id"), F.col("supplier_id").alias("o_supplier"), F.col("status").alias("o_status")
    )
    mine = F.col("o_supplier") == F.col("supplier_id")
    found = named.join(o, ["tenant_id", "po_key"], "left").groupBy("tenant_id", "invoice_id", "supplier_id").agg(
        F.count("o_id").alias("named"), F.count_if(mine).alias("mine"),
        F.min(F.when(mine, F.struct("o_id", "o_status"))).alias("first"),
    )
    reason = (
        F.when((F.col("named") > 0) & F.col("supplier_id").isNull(), "SUPPLIER_UNKNOWN")
        .when(F.col("mine") > 1, "AMBIGUOUS_PO")
        .when((F.col("mine") == 1) & (F.col("first.o_status") == "open"), None)
        .when(F.col("mine") == 1, "PO_NOT_OPEN")
        .when(F.col("named") > 0, "PO_OF_OTHER_SUPPLIER")
        .otherwise("NOT_IN_SYSTEM")
    )
    outcome = F.when(reason.isNull(), "pass").when(reason.isin("SUPPLIER_UNKNOWN", "AMBIGUOUS_PO"), "skipped").otherwise("fail")
    return found.select(
        "tenant_id", "invoice_id", outcome.alias("outcome"), reason.alias("reason"), "named",
        F.when(reason.isNull(), F.col("first.o_id")).alias("matched_po_id"),
    )


def infer_orders(invoices: DataFrame, orders: DataFrame, tolerance_bp: int = 200) -> DataFrame:
    """Orders for invoices that name none: open orders of the supplier and currency with a near total.

    The range test stands behind an equi-join on tenant, supplier, currency and a bucket of the total:
    totals within the tolerance lie in the same or a neighbouring logarithmic bucket.
    """
    blank = invoices.filter(number_key("po_number") == "")
    able = F.col("supplier_id").isNotNull() & F.col("subtotal_minor").isNotNull() & F.col("currency").isNotNull()
    step = 2.0 * F.log1p(F.lit(tolerance_bp / 10000.0 + 1e-9))
    bucket = lambda c: F.when(F.col(c) > 0, F.floor(F.log(F.col(c).cast("double")) / step)).otherwise(F.lit(-1))
    around = F.explode(F.array(bucket("subtotal_minor") - 1, bucket("subtotal_minor"), bucket("subtotal_minor") + 1))
    i = blank.filter(able).select("tenant_id", "invoice_id", "supplier_id", "currency", "subtotal_minor", around.alias("bucket"))
    o = orders.filter(F.col("status") == "open").select("tenant_id", "supplier_id", "currency", "po_id", "total_minor", bucket("total_minor").alias("bucket"))
    near = F.abs(F.col("total_minor") - F.col("subtotal_minor")) * 10000 <= F.col("total_minor") * tolerance_bp
    hits = i.join(o, ["tenant_id", "supplier_id", "currency", "bucket"]).filter(near)
    hits = hits.groupBy("tenant_id", "invoice_id").agg(F.count("*").alias("candidates"), F.min("po_id").alias("first_po_id"))
    out = blank.select("tenant_id", "invoice_id", able.alias("able")).join(hits, ["tenant_id", "invoice_id"], "left")
    n = F.coalesce("candidates", F.lit(0))
    reason = F.when(~F.col("able"), "CANNOT_INFER_PO").when(n == 1, "PO_INFERRED").when(n > 1, "AMBIGUOUS_PO").otherwise("NO_OPEN_PO_WITH_MATCHING_TOTAL")
    outcome = F.when(reason == "NO_OPEN_PO_WITH_MATCHING_TOTAL", "fail").otherwise("skipped")
    return out.select(
        "tenant_id", "invoice_id", outcome.alias("outcome"), reason.alias("reason"), n.cast("long").alias("candidates"),
        F.when(n == 1, F.col("first_po_id")).alias("matched_po_id"),
    )


def match_orders(invoices: DataFrame, orders: DataFrame, tolerance_bp: int = 200) -> DataFrame:
    """Invoices with matched_po_id and inferred, by number or else by total."""
    by_name = find_orders(invoices, orders).select("tenant_id", "invoice_id", "matched_po_id", F.lit(False).alias("inferred"))
    by_total = infer_orders(invoices, orders, tolerance_bp).select("tenant_id", "invoice_id", "matched_po_id", F.lit(True).alias("inferred"))
    return invoices.join(by_name.unionByName(by_total), ["tenant_id", "invoice_id"], "left")


def receipts_by_line(order_lines: DataFrame, receipt_lines: DataFrame) -> DataFrame:
    """Quantity received and receipts of every order line; none is 0. Receipts are summed before the join."""
    by_line = receipt_lines.groupBy("po_line_id").agg(F.sum("qty_received").alias("qty_received"))
    by_order = receipt_lines.groupBy("po_id").agg(F.count_distinct("receipt_id").alias("receipts"))
    out = order_lines.join(by_line, "po_line_id", "left").join(by_order, "po_id", "left")
    return out.fillna({"receipts": 0}).withColumn("qty_received", F.coalesce("qty_received", F.lit(0).cast("decimal(28,4)")))


def _before(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy(*RECEIVED_ORDER).rowsBetween(Window.unboundedPreceding, -1)


def counted(status: str = "status") -> Column:
    return ~F.col(status).isin(*NEVER_BILLED)


def billed_before(matched: DataFrame) -> DataFrame:
    """What earlier invoices billed on the same order, and how many of them are unknown.

    ``matched`` holds matched_po_id and billed_minor. An order with very many invoices is one window
    partition; its rows are narrow, and the window runs over them once.
    """
    bills = matched.filter(F.col("matched_po_id").isNotNull())
    w = _before("tenant_id", "matched_po_id")
    return bills.withColumns(
        {
            "billed_before_minor": F.coalesce(F.sum(F.when(counted(), F.col("billed_minor"))).over(w), F.lit(0)),
            "unknown_before": F.coalesce(F.sum(F.when(counted() & F.col("billed_minor").isNull(), 1).otherwise(0)).over(w), F.lit(0)),
        }
    )


def check_overbilled(invoices: DataFrame, orders: DataFrame, tolerance_minor: int = 0) -> DataFrame:
    """Invoices that bill an order beyond its total, earlier invoices included."""
    o = orders.select("tenant_id", F.col("po_id").alias("matched_po_id"), F.col("currency").alias("po_currency"), F.col("total_minor").alias("po_total_minor"))
    m = invoices.filter(F.col("matched_po_id").isNotNull()).join(o, ["tenant_id", "matched_po_id"])
    credit = F.coalesce(F.col("subtotal_minor") < 0, F.lit(False))
    reason = (
        F.when(credit, "CREDIT_NOTE")
        .when(F.col("currency").isNull(), "CURRENCY_UNKNOWN")
        .when(F.col("currency") != F.col("po_currency"), "CURRENCY_DIFFERS_FROM_PO")
        .when(F.col("subtotal_minor").isNull(), "NO_SUBTOTAL")
    )
    m = m.withColumns({"reason": reason, "billed_minor": F.when(reason.isNull(), F.col("subtotal_minor"))})
    b = billed_before(m)
    over = F.col("billed_before_minor") + F.col("billed_minor") - F.col("po_total_minor")
    late = F.when(F.col("reason").isNotNull(), F.col("reason")).when((over <= tolerance_minor) & (F.col("unknown_before") > 0), "EARLIER_BILLING_UNKNOWN")
    outcome = F.when(late.isNotNull(), "skipped").when(over > tolerance_minor, "fail").otherwise("pass")
    return b.select(
        "tenant_id", "invoice_id", "matched_po_id", outcome.alias("outcome"), late.alias("reason"), "billed_minor",
        F.col("billed_before_minor").cast("long").alias("billed_before_minor"), F.col("unknown_before").cast("long").alias("unknown_before"),
        F.when(F.col("billed_minor").isNotNull(), over).cast("long").alias("over_minor"),
    )


def pair_by_sku(matched_lines: DataFrame, order_lines: DataFrame) -> DataFrame:
    """Invoice lines and order lines of the same SKU: only a SKU on one order line says which one.

    ``matched_lines`` are invoice lines with matched_po_id. Of several invoice lines with one SKU the
    first takes the order line.
    """
    i = matched_lines.withColumn("sku_key", number_key("sku")).filter("sku_key <> ''")
    first = Window.partitionBy("invoice_id", "sku_key").orderBy("line_no")
    i = i.withColumn("turn", F.row_number().over(first)).filter("turn = 1").drop("turn")
    o = order_lines.withColumn("sku_key", number_key("sku")).filter("sku_key <> ''")
    only = o.groupBy("po_id", "sku_key").agg(
        F.count("*").alias("n"), F.min("po_line_id").alias("po_line_id"), F.min("qty").alias("po_qty"), F.min("unit_price_minor").alias("po_unit_price_minor")
    )
    only = only.filter("n = 1").drop("n").withColumnRenamed("po_id", "matched_po_id")
    return i.drop("po_line_id").join(only, ["matched_po_id", "sku_key"]).withColumn("method", F.lit("sku"))


def paired_keys(matched_lines: DataFrame, order_lines: DataFrame) -> DataFrame:
    """The pairs of `pair_lines` without the columns of either side, which then need not be joined to them again."""
    columns = ["invoice_id", "line_no", "po_line_id", "method"]
    by_sku = written(pair_by_sku(matched_lines, order_lines).select(*columns), "pairs-by-sku")  # read three times
    return by_sku.unionByName(pair_rest(matched_lines, order_lines, by_sku).select(*columns))


def pair_lines(matched_lines: DataFrame, order_lines: DataFrame) -> DataFrame:
    """Invoice lines with the order line they bill, by SKU or else by description or amount."""
    by_sku = written(pair_by_sku(matched_lines, order_lines), "pairs-by-sku")  # read three times
    rest = pair_rest(matched_lines, order_lines, by_sku)
    o = order_lines.select("po_line_id", F.col("qty").alias("po_qty"), F.col("unit_price_minor").alias("po_unit_price_minor"))
    by_rest = matched_lines.drop("po_line_id").join(rest, ["invoice_id", "line_no"]).join(o, "po_line_id")
    return by_sku.drop("sku_key").unionByName(by_rest)


def check_price(pairs: DataFrame, tolerance_bp: int = 200) -> DataFrame:
    """Paired lines whose unit price differs from the order's by more than the tolerance, either way."""
    gap = F.abs(F.col("unit_price_minor") - F.col("po_unit_price_minor"))
    outcome = F.when(F.col("unit_price_minor").isNull(), "skipped").when(gap * 10000 > F.col("po_unit_price_minor") * tolerance_bp, "fail").otherwise("pass")
    variance = F.when(F.col("po_unit_price_minor") != 0, F.floor(gap * 10000 / F.col("po_unit_price_minor")))
    return pairs.select(
        "invoice_id", "line_no", "po_line_id", outcome.alias("outcome"), "unit_price_minor", "po_unit_price_minor", variance.cast("long").alias("variance_bp")
    )


def check_quantities(pairs: DataFrame, received: DataFrame, tolerance_bp: int = 0) -> DataFrame:
    """Paired lines against the ordered and the received quantity, what earlier invoices billed included.

    ``pairs`` hold status, created_at and tenant_id of their invoices; ``received`` is `receipts_by_line`.
    """
    w = _before("po_line_id")
    bills = pairs.withColumn("before", F.coalesce(F.sum(F.when(counted(), F.col("qty"))).over(w), F.lit(0).cast("decimal(28,4)")))
    r = received.select("po_line_id", "qty_received", "receipts")
    b = bills.join(r, "po_line_id")
    billed = F.col("before") + F.col("qty")
    over = billed * 10000 > F.col("po_qty") * (10000 + tolerance_bp)
    unread = F.col("qty").isNull()
    return b.select(
        "invoice_id", "line_no", "po_line_id",
        F.when(unread, "skipped").when(over, "fail").otherwise("pass").alias("qty_outcome"),
        F.when(F.col("receipts") == 0, "skipped").when(unread, "skipped").when(billed > F.col("qty_received"), "fail").otherwise("pass").alias("received_outcome"),
        F.col("before").cast("long").alias("billed_before_qty"), F.col("qty").cast("long").alias("billed_qty"),
        F.col("po_qty").cast("long").alias("po_qty"), F.col("qty_received").cast("long").alias("received_qty"),
    )


def _heads(invoices: DataFrame, orders: DataFrame, total_tolerance_bp: int) -> DataFrame:
    """Per invoice the order found, and outcome and reason of the two checks that look for it."""
    none, text = F.lit(None).cast("string"), F.lit("pass")
    named = find_orders(invoices, orders)
    unclear = F.col("reason").eqNullSafe(F.lit("AMBIGUOUS_PO"))
    named = named.select(
        "tenant_id", "invoice_id", "matched_po_id",
        F.when(unclear, "skipped").otherwise("pass").alias("no_po"), F.when(unclear, F.col("reason")).alias("no_po_reason"),
        F.when(unclear, "pass").otherwise(F.col("outcome")).alias("not_found"),
        F.when(F.col("outcome") == "skipped", F.when(~unclear, F.col("reason"))).alias("not_found_reason"),
    )
    guessed = infer_orders(invoices, orders, total_tolerance_bp).select(
        "tenant_id", "invoice_id", "matched_po_id", F.col("outcome").alias("no_po"),
        F.when(F.col("outcome") == "skipped", F.col("reason")).alias("no_po_reason"), text.alias("not_found"), none.alias("not_found_reason"),
    )
    return named.unionByName(guessed)


def _verdict(findings: Column, unread: Column, pairs: Column) -> tuple[Column, Column]:
    """Outcome and reason of a check over lines: findings, then what could not be read, then no lines at all."""
    reason = F.when(findings > 0, None).when(unread > 0, "UNREADABLE_LINE").when(pairs == 0, "NO_MATCHED_LINES")
    return F.when(findings > 0, "fail").when(reason.isNotNull(), "skipped").otherwise("pass"), reason


def match_checks(
    invoices: DataFrame, orders: DataFrame, invoice_lines: DataFrame, order_lines: DataFrame, receipt_lines: DataFrame,
    total_tolerance_bp: int = 200, price_tolerance_bp: int = 200, qty_tolerance_bp: int = 0, overbill_tolerance_minor: int = 0,
) -> DataFrame:
    """All seven checks against orders, receipts and earlier billing: a row per invoice and code.

    Lines are paired by SKU, then description, then amount; an unpaired line counts as not on the order. A
    credit note is matched but not compared, and counts as unknown billing for later invoices, as does one in
    another currency or with unread quantities on paired lines: where earlier billing is unknown, or earlier
    invoices of the tenant are still being read, a cumulative check can fail but not pass. Two windows in
    received order, one per order and one per order line, see all invoices at once.
    """
    keys = ["tenant_id", "invoice_id"]
    of_lines = invoice_lines.groupBy("invoice_id").agg(
        F.count("*").alias("lines"), F.count("amount_minor").alias("amounts"), F.sum("amount_minor").alias("lines_minor"),
        F.coalesce(F.max((F.col("qty") < 0) | (F.col("amount_minor") < 0)), F.lit(False)).alias("negative"),
    )
    o = orders.select(
        "tenant_id", F.col("po_id").alias("matched_po_id"), F.col("currency").alias("po_currency"), F.col("total_minor").alias("po_total_minor")
    )
    on_order = order_lines.groupBy(F.col("po_id").alias("matched_po_id")).agg(F.count("*").alias("po_lines"))
    receipts = receipt_lines.groupBy(F.col("po_id").alias("matched_po_id")).agg(F.count_distinct("receipt_id").alias("receipts"))
    m = invoices.select(*keys, "currency", "subtotal_minor", "status", "created_at").join(_heads(invoices, orders, total_tolerance_bp), keys, "left")
    m = m.join(of_lines, "invoice_id", "left").join(o, ["tenant_id", "matched_po_id"], "left").join(on_order, "matched_po_id", "left")
    m = m.join(receipts, "matched_po_id", "left").fillna(0, ["lines", "amounts", "po_lines", "receipts"])
    credit = F.coalesce(F.col("subtotal_minor") < 0, F.lit(False)) | F.coalesce("negative", F.lit(False))
    m = m.withColumns(
        {
            "credit": credit,
            "currency_reason": F.when(F.col("currency") == F.col("po_currency"), None).when(F.coalesce("currency", F.lit("")) == "", "CURRENCY_UNKNOWN").otherwise("CURRENCY_DIFFERS_FROM_PO"),
            "bill": F.coalesce("subtotal_minor", F.when((F.col("lines") > 0) & (F.col("amounts") == F.col("lines")), F.col("lines_minor"))),
        }
    )
    compared = m.filter(F.col("matched_po_id").isNotNull() & ~F.col("credit")).select(*keys, "matched_po_id", "status", "created_at")
    lines = invoice_lines.select("invoice_id", "line_no", "sku", "description", "amount_minor", "qty", "unit_price_minor").join(compared, "invoice_id")
    pairs = pair_lines(lines, order_lines)
    received = receipt_lines.groupBy("po_line_id").agg(F.sum("qty_received").alias("received"))
    before = F.coalesce(F.sum(F.when(counted(), F.col("qty"))).over(_before("po_line_id")), F.lit(0).cast("decimal(28,4)"))
    pairs = pairs.withColumn("billed", before + F.col("qty")).join(received, "po_line_id", "left")
    gap = F.abs(F.col("unit_price_minor") - F.col("po_unit_price_minor"))
    of_pairs = pairs.groupBy("invoice_id").agg(
        F.count("*").alias("pairs"), F.count_if(F.col("unit_price_minor").isNull()).alias("unread_price"), F.count_if(F.col("qty").isNull()).alias("unread_qty"),
        F.count_if(gap * 10000 > F.col("po_unit_price_minor") * price_tolerance_bp).alias("bad_price"),
        F.count_if(F.col("billed") * 10000 > F.col("po_qty") * (10000 + qty_tolerance_bp)).alias("bad_qty"),
        F.count_if(F.col("billed") > F.coalesce("received", F.lit(0))).alias("bad_received"),
    )
    counts = ["pairs", "unread_price", "unread_qty", "bad_price", "bad_qty", "bad_received"]
    m = m.join(of_pairs, "invoice_id", "left").fillna(0, counts)
    waiting = invoices.filter(F.col("status").isin(*PENDING)).groupBy("tenant_id").agg(F.min(F.struct(*RECEIVED_ORDER)).alias("pending"))
    m = m.join(waiting, "tenant_id", "left").withColumn("waits", F.coalesce(F.col("pending") < F.struct(*RECEIVED_ORDER), F.lit(False)))
    m = m.withColumn("billed_minor", F.when(~F.col("credit") & F.col("currency_reason").isNull(), F.col("bill")))
    w = _before("tenant_id", "matched_po_id")
    matched = F.col("matched_po_id").isNotNull()
    m = m.withColumns(
        {
            "before_minor": F.when(matched, F.coalesce(F.sum(F.when(counted(), F.col("billed_minor"))).over(w), F.lit(0))),
            "unknown": F.when(matched, F.coalesce(F.sum(F.when(counted(), F.col("billed_minor").isNull().cast("long") + F.col("unread_qty"))).over(w), F.lit(0))),
        }
    )
    no_lines = F.when(F.col("lines") == 0, "NO_LINES").when(F.col("po_lines") == 0, "PO_HAS_NO_LINES")
    first = F.when(~matched, "NO_PO").when(F.col("credit"), "CREDIT_NOTE")
    over = F.col("before_minor") + F.col("bill") - F.col("po_total_minor")
    no_subtotal = F.when(F.col("bill").isNull(), "NO_SUBTOTAL")

    def rule(code: str, guard: Column, outcome: Column, reason: Column, cumulative: bool = False) -> Column:
        guard = F.coalesce(first, guard)
        out, why = F.when(guard.isNotNull(), "skipped").otherwise(outcome), F.coalesce(guard, reason)
        if cumulative:
            doubt = (out == "pass") & (F.col("waits") | (F.col("unknown") > 0))
            cause = F.when(F.col("waits"), "EARLIER_INVOICES_STILL_PENDING").otherwise("EARLIER_BILLING_UNKNOWN")
            out, why = F.when(doubt, "skipped").otherwise(out), F.when(doubt, cause).otherwise(why)
        return F.struct(F.lit(code).alias("check_code"), out.alias("outcome"), F.when(out == "skipped", why).alias("reason"))

    none = F.lit(None).cast("string")
    price = _verdict(F.col("bad_price"), F.col("unread_price"), F.col("pairs"))
    qty = _verdict(F.col("bad_qty") + F.col("lines") - F.col("pairs"), F.col("unread_qty"), F.col("pairs"))
    got = _verdict(F.col("bad_received"), F.col("unread_qty"), F.col("pairs"))
    no_receipt = F.when(F.col("receipts") == 0, "NO_RECEIPT")
    plain = lambda code, out, why: F.struct(F.lit(code).alias("check_code"), F.col(out).alias("outcome"), F.col(why).alias("reason"))
    rows = F.array(
        plain("NO_PO", "no_po", "no_po_reason"), plain("PO_NOT_FOUND", "not_found", "not_found_reason"),
        rule("PRICE_VARIANCE", F.coalesce(no_lines, F.col("currency_reason")), *price), rule("QTY_VARIANCE", no_lines, *qty, True),
        rule("RECEIPT_MISSING", none, F.when(F.col("receipts") == 0, "fail").otherwise("pass"), none),
        rule("QTY_NOT_RECEIVED", F.coalesce(no_lines, no_receipt), *got, True),
        rule("PO_OVERBILLED", F.coalesce("currency_reason", no_subtotal), F.when(over > overbill_tolerance_minor, "fail").otherwise("pass"), none, True),
    )
    return m.select(*keys, F.explode(rows).alias("c")).select(*keys, "c.*")
