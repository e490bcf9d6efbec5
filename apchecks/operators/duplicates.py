"""Duplicate invoices: a later invoice against earlier ones of the same supplier.

Two linked invoices have the same supplier when their records are the same. Without a record on either side
the printed names decide; a linked and an unlinked invoice whose names could be one company written two
ways, or that have no name to compare, leave the supplier uncertain. Every relation is an equality of one
key, so that hard duplicates are a window and similar numbers a join inside such keys; only what is
uncertain crosses suppliers, over the numbers of invoices without a record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import canonical_key, name_key, number_key, ratio_200
from ..sources.shared import written
from .keyfilter import keys_of, perhaps_among, shared_keys
from .near_numbers import Numbers, long_numbers, near_numbers, with_like

# Statuses of invoices that are not read and checked yet, and of those that have nothing to compare.
PENDING = ("received", "extracting", "extracted")
NOT_COMPARABLE = (*PENDING, "failed")
#: Printed names less alike than this are different companies.
DIFFERENT_COMPANY_BELOW = 60
KEYS = ["tenant_id", "invoice_id"]
ORDER = ("created_at", "invoice_id")


def numbered(invoices: DataFrame) -> DataFrame:
    """Linked invoices with their number keys, and whether they can be compared with (``old``)."""
    i = invoices.filter(F.col("supplier_id").isNotNull()).withColumn("old", ~F.col("status").isin(*NOT_COMPARABLE))
    i = i.withColumn("number_key", number_key("invoice_number"))
    return i.withColumn("canonical", canonical_key("number_key"))


def hard_duplicates(invoices: DataFrame) -> DataFrame:
    """Invoices with an earlier one of the same supplier and canonical number; the first is reported.

    One window per (tenant, supplier, number): no pairs are made.
    """
    i = numbered(invoices).filter("canonical <> ''")
    return _first_equal(i, ["supplier_id"]).select(*KEYS, "existing_invoice_id", "days_apart")


def _first_equal(i: DataFrame, who: list[str]) -> DataFrame:
    """Rows with an earlier ``old`` one of equal ``who`` and canonical number, the first of which is reported."""
    before = Window.partitionBy("tenant_id", *who, "canonical").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    first = F.min(F.when(F.col("old"), F.struct(*ORDER, "invoice_date"))).over(before)
    found = i.withColumn("first", first).filter(F.col("first").isNotNull())
    return found.withColumns({"existing_invoice_id": F.col("first.invoice_id"), "days_apart": F.abs(F.datediff("invoice_date", "first.invoice_date"))})


def compared_earlier(invoices: DataFrame) -> DataFrame:
    """How many earlier invoices of its supplier each invoice is compared with."""
    order = Window.partitionBy("tenant_id", "supplier_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    return numbered(invoices).select(*KEYS, F.count_if("old").over(order).alias("compared"))


def complete() -> Column:
    """What the soft rule compares is there; a zero total is no evidence."""
    return (F.col("total_minor") != 0) & F.col("invoice_date").isNotNull() & (F.coalesce("currency", F.lit("")) != "")


def _earlier(at: str = "at", other: str = "o_at") -> Column:
    return F.col(other) < F.col(at)


def _as_old(rows: DataFrame) -> DataFrame:
    return rows.withColumnsRenamed({c: f"o_{c}" for c in ORDER})


def _received_before() -> Column:
    return F.struct(*(F.col(f"o_{c}") for c in ORDER)) < F.struct(*ORDER)


def _comparable(i: DataFrame, who: list[str]) -> tuple[DataFrame, list[str]]:
    """Rows that the soft rule can compare and that share what it asks for with another, and the columns of that."""
    scope = ["tenant_id", *who, "cur", "total_minor"]
    rows = i.filter(complete() & (F.col("number_key") != "")).withColumns({"cur": F.upper("currency"), "number": F.col("number_key")})
    rows = rows.select(*scope, "number", "canonical", *ORDER, "invoice_date", "old", "new")
    return perhaps_among(rows, shared_keys(rows, scope), scope), scope


def _most_alike(i: DataFrame, who: list[str], window_days: int, similarity_min: int) -> DataFrame:
    """Per invoice the most similar earlier one of equal ``who``, currency and signed total and a near date.

    Only groups of several invoices are looked at; inside them numbers are joined by what they share, so that
    many invoices of one total make pairs only where their numbers are alike.
    """
    rows, scope = _comparable(i, who)
    rows = written(rows.withColumn("at", F.struct(*ORDER)).drop("created_at"), "duplicates-soft")  # read many times over
    pairs = near_numbers(rows.filter("new"), rows.filter("old"), scope, similarity_min, rows)
    later = rows.filter("new").withColumnRenamed("number", "a")
    old = rows.filter("old").select(*scope, F.col("number").alias("b"), F.col("canonical").alias("o_canonical"), F.col("at").alias("o_at"), F.col("invoice_date").alias("o_date"))
    met = later.join(pairs, [*scope, "a"]).join(old, [*scope, "b"])
    days = F.abs(F.datediff("invoice_date", "o_date"))
    alike = met.filter(_earlier() & (days <= window_days) & (F.col("canonical") != F.col("o_canonical")))
    best = F.min(F.struct((-F.col("similarity")).alias("s"), "o_at", days.alias("days"))).alias("b")
    return alike.groupBy(*KEYS).agg(best).select(
        *KEYS, F.col("b.o_at.invoice_id").alias("existing_invoice_id"), F.round(-F.col("b.s"), 1).alias("similarity"), F.col("b.days").alias("days_apart")
    )


def _soft(related: DataFrame, n: Numbers, window_days: int) -> DataFrame:
    """Invoices of which `_most_alike` finds an earlier one; no pairs are made, and only what shares a variant is shuffled."""
    rows, scope = _comparable(related, ["who"])
    on = [*scope, "variant"]
    shared = shared_keys(n.variants(rows, n.left | n.right, "l", *scope), on)
    apart = (F.abs(F.datediff("invoice_date", "o_date")) <= window_days) & (F.col("canonical") != F.col("o_canonical"))
    old = _as_old(rows.filter("old").select(*scope, "number", *ORDER, F.col("canonical").alias("o_canonical"), F.col("invoice_date").alias("o_date")))
    new = rows.filter("new").drop("old", "new")
    found = with_like(n, new, old, scope, _received_before() & apart, shared).select(*KEYS)
    if n.long:
        pairs = long_numbers(new, old, scope, n.percent)
        met = new.withColumnRenamed("number", "a").join(pairs, [*scope, "a"]).join(old.withColumnRenamed("number", "b"), [*scope, "b"])
        found = found.unionByName(met.filter(_received_before() & apart).select(*KEYS))
    return found


def soft_duplicates(invoices: DataFrame, window_days: int = 7, similarity_min: int = 85) -> DataFrame:
    """Later invoices with the same supplier, currency and signed total, a near date and a like number.

    The most similar earlier invoice is reported, of equals the first received.
    """
    return _most_alike(numbered(invoices).withColumn("new", F.lit(True)), ["supplier_id"], window_days, similarity_min)


def _keyed(invoices: DataFrame) -> DataFrame:
    """What the check compares of each invoice."""
    i = invoices.select(
        *KEYS, "created_at", "supplier_id", name_key("supplier_name").alias("name"), F.lower(F.coalesce("supplier_name", F.lit(""))).alias("lower"), number_key("invoice_number").alias("number_key"),
        "invoice_date", "currency", "total_minor", (~F.col("status").isin(*NOT_COMPARABLE)).alias("comparable"), F.coalesce(complete(), F.lit(False)).alias("whole"),
    )
    return i.withColumn("canonical", canonical_key("number_key"))


def _related(keyed: DataFrame) -> DataFrame:
    """A row per invoice and relation key: ``new`` where it may look for earlier ones, ``old`` where it may be found.

    L: a supplier record, between linked invoices. U: a printed name, between any invoice and an unlinked
    earlier one. W: a name in the same letters, between an unlinked invoice and a linked earlier one.
    """
    linked, name, lower = F.col("supplier_id").isNotNull(), F.col("name"), F.col("lower")
    key = lambda kind, text, new, old: F.struct(F.concat(F.lit(kind), text).alias("who"), F.lit(new).alias("new"), F.lit(old).alias("may"))
    named = lambda k: F.when(name != "", k)
    of_linked = F.array(key("L", F.col("supplier_id").cast("string"), True, True), named(key("U", name, True, False)), F.when(lower != "", key("W", lower, False, True)))
    of_others = F.array(named(key("U", name, True, True)), F.when(lower != "", key("W", lower, True, False)))
    i = keyed.filter(F.col("number_key") != "").withColumn("r", F.explode(F.array_compact(F.when(linked, of_linked).otherwise(of_others))))
    i = i.withColumns({"who": F.col("r.who"), "new": F.col("r.new"), "old": F.col("r.may") & F.col("comparable")}).drop("r")
    return i.filter(F.col("new") | F.col("old"))


def _hard(keyed: DataFrame) -> DataFrame:
    """Invoices with an earlier one of equal canonical number and one supplier.

    Dealt out by number before the relations are told apart, so that each invoice is shuffled once.
    """
    some = keyed.select(*KEYS, "created_at", "supplier_id", "name", "lower", "number_key", "canonical", "comparable").filter(F.col("number_key") != "")
    on = ["tenant_id", "canonical"]
    dealt = perhaps_among(some, shared_keys(some, on), on).repartition(*on)
    before = Window.partitionBy(*on, "who").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    return _related(dealt).withColumn("met", F.max("old").over(before)).filter(F.col("new") & F.col("met")).select(*KEYS)


def _unevaluable(related: DataFrame, n: Numbers) -> DataFrame:
    """Invoices with an earlier one of the supplier and a like number where either lacks what the soft rule compares.

    Of the earlier rows that share a variant the shortest decides: a running minimum instead of pairs. Only variants that a
    lacking row of the supplier has as well are shuffled.
    """
    scope = ["tenant_id", "who"]
    rows = related.select(*scope, F.col("number_key").alias("number"), "whole", "new", "old", *ORDER)
    on = [*scope, "variant"]
    lacking = rows.filter(~F.col("whole"))
    variants = lambda df, *keep: n.variants(df, n.left | n.right, "la", *scope, *keep)
    some = perhaps_among(variants(rows, "whole", "new", "old", *ORDER), keys_of(variants(lacking), on), on)
    before = Window.partitionBy(*on).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    shortest = F.when(F.col("whole"), F.min(F.when(F.col("old") & ~F.col("whole"), F.col("la"))).over(before)).otherwise(F.min(F.when(F.col("old"), F.col("la"))).over(before))
    found = some.withColumn("lb", shortest).filter(F.col("new") & n.alike()).select(*KEYS)
    if n.long:
        concerned = rows.join(lacking.select(*scope).distinct(), scope, "left_semi")
        pairs = long_numbers(lacking, concerned, scope, n.percent)
        found = found.unionByName(_met(lacking, concerned, pairs, "a", "b")).unionByName(_met(concerned, lacking, pairs, "b", "a"))
    return found


def _met(new: DataFrame, old: DataFrame, pairs: DataFrame, a: str, b: str) -> DataFrame:
    """New invoices with an earlier old one whose number makes a pair with theirs."""
    scope = ["tenant_id", "who"]
    first = old.filter("old").groupBy(*scope, F.col("number").alias(b)).agg(F.min(F.struct(*ORDER)).alias("o_at"))
    met = new.filter("new").withColumn("at", F.struct(*ORDER)).withColumnRenamed("number", a).join(pairs, [*scope, a]).join(first, [*scope, b])
    return met.filter(_earlier()).select(*KEYS)


def could_be_one(x: str, y: str) -> Column:
    """Whether two printed names are alike enough to be one company's.

    Of m characters in all, a similarity of s percent means m (100 - s) / 100 insertions and deletions; the edit distance d, in compiled
    code, says that they are from d to 2 d, so that few names are compared by character.
    """
    ordered = lambda c: F.array_join(F.array_sort(F.split(F.col(c), " ")), " ")
    a, b = ordered(x), ordered(y)
    allowed, d = (F.length(x) + F.length(y)) * (100 - DIFFERENT_COMPANY_BELOW), F.levenshtein(a, b) * 100
    lengths = F.abs(F.length(x) - F.length(y)) * 100
    return F.when(lengths > allowed, False).when(d > allowed, False).when(2 * d <= allowed, True).otherwise(ratio_200(a, b) >= DIFFERENT_COMPANY_BELOW)


def _uncertain(keyed: DataFrame, n: Numbers) -> DataFrame:
    """Invoices with an earlier unlinked one of a like number whose supplier may be the same or not.

    A linked invoice looks for any of them, an unlinked one only for such without a name. One hit is enough, so no
    pairs of invoices are made.
    """
    scope = ["tenant_id"]
    linked = F.col("supplier_id").isNotNull()
    rows = keyed.withColumnRenamed("number_key", "number").filter(F.col("number") != "")
    unlinked = rows.filter(~linked & F.col("comparable")).groupBy("tenant_id", F.col("name").alias("o_name"), "number").agg(F.min(F.struct(*ORDER)).alias("at"))
    old = _as_old(unlinked.select("tenant_id", "number", "o_name", "at.*"))
    nameless = old.filter("o_name = ''").drop("o_name")
    known = rows.filter(linked).select("tenant_id", "number", *ORDER, "name")
    named = rows.filter(~linked & (F.col("name") != "")).select("tenant_id", "number", *ORDER)
    doubt = F.when((F.col("name") == "") | (F.col("o_name") == ""), True).when(F.col("name") == F.col("o_name"), False).otherwise(could_be_one("name", "o_name"))
    on = ["tenant_id", "variant"]
    found = with_like(n, known, old, scope, _received_before() & doubt).select(*KEYS)
    found = found.unionByName(with_like(n, named, nameless, scope, _received_before(), keys_of(n.variants(nameless, n.right, "l", "tenant_id"), on)).select(*KEYS))
    if n.long:
        for new, others, condition in ((known, old, doubt), (named, nameless, F.lit(True))):
            pairs = long_numbers(new, others, scope, n.percent)
            met = new.withColumnRenamed("number", "a").join(pairs, [*scope, "a"]).join(others.withColumnRenamed("number", "b"), [*scope, "b"])
            found = found.unionByName(met.filter(_received_before() & condition).select(*KEYS))
    return found


def check_duplicates(invoices: DataFrame, window_days: int = 7, similarity_min: int = 85) -> DataFrame:
    """The duplicate check of every invoice against the comparable ones received before it.

    In this order: no supplier or number to compare with is skipped; an equal number of the same supplier
    fails; so does a like number with equal currency and total and a near date; a like number where the
    soft rule lacks something, or where the supplier is uncertain, is skipped; so is what would pass while
    earlier invoices of the tenant are still being read. ``supplier_id`` is the linked record.
    """
    i = invoices.select(*KEYS, "supplier_id", "supplier_name", "invoice_number", "status", "created_at")
    keyed = written(_keyed(invoices), "duplicates-keyed")  # read many times over
    related = _related(keyed)
    numbers = keyed.select(F.col("number_key").alias("number"))
    n = Numbers(numbers, numbers, similarity_min)
    flag = lambda df, name: df.select(*KEYS, F.lit(name).alias("found"))
    findings = flag(_hard(keyed), "hard").unionByName(flag(_soft(related, n, window_days), "soft"))
    findings = findings.unionByName(flag(_unevaluable(related, n), "INCOMPLETE_FOR_SOFT_MATCH")).unionByName(flag(_uncertain(keyed, n), "SUPPLIER_UNCERTAIN"))
    findings = findings.groupBy(*KEYS).agg(F.collect_set("found").alias("found"))
    waiting = i.filter(F.col("status").isin(*PENDING)).groupBy("tenant_id").agg(F.min(F.struct(*ORDER)).alias("pending"))
    out = i.join(findings, KEYS, "left").join(waiting, "tenant_id", "left")
    has = lambda name: F.coalesce(F.array_contains("found", name), F.lit(False))
    nobody = F.col("supplier_id").isNull() & (name_key("supplier_name") == "")
    first = F.when(nobody, "NO_SUPPLIER").when(number_key("invoice_number") == "", "NO_INVOICE_NUMBER")
    doubt = (
        F.when(has("INCOMPLETE_FOR_SOFT_MATCH"), "INCOMPLETE_FOR_SOFT_MATCH").when(has("SUPPLIER_UNCERTAIN"), "SUPPLIER_UNCERTAIN")
        .when(F.coalesce(F.col("pending") < F.struct(*ORDER), F.lit(False)), "EARLIER_INVOICES_STILL_PENDING")
    )
    fails = has("hard") | has("soft")
    reason = F.when(first.isNotNull(), first).when(~fails, doubt)
    outcome = F.when(first.isNotNull(), "skipped").when(fails, "fail").when(doubt.isNotNull(), "skipped").otherwise("pass")
    return out.select(*KEYS, F.lit("POSSIBLE_DUPLICATE").alias("check_code"), outcome.alias("outcome"), reason.alias("reason"))
