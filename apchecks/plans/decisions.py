"""Queries of exceptions, routing, queue, hand-off and evaluation, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify, duplicates, handoff, matching, operations, validate
from ..sources.ap_view import WORLD_SQL, ApView
from ..sources.shared import derived_once
from . import checks

LIMITS = {"USD": 20_000_000, "EUR": 15_000_000}
EXPECTED = (
    "LINE_MATH_MISMATCH", "TOTAL_MISMATCH", "TAX_MISMATCH", "INVALID_DATE", "CURRENCY_MISMATCH", "UNKNOWN_SUPPLIER",
    "BANK_DETAILS_CHANGED", "POSSIBLE_DUPLICATE", "NO_PO", "PO_NOT_FOUND", "PRICE_VARIANCE", "QTY_VARIANCE", "RECEIPT_MISSING",
    "QTY_NOT_RECEIVED", "PO_OVERBILLED",
)
TAX_TYPES = {0: "EXEMPTEXPENSES", 500: "INPUT5", 800: "INPUT8", 2000: "INPUT20"}
_CODES = {
    "LINE_MATH_MISMATCH": "line_math", "TOTAL_MISMATCH": "totals", "TAX_MISMATCH": "tax", "INVALID_DATE": "dates",
    "CURRENCY_MISMATCH": "currency", "UNKNOWN_SUPPLIER": "supplier_resolution", "BANK_DETAILS_CHANGED": "bank",
}


def linked_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices with what their suppliers resolve to, kept once per session; ``supplier_id`` is the resolved record."""
    v = ApView(spark, sf_dir)
    resolved = lambda: validate.resolve_suppliers(v.invoices, v.suppliers).withColumn("supplier_id", F.col("s_supplier_id"))
    return derived_once(spark, sf_dir, "ap-linked", resolved)


def check_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fifteen checks of every invoice; kept once per session, since all decisions read it.

    Suppliers are linked first; duplicates and orders are then those of the linked supplier.
    """
    v = ApView(spark, sf_dir)
    linked = linked_invoices(spark, sf_dir)
    parts = {
        "validated": lambda: validate.all_checks(validate.with_lines(linked, v.invoice_lines), checks.TODAY),
        "duplicates": lambda: duplicates.check_duplicates(linked),
        "matched": lambda: matching.match_checks(linked, v.purchase_orders, v.invoice_lines, v.po_lines, v.receipt_lines),
    }
    # Each part is planned and run by itself: in one plan their exchanges and small sides would all be held by the driver at once.
    kept = [derived_once(spark, sf_dir, f"ap-checks-{name}", lambda build=build: build().drop("tenant_id")) for name, build in parts.items()]
    return reduce(DataFrame.unionByName, kept)


def exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.exceptions(check_results(spark, sf_dir))


def _written(results: DataFrame, invoices: DataFrame) -> DataFrame:
    """The results that a run has written that stopped before it matched invoices still being read."""
    waiting = invoices.filter("status in ('received', 'failed')").select("invoice_id", F.lit(True).alias("waiting"))
    r = results.join(waiting, "invoice_id", "left")
    return r.filter(F.col("waiting").isNull() | F.col("check_code").isin(*_CODES)).drop("waiting")


def missing_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    invoices = ApView(spark, sf_dir).invoices
    return classify.missing_checks(_written(check_results(spark, sf_dir), invoices), invoices, EXPECTED)


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = check_results(spark, sf_dir)
    invoices = ApView(spark, sf_dir).invoices
    missing = classify.missing_checks(results, invoices, EXPECTED)
    return classify.route(invoices, classify.exceptions(results), LIMITS, missing)


def routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir).select("invoice_id", "status", "route", "reasons", "open_exceptions", "worst")


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.review_queue(_routed(spark, sf_dir), 200)


def exception_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = exceptions(spark, sf_dir)
    return e.groupBy("code", "severity", "unchecked").agg(F.count("*").alias("n"), F.count_distinct("invoice_id").alias("invoices"))


def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _routed(spark, sf_dir)
    clear = F.count_if(F.col("route") == "straight_through")
    return r.groupBy("tenant_id").agg(
        F.count("*").alias("processed"), clear.alias("straight_through"), F.round(clear / F.count("*"), 6).alias("touchless"),
        (clear * 1200).alias("saved_minor"), F.sum("open_exceptions").alias("open_exceptions"),
    )


def draft_bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = ApView(spark, sf_dir)
    return handoff.map_bills(v.invoices, v.invoice_lines, TAX_TYPES)


def _contacts(v: ApView) -> tuple[DataFrame, DataFrame]:
    s = v.suppliers
    key = F.col("supplier_id")
    suppliers = s.select("supplier_id", "name", F.when(key % 4 != 0, F.col("tax_id")).alias("tax_id"), F.when(key % 9 == 0, key * 10).alias("linked_contact_id"))
    tax = F.when(key % 5 == 0, None).when(key % 7 == 0, F.concat(F.lit("TX-9"), key.cast("string"))).otherwise(F.col("tax_id"))
    first = s.filter(key % 11 != 0).select((key * 10).alias("contact_id"), F.lower("name").alias("name"), tax.alias("tax_number"), (key % 13 != 0).alias("active"))
    second = s.filter(key % 6 == 0).select((key * 10 + 1).alias("contact_id"), F.upper("name").alias("name"), F.lit(None).cast("string").alias("tax_number"), F.lit(True).alias("active"))
    return suppliers, first.unionByName(second)


def contact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handoff.match_contacts(*_contacts(ApView(spark, sf_dir)))


def approval_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested approvals and rejections (by remainder) against status and open exceptions."""
    r = _routed(spark, sf_dir)
    status = F.when(F.col("invoice_id") % 17 == 0, "approved").otherwise(F.col("status"))
    note = F.when(F.col("invoice_id") % 5 == 0, " . ").when(F.col("invoice_id") % 5 == 1, None).otherwise("wrong goods")
    wants_reject = F.col("invoice_id") % 2 == 1
    closed = ~status.isin("cleared", "needs_review")
    no_words = ~F.coalesce(note, F.lit("")).rlike(r"[\p{L}\p{N}]")
    problem = F.when(closed, "wrong_status").when(wants_reject & no_words, "note_required").when(~wants_reject & (F.col("open_exceptions") > 0), "open_exceptions")
    return r.select("invoice_id", F.when(wants_reject, "reject").otherwise("approve").alias("action"), problem.alias("problem"))


def latest_rule_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = ApView(spark, sf_dir).base
    rows = b.groupBy(F.col("ok").alias("invoice_id"), F.concat(F.lit("C"), (F.col("line_no") % 3).cast("string")).alias("check_code"), (1 + F.col("q") % 12).alias("v")).agg(
        F.max(F.when(F.col("disc") > 5, "fail").otherwise("pass")).alias("outcome")
    )
    return operations.latest_versions(rows.select("invoice_id", "check_code", F.concat(F.lit("v"), F.col("v").cast("string")).alias("rule_version"), "outcome"))


QUERIES = {
    f.__name__: f
    for f in (
        check_results, exceptions, missing_checks, routing, review_queue, exception_counts, dashboard, draft_bills, contact_match,
        approval_gate, latest_rule_version,
    )
}

_REASON = {
    "LINE_MATH_MISMATCH": "NULL", "TOTAL_MISMATCH": "NULL", "TAX_MISMATCH": "reason", "INVALID_DATE": "reasons",
    "CURRENCY_MISMATCH": "CASE WHEN supplier_currency IS NULL THEN 'UNKNOWN_SUPPLIER' END", "UNKNOWN_SUPPLIER": "'NOTHING_TO_MATCH'",
    "BANK_DETAILS_CHANGED": "reason",
}
_RESULTS = " UNION ALL ".join(
    f"SELECT invoice_id, '{code}' AS check_code, outcome, CASE WHEN outcome = 'skipped' THEN CAST({_REASON[code]} AS VARCHAR) END AS reason FROM ({checks.ORACLES[name]})"
    for code, name in _CODES.items()
)
#: Invoices with the supplier record that their printed name and tax id resolve to.
_LINKED = checks._RESOLVED + ", linked AS (SELECT inv.* REPLACE (facts.s_id AS supplier_id) FROM inv JOIN facts USING (invoice_id))"


def _of_linked(sql: str) -> str:
    """SQL after the world's tables, reading linked invoices."""
    return sql.removeprefix(WORLD_SQL).replace("FROM inv", "FROM linked inv").replace("JOIN inv", "JOIN linked inv")


_DUPLICATES = (
    _LINKED.replace("WITH sup", "WITH RECURSIVE sup", 1)
    + f""", c0 AS (
  SELECT *, coalesce({checks._KEY.format("supplier_name")}, '') AS nk, lower(coalesce(supplier_name, '')) AS lw, {checks._NUM.format("invoice_number")} AS k,
    coalesce(total_minor <> 0 AND invoice_date IS NOT NULL AND currency <> '', false) AS whole, status NOT IN {checks._UNREAD} AS old FROM linked
), c1 AS (
  SELECT *, {checks._CANON.format("k")} AS c, regexp_replace(k, '[^0-9]', '', 'g') AS d, array_to_string(list_sort(string_split(nk, ' ')), ' ') AS sk FROM c0
), lk AS (SELECT * FROM c1 WHERE k <> '' AND (supplier_id IS NOT NULL OR nk <> ''))
, ol AS (SELECT * FROM c1 WHERE k <> '' AND old)
, met AS (
  SELECT a.invoice_id AS i, b.invoice_id AS o, true AS same FROM lk a JOIN ol b ON a.tenant_id = b.tenant_id AND a.supplier_id = b.supplier_id AND (b.created_at, b.invoice_id) < (a.created_at, a.invoice_id)
  UNION ALL SELECT a.invoice_id, b.invoice_id, true FROM lk a JOIN ol b ON a.tenant_id = b.tenant_id AND b.supplier_id IS NULL AND a.nk = b.nk AND a.nk <> '' AND (b.created_at, b.invoice_id) < (a.created_at, a.invoice_id)
  UNION ALL SELECT a.invoice_id, b.invoice_id, true FROM lk a JOIN ol b ON a.tenant_id = b.tenant_id AND a.supplier_id IS NULL AND b.supplier_id IS NOT NULL AND a.lw = b.lw AND (b.created_at, b.invoice_id) < (a.created_at, a.invoice_id)
  UNION ALL SELECT a.invoice_id, b.invoice_id, false FROM lk a JOIN ol b ON a.tenant_id = b.tenant_id AND b.supplier_id IS NULL AND (a.supplier_id IS NOT NULL OR b.nk = '') AND (a.nk <> b.nk OR a.nk = '')
    AND (b.created_at, b.invoice_id) < (a.created_at, a.invoice_id)
), near AS (
  SELECT i, o, same, a.c = b.c AS equal, a.k AS ka, b.k AS kb, a.c AS ca, b.c AS cb, a.d AS da, b.d AS db, a.sk AS na, b.sk AS nb
  FROM met JOIN c1 a ON a.invoice_id = i JOIN c1 b ON b.invoice_id = o
  WHERE a.c = b.c OR levenshtein(a.k, b.k) * 20 <= 3 * (len(a.k) + len(b.k)) OR levenshtein(a.c, b.c) * 20 <= 3 * (len(a.c) + len(b.c))
    OR (len(a.d) >= 4 AND len(b.d) >= 4 AND levenshtein(a.d, b.d) * 20 <= 3 * (len(a.d) + len(b.d)))
), texts AS (SELECT ka AS a, kb AS b FROM near UNION SELECT ca, cb FROM near UNION SELECT da, db FROM near UNION SELECT na, nb FROM near WHERE NOT same)
, cells AS (
  SELECT a, b, 0 AS i, list_transform(range(0, len(b) + 1), lambda z: 0::BIGINT) AS r FROM texts
  UNION ALL
  SELECT a, b, i + 1, list_reduce(list_concat([[0::BIGINT]], list_transform(range(1, len(b) + 1), lambda j: [j])),
    lambda acc, j: list_append(acc, greatest(acc[len(acc)], r[j[1] + 1], CASE WHEN substr(b, j[1], 1) = substr(a, i + 1, 1) THEN r[j[1]] + 1 ELSE 0 END)))
  FROM cells WHERE i < len(a)
), ratio AS (SELECT a, b, CASE WHEN len(a) + len(b) = 0 THEN 100.0 ELSE 200.0 * r[len(r)] / (len(a) + len(b)) END::DOUBLE AS v FROM cells WHERE i = len(a))
, sim AS (
  SELECT near.*, greatest(r1.v, r2.v, CASE WHEN len(da) >= 4 AND len(db) >= 4 THEN r3.v ELSE 0 END) >= 85 AS alike, na = '' OR nb = '' OR r4.v >= 60 AS doubt
  FROM near JOIN ratio r1 ON r1.a = ka AND r1.b = kb JOIN ratio r2 ON r2.a = ca AND r2.b = cb JOIN ratio r3 ON r3.a = da AND r3.b = db LEFT JOIN ratio r4 ON r4.a = na AND r4.b = nb
), told AS (
  SELECT i, bool_or(same AND equal) AS hard,
    bool_or(same AND alike AND a.whole AND b.whole AND upper(a.currency) = upper(b.currency) AND a.total_minor = b.total_minor AND abs(a.invoice_date - b.invoice_date) <= 7) AS soft,
    bool_or(same AND alike AND NOT (a.whole AND b.whole)) AS lacking, bool_or(NOT same AND alike AND doubt) AS unsure
  FROM sim JOIN c1 a ON a.invoice_id = i JOIN c1 b ON b.invoice_id = o GROUP BY i
), wait AS (SELECT tenant_id, min((created_at, invoice_id)) AS first FROM linked WHERE status IN ('received', 'extracting', 'extracted') GROUP BY 1)
, said AS (
  SELECT invoice_id, CASE WHEN supplier_id IS NULL AND nk = '' THEN 'NO_SUPPLIER' WHEN k = '' THEN 'NO_INVOICE_NUMBER' END AS why, coalesce(hard OR soft, false) AS found,
    CASE WHEN lacking THEN 'INCOMPLETE_FOR_SOFT_MATCH' WHEN unsure THEN 'SUPPLIER_UNCERTAIN' WHEN wait.first < (created_at, invoice_id) THEN 'EARLIER_INVOICES_STILL_PENDING' END AS later
  FROM c1 LEFT JOIN told ON i = invoice_id LEFT JOIN wait ON wait.tenant_id = c1.tenant_id
)
SELECT invoice_id, 'POSSIBLE_DUPLICATE' AS check_code, CASE WHEN why IS NOT NULL THEN 'skipped' WHEN found THEN 'fail' WHEN later IS NOT NULL THEN 'skipped' ELSE 'pass' END AS outcome,
  coalesce(why, CASE WHEN NOT found THEN later END) AS reason FROM said"""
)
_MATCHED = (
    _LINKED.replace("WITH sup", "WITH RECURSIVE sup", 1)
    + _of_linked(checks._FOUND)
    + _of_linked(checks._INFERRED.format(tolerance=200))
    + _of_linked(f""", hd AS (
  SELECT invoice_id, CASE WHEN reason IS NULL THEN o_id END AS mp, CASE WHEN reason = 'AMBIGUOUS_PO' THEN 'skipped' ELSE 'pass' END AS np, CASE WHEN reason = 'AMBIGUOUS_PO' THEN reason END AS npr,
    CASE WHEN reason IS NULL OR reason = 'AMBIGUOUS_PO' THEN 'pass' WHEN reason = 'SUPPLIER_UNKNOWN' THEN 'skipped' ELSE 'fail' END AS nf, CASE WHEN reason = 'SUPPLIER_UNKNOWN' THEN reason END AS nfr FROM found
  UNION ALL SELECT invoice_id, CASE WHEN candidates = 1 THEN first_po_id END, CASE WHEN reason = 'NO_OPEN_PO_WITH_MATCHING_TOTAL' THEN 'fail' ELSE 'skipped' END,
    CASE WHEN reason <> 'NO_OPEN_PO_WITH_MATCHING_TOTAL' THEN reason END, 'pass', NULL FROM inferred
), ln AS (
  SELECT invoice_id, count(*) AS n, CASE WHEN count(amount_minor) = count(*) THEN sum(amount_minor) END AS amt, bool_or(coalesce(qty < 0, false) OR coalesce(amount_minor < 0, false)) AS neg FROM il GROUP BY 1
), a0 AS (
  SELECT inv.tenant_id, inv.invoice_id, inv.status, inv.created_at, hd.*, po.total_minor AS po_total, coalesce(ln.n, 0) AS n_lines, coalesce(inv.subtotal_minor, amt) AS bill,
    coalesce(inv.subtotal_minor < 0, false) OR coalesce(neg, false) AS credit,
    CASE WHEN inv.currency = po.currency THEN NULL WHEN inv.currency IS NULL THEN 'CURRENCY_UNKNOWN' ELSE 'CURRENCY_DIFFERS_FROM_PO' END AS cur_reason,
    EXISTS (SELECT 1 FROM rec WHERE rec.po_id = mp) AS has_receipt
  FROM inv JOIN hd ON hd.invoice_id = inv.invoice_id LEFT JOIN po ON po.po_id = mp AND po.tenant_id = inv.tenant_id LEFT JOIN ln ON ln.invoice_id = inv.invoice_id
), b0_ AS (SELECT il.invoice_id, il.line_no, il.qty, il.unit_price_minor, il.amount_minor, il.description, mp, status, created_at, {checks._NUM.format("il.sku")} AS k FROM il JOIN a0 ON a0.invoice_id = il.invoice_id WHERE mp IS NOT NULL AND NOT credit)
, c0 AS (SELECT * FROM b0_ WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY invoice_id, k ORDER BY line_no) = 1)
, s0 AS (SELECT po_id, {checks._NUM.format("sku")} AS k, min(po_line_id) AS pl, min(q) AS pq, min(unit_price_minor) AS pu FROM pol GROUP BY ALL HAVING count(*) = 1)
, c_l AS (SELECT * FROM b0_)
, c_p AS (SELECT c0.*, pl, pq, pu FROM c0 JOIN s0 ON s0.po_id = mp AND s0.k = c0.k)
{checks.REST_SQL}
, c_a AS (
  SELECT invoice_id, line_no, qty, unit_price_minor, status, created_at, pl, pq, pu FROM c_p
  UNION ALL SELECT l.invoice_id, l.line_no, l.qty, l.unit_price_minor, l.status, l.created_at, rest.pl, pol.q, pol.unit_price_minor FROM rest JOIN c_l l ON l.invoice_id = rest.invoice_id AND l.line_no = rest.line_no JOIN pol ON pol.po_line_id = rest.pl
), pr AS (
  SELECT c_a.*, qty + coalesce(sum(qty) FILTER (status NOT IN ('failed', 'rejected', 'received', 'extracting', 'extracted')) OVER (PARTITION BY pl ORDER BY created_at, invoice_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS billed
  FROM c_a
), rv AS (SELECT po_line_id, sum(qty_received) AS got FROM rec GROUP BY 1)
, g AS (
  SELECT invoice_id, count(*) AS n, count(*) FILTER (unit_price_minor IS NULL) AS up, count(*) FILTER (qty IS NULL) AS uq, count(*) FILTER (abs(unit_price_minor - pu) * 10000 > pu * 200) AS bp,
    count(*) FILTER (billed > pq) AS bq, count(*) FILTER (billed > coalesce(got, 0)) AS br FROM pr LEFT JOIN rv ON po_line_id = pl GROUP BY 1
), w0 AS (
  SELECT a0.*, coalesce(n, 0) AS n_pairs, coalesce(up, 0) AS up, coalesce(uq, 0) AS uq, coalesce(bp, 0) AS bp, coalesce(bq, 0) AS bq, coalesce(br, 0) AS br,
    CASE WHEN NOT credit AND cur_reason IS NULL THEN bill END AS billed FROM a0 LEFT JOIN g ON g.invoice_id = a0.invoice_id
), w1 AS (
  SELECT w0.*, coalesce(wait.first < (created_at, invoice_id), false) AS waits, coalesce(sum(billed) FILTER (status NOT IN ('failed', 'rejected', 'received', 'extracting', 'extracted')) OVER w, 0) AS before_minor,
    coalesce(sum(CASE WHEN billed IS NULL THEN 1 ELSE 0 END + uq) FILTER (status NOT IN ('failed', 'rejected', 'received', 'extracting', 'extracted')) OVER w, 0) AS unknown,
    CASE WHEN mp IS NULL THEN 'NO_PO' WHEN credit THEN 'CREDIT_NOTE' END AS lead
  FROM w0 LEFT JOIN (SELECT tenant_id, min((created_at, invoice_id)) AS first FROM inv WHERE status IN ('received', 'extracting', 'extracted') GROUP BY 1) wait ON wait.tenant_id = w0.tenant_id
  WINDOW w AS (PARTITION BY w0.tenant_id, mp ORDER BY created_at, invoice_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), z0 AS (
  SELECT invoice_id, 'NO_PO' AS check_code, np AS outcome, npr AS reason, false AS cum, unknown, waits FROM w1
  UNION ALL SELECT invoice_id, 'PO_NOT_FOUND', nf, nfr, false, unknown, waits FROM w1
  UNION ALL SELECT invoice_id, 'PRICE_VARIANCE', NULL, CASE WHEN lead IS NOT NULL THEN lead WHEN n_lines = 0 THEN 'NO_LINES' WHEN cur_reason IS NOT NULL THEN cur_reason WHEN bp > 0 THEN 'fail' WHEN up > 0 THEN 'UNREADABLE_LINE' WHEN n_pairs = 0 THEN 'NO_MATCHED_LINES' END, false, unknown, waits FROM w1
  UNION ALL SELECT invoice_id, 'QTY_VARIANCE', NULL, CASE WHEN lead IS NOT NULL THEN lead WHEN n_lines = 0 THEN 'NO_LINES' WHEN bq + n_lines - n_pairs > 0 THEN 'fail' WHEN uq > 0 THEN 'UNREADABLE_LINE' WHEN n_pairs = 0 THEN 'NO_MATCHED_LINES' END, true, unknown, waits FROM w1
  UNION ALL SELECT invoice_id, 'RECEIPT_MISSING', NULL, CASE WHEN lead IS NOT NULL THEN lead WHEN NOT has_receipt THEN 'fail' END, false, unknown, waits FROM w1
  UNION ALL SELECT invoice_id, 'QTY_NOT_RECEIVED', NULL, CASE WHEN lead IS NOT NULL THEN lead WHEN n_lines = 0 THEN 'NO_LINES' WHEN NOT has_receipt THEN 'NO_RECEIPT' WHEN br > 0 THEN 'fail' WHEN uq > 0 THEN 'UNREADABLE_LINE' WHEN n_pairs = 0 THEN 'NO_MATCHED_LINES' END, true, unknown, waits FROM w1
  UNION ALL SELECT invoice_id, 'PO_OVERBILLED', NULL, CASE WHEN lead IS NOT NULL THEN lead WHEN cur_reason IS NOT NULL THEN cur_reason WHEN bill IS NULL THEN 'NO_SUBTOTAL' WHEN before_minor + bill > po_total THEN 'fail' END, true, unknown, waits FROM w1
), z1 AS (
  SELECT invoice_id, check_code, CASE WHEN outcome IS NOT NULL THEN outcome WHEN reason = 'fail' THEN 'fail' WHEN reason IS NOT NULL THEN 'skipped' WHEN cum AND (waits OR unknown > 0) THEN 'skipped' ELSE 'pass' END AS outcome,
    CASE WHEN reason = 'fail' THEN NULL WHEN reason IS NOT NULL THEN reason WHEN outcome IS NULL AND cum AND waits THEN 'EARLIER_INVOICES_STILL_PENDING' WHEN outcome IS NULL AND cum AND unknown > 0 THEN 'EARLIER_BILLING_UNKNOWN' END AS reason FROM z0
)
SELECT invoice_id, check_code, outcome, reason FROM z1""")
)
_RESULTS = f"{_RESULTS} UNION ALL SELECT * FROM ({_DUPLICATES}) UNION ALL SELECT * FROM ({_MATCHED})"
_TAXONOMY = "VALUES " + ", ".join(f"({i}, '{c}', '{s}', '{w}', '{f}')" for i, (c, s, w, f) in enumerate(classify.TAXONOMY))
_WORDS = "VALUES " + ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in classify.REASON_WORDS.items())
_EXC = f"""WITH cr AS MATERIALIZED ({_RESULTS}), tx(ord, code, sev, subject, fix) AS ({_TAXONOMY}), rw(reason, words) AS ({_WORDS})
, dv(reason, root) AS (VALUES ('UNKNOWN_SUPPLIER', 'UNKNOWN_SUPPLIER'), ('NO_PO', 'NO_PO'), ('NO_PO', 'PO_NOT_FOUND'), ('NO_RECEIPT', 'RECEIPT_MISSING'))
, raised AS (
  SELECT invoice_id, check_code FROM cr WHERE outcome = 'fail' OR (outcome = 'skipped' AND (coalesce(reason, '') NOT IN (SELECT reason FROM dv) OR (reason, check_code) IN (SELECT (reason, root) FROM dv)))
), ex0 AS (
  SELECT cr.*, ord FROM cr JOIN tx ON tx.code = check_code WHERE outcome <> 'pass' AND NOT (outcome = 'skipped' AND (coalesce(cr.reason, ''), check_code) NOT IN (SELECT (reason, root) FROM dv)
    AND EXISTS (SELECT 1 FROM raised r JOIN dv ON dv.root = r.check_code WHERE dv.reason = cr.reason AND r.invoice_id = cr.invoice_id))
), ex AS (
  SELECT * FROM ex0 QUALIFY NOT (outcome = 'skipped' AND coalesce(reason, '') = 'CREDIT_NOTE')
    OR ord = min(ord) FILTER (outcome = 'skipped' AND reason = 'CREDIT_NOTE') OVER (PARTITION BY invoice_id)
), exs AS (
  SELECT invoice_id, check_code AS code, CASE WHEN outcome = 'skipped' THEN 'review' ELSE sev END AS severity, outcome = 'skipped' AS unchecked,
    CASE WHEN outcome = 'skipped' THEN upper(subject[1]) || subject[2:] || ' could not be checked (' || CASE WHEN ex.reason IS NULL THEN 'no reason was recorded' ELSE coalesce(words, 'unrecognised reason ' || ex.reason) END
      || '), so a person needs to look at it.' END AS unchecked_words, fix AS suggested_fix
  FROM ex JOIN tx ON tx.code = check_code LEFT JOIN rw ON rw.reason = ex.reason
)
"""
_INV = f"(SELECT * FROM ({WORLD_SQL} SELECT * FROM inv))"
_ROUTED = (
    _EXC
    + f""", e AS (
  SELECT invoice_id, count(*) AS open_exceptions, bool_or(code = 'BANK_DETAILS_CHANGED' AND NOT unchecked) AS bank, max(CASE severity WHEN 'block' THEN 3 WHEN 'review' THEN 2 ELSE 1 END) AS worst FROM exs GROUP BY 1
), i AS (
  SELECT inv.tenant_id, inv.invoice_id, created_at, total_minor, coalesce(open_exceptions, 0) AS open_exceptions, coalesce(worst, 0) AS worst, bank,
    CASE currency WHEN 'USD' THEN {LIMITS["USD"]} WHEN 'EUR' THEN {LIMITS["EUR"]} END AS lim FROM {_INV} inv LEFT JOIN e USING (invoice_id)
), q AS (
  SELECT *, array_to_string(list_filter([CASE WHEN bank THEN 'BANK_DETAILS_CHANGED' END, CASE WHEN worst >= 2 THEN 'OPEN_EXCEPTIONS' END,
    CASE WHEN total_minor IS NULL THEN 'NO_TOTAL' WHEN total_minor < 0 THEN 'CREDIT_NOTE' WHEN total_minor = 0 THEN 'ZERO_TOTAL' END,
    CASE WHEN lim IS NULL THEN 'NO_LIMIT' WHEN total_minor > lim THEN 'ABOVE_LIMIT' END], lambda x: x IS NOT NULL), ',') AS reasons FROM i
), routed AS (
  SELECT *, CASE WHEN reasons = '' THEN 'cleared' ELSE 'needs_review' END AS status, CASE WHEN reasons = '' THEN 'straight_through' ELSE 'review' END AS route FROM q
)
"""
)

ORACLES = {
    "check_results": _RESULTS,
    "exceptions": _EXC + "SELECT * FROM exs",
    "missing_checks": f"WITH cr AS MATERIALIZED ({_RESULTS}) SELECT inv.invoice_id, c.code AS check_code FROM {_INV} inv, (VALUES "
    + ", ".join(f"('{c}')" for c in EXPECTED)
    + ") c(code) WHERE (inv.status IN ('received', 'failed') AND c.code NOT IN ("
    + ", ".join(f"'{c}'" for c in _CODES)
    + ")) OR NOT EXISTS (SELECT 1 FROM cr WHERE cr.invoice_id = inv.invoice_id AND cr.check_code = c.code)",
    "routing": _ROUTED + "SELECT invoice_id, status, route, reasons, open_exceptions, worst FROM routed",
    "review_queue": _ROUTED
    + "SELECT invoice_id, worst, open_exceptions, reasons FROM routed WHERE status = 'needs_review' ORDER BY worst DESC, created_at, invoice_id LIMIT 200",
    "exception_counts": _EXC + "SELECT code, severity, unchecked, count(*) AS n, count(DISTINCT invoice_id) AS invoices FROM exs GROUP BY ALL",
    "dashboard": _ROUTED
    + """SELECT tenant_id, count(*) AS processed, count(*) FILTER (route = 'straight_through') AS straight_through,
  round(count(*) FILTER (route = 'straight_through') / count(*), 6) AS touchless, count(*) FILTER (route = 'straight_through') * 1200 AS saved_minor,
  CAST(sum(open_exceptions) AS BIGINT) AS open_exceptions FROM routed GROUP BY 1""",
    "approval_gate": _ROUTED
    + """SELECT invoice_id, CASE WHEN invoice_id % 2 = 1 THEN 'reject' ELSE 'approve' END AS action, CASE WHEN invoice_id % 17 = 0 THEN 'wrong_status'
  WHEN invoice_id % 2 = 1 AND invoice_id % 5 IN (0, 1) THEN 'note_required' WHEN invoice_id % 2 = 0 AND open_exceptions > 0 THEN 'open_exceptions' END AS problem FROM routed""",
    "draft_bills": WORLD_SQL
    + """, g AS (
  SELECT *, coalesce(tax_rate_bp IN (0, 500, 800, 2000), false) AS known, trim(coalesce(description, '')) = '' AS no_text FROM il
), p AS (
  SELECT invoice_id, count(*) AS n, count(*) FILTER (NOT no_text AND amount_minor IS NOT NULL AND known) AS n_good, bool_or(no_text) AS t, bool_or(amount_minor IS NULL) AS a, bool_or(NOT known) AS r,
    sum(amount_minor) FILTER (NOT no_text AND known) AS ls, sum(CAST(round(CAST(amount_minor AS DECIMAL(18, 0)) * tax_rate_bp / 10000, 0) AS BIGINT)) FILTER (NOT no_text AND known) AS ts,
    count(*) FILTER (NOT no_text AND known AND qty * unit_price_minor = amount_minor) AS wq FROM g GROUP BY 1
), x AS (
  SELECT inv.*, p.*, total_minor IS NOT NULL AS have, n_good = n AS whole, total_minor IS NOT NULL AND (subtotal_minor + tax_minor <> total_minor OR (n_good = n AND ls <> subtotal_minor)) AS mm
  FROM inv JOIN p USING (invoice_id)
), y AS (
  SELECT *, array_to_string(list_filter([CASE WHEN invoice_number IS NULL THEN 'INVOICE_NUMBER_MISSING' END, CASE WHEN invoice_date IS NULL THEN 'INVOICE_DATE_MISSING' END,
    CASE WHEN currency IS NULL THEN 'CURRENCY_UNSUPPORTED' END, CASE WHEN t THEN 'LINE_DESCRIPTION_MISSING' END, CASE WHEN a THEN 'LINE_AMOUNT_MISSING' END, CASE WHEN r THEN 'TAX_MAPPING_MISSING' END,
    CASE WHEN NOT have THEN 'TOTALS_MISSING' END, CASE WHEN have AND (total_minor <= 0 OR subtotal_minor <= 0) THEN 'NOT_A_BILL' END, CASE WHEN mm THEN 'TOTALS_MISMATCH' END,
    CASE WHEN have AND NOT mm AND whole AND ts <> tax_minor THEN 'TAX_MISMATCH' END], lambda z: z IS NOT NULL), ',') AS problems FROM x
)
SELECT invoice_id, problems = '' AS ready, problems, CASE WHEN problems = '' THEN n END AS bill_lines, CASE WHEN problems = '' THEN wq END AS lines_with_quantity,
  CASE WHEN problems = '' THEN total_minor END AS total_minor FROM y""",
    "contact_match": WORLD_SQL
    + f""", s AS (
  SELECT supplier_id, CASE WHEN supplier_id % 9 = 0 THEN supplier_id * 10 END AS linked, CASE WHEN supplier_id % 4 <> 0 THEN replace(tax_id, '-', '') ELSE '' END AS want, {checks._KEY.format("name")} AS key FROM sup
), c AS (
  SELECT supplier_id * 10 AS contact_id, {checks._KEY.format("name")} AS c_name, CASE WHEN supplier_id % 5 = 0 THEN '' WHEN supplier_id % 7 = 0 THEN 'TX9' || supplier_id ELSE replace(tax_id, '-', '') END AS c_tax
  FROM sup WHERE supplier_id % 11 <> 0 AND supplier_id % 13 <> 0
  UNION ALL SELECT supplier_id * 10 + 1, {checks._KEY.format("name")}, '' FROM sup WHERE supplier_id % 6 = 0
), f AS (
  SELECT s.*, (SELECT min(c_tax) FROM c WHERE contact_id = linked) AS l_tax, (SELECT count(*) FROM c WHERE contact_id = linked) AS nl,
    (SELECT count(*) FROM c WHERE want <> '' AND c_tax = want) AS nt, (SELECT min(contact_id) FROM c WHERE want <> '' AND c_tax = want) AS ct,
    (SELECT count(*) FROM c WHERE c_name = key) AS nn, (SELECT min(contact_id) FROM c WHERE c_name = key) AS cn, (SELECT arg_min(c_tax, contact_id) FROM c WHERE c_name = key) AS n_tax FROM s
), g AS (
  SELECT *, CASE WHEN linked IS NOT NULL AND nl = 0 THEN 'CONTACT_NOT_FOUND' WHEN linked IS NOT NULL AND want <> '' AND l_tax NOT IN ('', want) THEN 'CONTACT_CONFLICT' WHEN linked IS NOT NULL THEN NULL
    WHEN nt > 1 THEN 'CONTACT_AMBIGUOUS' WHEN nt = 1 THEN NULL WHEN nn > 1 THEN 'CONTACT_AMBIGUOUS' WHEN nn = 0 THEN 'CONTACT_NOT_FOUND' WHEN want <> '' AND n_tax NOT IN ('', want) THEN 'CONTACT_CONFLICT' END AS problem FROM f
)
SELECT supplier_id, CASE WHEN problem IS NULL THEN CASE WHEN linked IS NOT NULL THEN linked WHEN nt = 1 THEN ct ELSE cn END END AS contact_id,
  CASE WHEN problem IS NULL THEN CASE WHEN linked IS NOT NULL THEN 'link' WHEN nt = 1 THEN 'tax_id' ELSE 'name' END END AS matched_by, problem FROM g""",
    "latest_rule_version": WORLD_SQL
    + """, r AS (SELECT ok AS invoice_id, 'C' || (line_no % 3) AS check_code, 1 + q % 12 AS v, max(CASE WHEN disc > 5 THEN 'fail' ELSE 'pass' END) AS outcome FROM base GROUP BY ALL)
SELECT invoice_id, check_code, 'v' || v AS rule_version, outcome FROM r QUALIFY row_number() OVER (PARTITION BY invoice_id, check_code ORDER BY v DESC) = 1""",
}
