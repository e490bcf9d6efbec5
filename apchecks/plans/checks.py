"""Queries of the validation, matching and duplicate checks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import duplicates, matching, validate
from ..sources.ap_view import WORLD_SQL, ApView

TODAY = "2001-09-01"


def _facts(v: ApView) -> DataFrame:
    return validate.with_lines(validate.resolve_suppliers(v.invoices, v.suppliers), v.invoice_lines)


def _ids(df: DataFrame) -> DataFrame:
    return df.drop("tenant_id")


def supplier_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = ApView(spark, sf_dir)
    return _ids(validate.check_supplier(validate.resolve_suppliers(v.invoices, v.suppliers)))


def line_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = ApView(spark, sf_dir)
    return _ids(validate.check_line_math(validate.with_lines(v.invoices, v.invoice_lines)))


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = ApView(spark, sf_dir)
    return _ids(validate.check_totals(validate.with_lines(v.invoices, v.invoice_lines)))


def tax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(validate.check_tax(_facts(ApView(spark, sf_dir))))


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(validate.check_dates(ApView(spark, sf_dir).invoices, TODAY))


def currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = ApView(spark, sf_dir)
    return _ids(validate.check_currency(validate.resolve_suppliers(v.invoices, v.suppliers)))


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = ApView(spark, sf_dir)
    return _ids(validate.check_bank(validate.resolve_suppliers(v.invoices, v.suppliers)))


def duplicate_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(duplicates.hard_duplicates(ApView(spark, sf_dir).invoices))


def duplicate_soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(duplicates.soft_duplicates(ApView(spark, sf_dir).invoices))


def duplicate_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(duplicates.compared_earlier(ApView(spark, sf_dir).invoices))


def po_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = ApView(spark, sf_dir)
    return _ids(matching.find_orders(v.invoices, v.purchase_orders))


def po_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = ApView(spark, sf_dir)
    return _ids(matching.infer_orders(v.invoices, v.purchase_orders, 2000))


def receipts_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = ApView(spark, sf_dir)
    return matching.receipts_by_line(v.po_lines, v.receipt_lines).select(
        "po_line_id", "po_id", F.col("qty_received").cast("long").alias("qty_received"), "receipts"
    )


def _matched(v: ApView) -> DataFrame:
    return matching.match_orders(v.invoices, v.purchase_orders)


def po_overbilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = ApView(spark, sf_dir)
    return _ids(matching.check_overbilled(_matched(v), v.purchase_orders))


def _pairs(v: ApView) -> DataFrame:
    named = matching.find_orders(v.invoices, v.purchase_orders).filter("matched_po_id is not null").select("invoice_id", "matched_po_id")
    state = v.invoices.select("invoice_id", "status", "created_at")
    lines = v.invoice_lines.drop("supplier_id", "tax_rate_bp").join(named, "invoice_id").join(state, "invoice_id")
    return matching.pair_by_sku(lines, v.po_lines)


def line_pairs_sku(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(ApView(spark, sf_dir)).select("invoice_id", "line_no", "po_line_id", "method")


def price_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.check_price(_pairs(ApView(spark, sf_dir)))


def qty_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = ApView(spark, sf_dir)
    return matching.check_quantities(_pairs(v), matching.receipts_by_line(v.po_lines, v.receipt_lines))


QUERIES = {
    f.__name__: f
    for f in (
        po_overbilled, supplier_resolution, line_math, totals, tax, dates, currency, bank, duplicate_hard, duplicate_soft,
        duplicate_compared, po_lookup, po_inference, receipts_by_line, line_pairs_sku, price_variance, qty_variance,
    )
}

_KEY = "trim(regexp_replace(regexp_replace(lower({0}), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_NUM = "coalesce(regexp_replace(upper({0}), '[^A-Z0-9]', '', 'g'), '')"
#: Lines that no SKU settles, of the lines c_l (invoice_id, line_no, mp, k, description, amount_minor) and SKU pairs c_p (invoice_id,
#: line_no, pl): by description, then by amount, a line at a time; the last table, rest, has invoice_id, line_no, pl and method.
REST_SQL = """, u_l AS (
  SELECT c_l.*, array_to_string(list_sort(string_split(trim(regexp_replace(lower(coalesce(description, '')), '[\\W_]+', ' ', 'g')), ' ')), ' ') AS t
  FROM c_l ANTI JOIN c_p ON c_p.invoice_id = c_l.invoice_id AND c_p.line_no = c_l.line_no
), u_o AS (
  SELECT h.invoice_id, pol.po_line_id AS pl, pol.line_no AS pn, coalesce(regexp_replace(upper(sku), '[^A-Z0-9]', '', 'g'), '') AS k, pol.q * pol.unit_price_minor AS amount,
    array_to_string(list_sort(string_split(trim(regexp_replace(lower(coalesce(description, '')), '[\\W_]+', ' ', 'g')), ' ')), ' ') AS t
  FROM (SELECT DISTINCT invoice_id, mp FROM u_l) h JOIN pol ON pol.po_id = h.mp ANTI JOIN c_p ON c_p.invoice_id = h.invoice_id AND c_p.pl = pol.po_line_id
), u_p AS (
  SELECT l.invoice_id, l.line_no, pl, pn, l.t AS a, o.t AS b, l.amount_minor IS NOT DISTINCT FROM o.amount AND l.amount_minor IS NOT NULL AS same FROM u_l l JOIN u_o o ON o.invoice_id = l.invoice_id
    AND (l.k = '' OR o.k = '' OR l.k = o.k)
), u_t AS (SELECT DISTINCT a, b FROM u_p WHERE a <> '' AND a <> b AND levenshtein(a, b) * 4 <= len(a) + len(b))
, u_c AS (
  SELECT a, b, 0 AS i, list_transform(range(0, len(b) + 1), lambda z: 0::BIGINT) AS r FROM u_t
  UNION ALL
  SELECT a, b, i + 1, list_reduce(list_concat([[0::BIGINT]], list_transform(range(1, len(b) + 1), lambda j: [j])),
    lambda acc, j: list_append(acc, greatest(acc[len(acc)], r[j[1] + 1], CASE WHEN substr(b, j[1], 1) = substr(a, i + 1, 1) THEN r[j[1]] + 1 ELSE 0 END)))
  FROM u_c WHERE i < len(a)
), u_r AS (SELECT a, b, (200.0 * r[len(r)] / (len(a) + len(b)))::DOUBLE AS v FROM u_c WHERE i = len(a))
, u_q AS (
  SELECT invoice_id, line_no, list({'s': s, 'pl': pl} ORDER BY s DESC, pn) FILTER (s >= 0) AS words, list(pl ORDER BY pn) FILTER (same) AS sums FROM (
    SELECT u_p.*, CASE WHEN u_p.a = '' THEN NULL WHEN u_p.a = u_p.b THEN 100.0 ELSE coalesce(v, 0) END AS s FROM u_p LEFT JOIN u_r ON u_r.a = u_p.a AND u_r.b = u_p.b) GROUP BY ALL
), u_n AS (SELECT *, row_number() OVER (PARTITION BY invoice_id ORDER BY line_no) AS n, count(*) OVER (PARTITION BY invoice_id) AS m FROM u_q)
, u_w AS (
  SELECT invoice_id, 0::BIGINT AS n, []::BIGINT[] AS used, []::STRUCT(line_no BIGINT, pl BIGINT, method VARCHAR)[] AS got FROM (SELECT DISTINCT invoice_id FROM u_n)
  UNION ALL
  SELECT invoice_id, n, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, CASE WHEN pick IS NULL THEN got ELSE list_append(got, {'line_no': line_no, 'pl': pick, 'method': method}) END FROM (
    SELECT *, CASE WHEN n <= m AND len(f) > 0 AND f[1].s >= 80 AND (len(f) = 1 OR f[1].s - f[2].s >= 5) THEN f[1].pl WHEN n > m AND NOT done AND len(g) = 1 THEN g[1] END AS pick,
      CASE WHEN n <= m THEN 'description' ELSE 'amount' END AS method FROM (
      SELECT w.invoice_id, w.n + 1 AS n, u_n.m, w.used, w.got, u_n.line_no, list_filter(coalesce(words, []), lambda o: NOT list_contains(w.used, o.pl)) AS f,
        list_filter(coalesce(sums, []), lambda o: NOT list_contains(w.used, o)) AS g, list_contains(list_transform(w.got, lambda x: x.line_no), u_n.line_no) AS done
      FROM u_w w JOIN u_n ON u_n.invoice_id = w.invoice_id AND u_n.n = CASE WHEN w.n < u_n.m THEN w.n + 1 ELSE w.n + 1 - u_n.m END WHERE w.n < 2 * u_n.m))
), u_z AS (SELECT u_w.invoice_id, unnest(got) AS x FROM u_w JOIN (SELECT DISTINCT invoice_id, m FROM u_n) e ON e.invoice_id = u_w.invoice_id AND u_w.n = 2 * e.m)
, rest AS (SELECT invoice_id, x.line_no AS line_no, x.pl AS pl, x.method AS method FROM u_z)
"""
_UNREAD = "('received', 'extracting', 'extracted', 'failed')"
_CANON = "regexp_replace({0}, '(^|[^0-9])0+([0-9])', '\\1\\2', 'g')"

_RESOLVED = (
    WORLD_SQL
    + f""", t AS (SELECT tenant_id, upper(trim(tax_id)) AS k_tax, min(supplier_id) AS ts FROM sup GROUP BY ALL)
, nm AS (SELECT tenant_id, {_KEY.format("name")} AS k_name, supplier_id FROM sup UNION ALL SELECT tenant_id, {_KEY.format("alias")}, supplier_id FROM sup)
, n AS (SELECT tenant_id, k_name, min(supplier_id) AS ns FROM nm WHERE k_name <> '' GROUP BY ALL)
, r0 AS (
  SELECT inv.*, coalesce({_KEY.format("supplier_name")}, '') AS k_name, coalesce(upper(trim(supplier_tax_id)), '') AS k_tax FROM inv
), r1 AS (SELECT r0.*, ts, ns, coalesce(ts, ns) AS cand FROM r0 LEFT JOIN t USING (tenant_id, k_tax) LEFT JOIN n USING (tenant_id, k_name))
, res AS (
  SELECT r1.*, sup.tax_id AS c_tax, ts IS NOT NULL AND k_name <> '' AND ts IS DISTINCT FROM ns AS tax_differs,
    ts IS NULL AND ns IS NOT NULL AND k_tax <> '' AND sup.tax_id IS NOT NULL AS name_differs,
    sup.default_currency AS c_currency, sup.tax_rate_bp AS c_rate, sup.bank_account_hash AS c_bank
  FROM r1 LEFT JOIN sup ON sup.tenant_id = r1.tenant_id AND sup.supplier_id = cand
), facts AS (
  SELECT *, CASE WHEN cand IS NOT NULL AND NOT tax_differs AND NOT name_differs THEN cand END AS s_id FROM res
), roll AS (
  SELECT invoice_id, count(*) AS n_lines, count(*) FILTER (qty IS NOT NULL AND amount_minor IS NOT NULL) AS checked,
    count(*) FILTER (qty IS NULL OR amount_minor IS NULL) AS unchecked,
    count(*) FILTER (qty IS NOT NULL AND amount_minor IS NOT NULL AND abs(qty * unit_price_minor - amount_minor) > 1) AS wrong,
    CAST(sum(amount_minor) AS BIGINT) AS lines_sum, count(*) FILTER (amount_minor IS NULL) AS amounts_missing,
    count(*) FILTER (amount_minor IS NULL OR tax_rate_bp IS NULL) AS taxes_missing,
    CAST(sum(CAST(round(CAST(amount_minor AS DECIMAL(18, 0)) * tax_rate_bp / 10000, 0) AS BIGINT)) AS BIGINT) AS lines_tax
  FROM il GROUP BY invoice_id
)
"""
)

_FOUND = (
    WORLD_SQL
    + f""", f0 AS (SELECT inv.*, {_NUM.format("po_number")} AS k FROM inv)
, ok AS (SELECT *, {_NUM.format("po_number")} AS k FROM po)
, f1 AS (
  SELECT f0.invoice_id, f0.supplier_id, count(ok.po_id) AS named, count(ok.po_id) FILTER (ok.supplier_id = f0.supplier_id) AS mine,
    min(ok.po_id) FILTER (ok.supplier_id = f0.supplier_id) AS o_id, min(ok.status) FILTER (ok.supplier_id = f0.supplier_id) AS o_status
  FROM f0 LEFT JOIN ok ON ok.tenant_id = f0.tenant_id AND ok.k = f0.k WHERE f0.k <> '' GROUP BY f0.invoice_id, f0.supplier_id
), found AS (
  SELECT *, CASE WHEN named > 0 AND supplier_id IS NULL THEN 'SUPPLIER_UNKNOWN' WHEN mine > 1 THEN 'AMBIGUOUS_PO' WHEN mine = 1 AND o_status = 'open' THEN NULL
    WHEN mine = 1 THEN 'PO_NOT_OPEN' WHEN named > 0 THEN 'PO_OF_OTHER_SUPPLIER' ELSE 'NOT_IN_SYSTEM' END AS reason FROM f1
)
"""
)

_INFERRED = """, b0 AS (SELECT *, supplier_id IS NOT NULL AND subtotal_minor IS NOT NULL AND currency IS NOT NULL AS able FROM inv WHERE po_number IS NULL)
, b1 AS (
  SELECT b0.invoice_id, able, count(po.po_id) AS candidates, min(po.po_id) AS first_po_id FROM b0 LEFT JOIN po ON able AND po.tenant_id = b0.tenant_id
    AND po.supplier_id = b0.supplier_id AND po.currency = b0.currency AND po.status = 'open'
    AND abs(po.total_minor - b0.subtotal_minor) * 10000 <= po.total_minor * {tolerance} GROUP BY b0.invoice_id, able
), inferred AS (
  SELECT *, CASE WHEN NOT able THEN 'CANNOT_INFER_PO' WHEN candidates = 1 THEN 'PO_INFERRED' WHEN candidates > 1 THEN 'AMBIGUOUS_PO' ELSE 'NO_OPEN_PO_WITH_MATCHING_TOTAL' END AS reason FROM b1
)
"""

_PAIRS = (
    _FOUND
    + f""", m AS (SELECT invoice_id, o_id AS matched_po_id FROM found WHERE reason IS NULL)
, l0 AS (
  SELECT il.invoice_id, il.line_no, il.qty, il.unit_price_minor, m.matched_po_id, {_NUM.format("il.sku")} AS k,
    inv.status, inv.created_at FROM il JOIN m USING (invoice_id) JOIN inv USING (invoice_id)
), l1 AS (SELECT * FROM l0 WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY invoice_id, k ORDER BY line_no) = 1)
, o1 AS (
  SELECT po_id, {_NUM.format("sku")} AS k, count(*) AS n, min(po_line_id) AS po_line_id, min(q) AS po_qty, min(unit_price_minor) AS po_unit_price_minor FROM pol GROUP BY ALL
), pairs AS (SELECT l1.*, o1.po_line_id, po_qty, po_unit_price_minor FROM l1 JOIN o1 ON o1.po_id = matched_po_id AND o1.k = l1.k WHERE n = 1)
"""
)

ORACLES = {
    "supplier_resolution": _RESOLVED
    + """SELECT invoice_id, CASE WHEN trim(coalesce(supplier_name, '')) = '' AND coalesce(supplier_tax_id, '') = '' THEN 'skipped' WHEN s_id IS NOT NULL THEN 'pass' ELSE 'fail' END AS outcome,
  s_id AS supplier_id, CASE WHEN s_id IS NOT NULL THEN CASE WHEN ts IS NOT NULL THEN 'tax_id' ELSE 'name' END END AS matched_by,
  CASE WHEN tax_differs THEN 'NAME_DIFFERS_FROM_TAX_ID' WHEN name_differs THEN 'TAX_ID_DIFFERS_FROM_RECORD' END AS conflict FROM facts""",
    "line_math": _RESOLVED
    + "SELECT invoice_id, CASE WHEN wrong > 0 THEN 'fail' WHEN checked > 0 AND unchecked = 0 THEN 'pass' ELSE 'skipped' END AS outcome, checked, unchecked, wrong FROM roll",
    "totals": _RESOLVED
    + """, x AS (SELECT inv.*, amounts_missing = 0 AND abs(lines_sum - subtotal_minor) > n_lines AS lines_bad,
  coalesce(abs(subtotal_minor + tax_minor - total_minor) > 1, false) AS total_bad FROM inv JOIN roll USING (invoice_id))
SELECT invoice_id, CASE WHEN lines_bad OR total_bad THEN 'fail' WHEN total_minor IS NOT NULL THEN 'pass' ELSE 'skipped' END AS outcome, lines_bad, total_bad,
  subtotal_minor + tax_minor AS expected_minor, total_minor AS actual_minor FROM x""",
    "tax": _RESOLVED
    + """, x AS (SELECT f.*, n_lines, CASE WHEN s_id IS NOT NULL THEN c_rate END AS rate, CASE WHEN taxes_missing = 0 THEN lines_tax END AS lt FROM facts f JOIN roll USING (invoice_id))
, y AS (SELECT *, CASE WHEN rate IS NOT NULL THEN CAST(round(CAST(subtotal_minor AS DECIMAL(18, 0)) * rate / 10000, 0) AS BIGINT) ELSE lt END AS e FROM x)
SELECT invoice_id, CASE WHEN e IS NULL THEN 'skipped' WHEN abs(e - tax_minor) <= CASE WHEN rate IS NOT NULL THEN 1 ELSE n_lines END THEN 'pass' ELSE 'fail' END AS outcome,
  CASE WHEN e IS NULL THEN 'NO_RATE_TO_COMPARE' END AS reason, CASE WHEN e IS NOT NULL THEN CASE WHEN rate IS NOT NULL THEN 'supplier' ELSE 'lines' END END AS source,
  e AS expected_minor, tax_minor AS actual_minor FROM y""",
    "dates": WORLD_SQL
    + f"""SELECT invoice_id, CASE WHEN invoice_date IS NULL THEN 'skipped' WHEN invoice_date > DATE '{TODAY}' OR DATE '{TODAY}' - invoice_date > 365 OR due_date < invoice_date THEN 'fail' ELSE 'pass' END AS outcome,
  CASE WHEN invoice_date IS NULL THEN 'NO_INVOICE_DATE' ELSE array_to_string(list_filter([CASE WHEN invoice_date > DATE '{TODAY}' THEN 'FUTURE_INVOICE_DATE' END,
    CASE WHEN DATE '{TODAY}' - invoice_date > 365 THEN 'INVOICE_TOO_OLD' END, CASE WHEN due_date < invoice_date THEN 'DUE_BEFORE_INVOICE' END], lambda x: x IS NOT NULL), ',') END AS reasons FROM inv""",
    "currency": _RESOLVED
    + """SELECT invoice_id, CASE WHEN s_id IS NULL THEN 'skipped' WHEN coalesce(currency, CASE printed_currency WHEN '$' THEN 'USD' END) = c_currency THEN 'pass' ELSE 'fail' END AS outcome,
  currency AS invoice_currency, CASE WHEN s_id IS NOT NULL THEN c_currency END AS supplier_currency FROM facts""",
    "bank": _RESOLVED
    + """, x AS (SELECT *, CASE WHEN s_id IS NULL THEN 'UNKNOWN_SUPPLIER' WHEN bank_account_hash IS NULL AND NOT bank_absence_certain THEN 'BANK_NOT_READ'
  WHEN bank_account_hash IS NOT NULL AND c_bank IS NULL THEN 'NO_BANK_ON_FILE' END AS reason FROM facts)
SELECT invoice_id, CASE WHEN reason IS NOT NULL THEN 'skipped' WHEN bank_account_hash IS NULL OR bank_account_hash = c_bank THEN 'pass' ELSE 'fail' END AS outcome, reason FROM x""",
    "duplicate_hard": WORLD_SQL
    + f""", x AS (SELECT *, {_CANON.format(_NUM.format("invoice_number"))} AS c, status NOT IN {_UNREAD} AS old FROM inv WHERE supplier_id IS NOT NULL)
SELECT a.invoice_id, b.invoice_id AS existing_invoice_id, CAST(abs(a.invoice_date - b.invoice_date) AS INTEGER) AS days_apart
FROM x a JOIN x b ON a.tenant_id = b.tenant_id AND a.supplier_id = b.supplier_id AND a.c = b.c AND b.old AND (b.created_at, b.invoice_id) < (a.created_at, a.invoice_id)
WHERE a.c <> '' QUALIFY row_number() OVER (PARTITION BY a.invoice_id ORDER BY b.created_at, b.invoice_id) = 1""",
    "duplicate_compared": WORLD_SQL
    + f"""SELECT invoice_id, count(*) FILTER (status NOT IN {_UNREAD}) OVER (PARTITION BY tenant_id, supplier_id ORDER BY created_at, invoice_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS compared
FROM inv WHERE supplier_id IS NOT NULL""",
    "duplicate_soft": WORLD_SQL.replace("WITH sup", "WITH RECURSIVE sup", 1)
    + f""", x AS (
  SELECT *, {_NUM.format("invoice_number")} AS k, status NOT IN {_UNREAD} AS old FROM inv WHERE supplier_id IS NOT NULL
    AND total_minor <> 0 AND invoice_date IS NOT NULL AND currency IS NOT NULL
), y AS (SELECT *, {_CANON.format("k")} AS c, regexp_replace(k, '[^0-9]', '', 'g') AS d FROM x WHERE k <> '')
, p AS (
  SELECT a.invoice_id, b.invoice_id AS o, a.k AS ka, b.k AS kb, a.c AS ca, b.c AS cb, a.d AS da, b.d AS db, abs(a.invoice_date - b.invoice_date) AS days, b.created_at AS oc
  FROM y a JOIN y b ON a.tenant_id = b.tenant_id AND a.supplier_id = b.supplier_id AND a.currency = b.currency AND a.total_minor = b.total_minor
    AND abs(a.invoice_date - b.invoice_date) <= 7 AND a.c <> b.c AND b.old AND (b.created_at, b.invoice_id) < (a.created_at, a.invoice_id)
), s AS (SELECT ka AS a, kb AS b FROM p UNION SELECT ca, cb FROM p UNION SELECT da, db FROM p)
, cells AS (
  SELECT a, b, 0 AS i, list_transform(range(0, len(b) + 1), lambda z: 0::BIGINT) AS r FROM s
  UNION ALL
  SELECT a, b, i + 1, list_reduce(list_concat([[0::BIGINT]], list_transform(range(1, len(b) + 1), lambda j: [j])),
    lambda acc, j: list_append(acc, greatest(acc[len(acc)], r[j[1] + 1], CASE WHEN substr(b, j[1], 1) = substr(a, i + 1, 1) THEN r[j[1]] + 1 ELSE 0 END)))
  FROM cells WHERE i < len(a)
), ratio AS (SELECT a, b, CASE WHEN len(a) + len(b) = 0 THEN 100.0 ELSE 200.0 * r[len(r)] / (len(a) + len(b)) END::DOUBLE AS v FROM cells WHERE i = len(a))
, scored AS (
  SELECT p.*, greatest(r1.v, r2.v, CASE WHEN len(da) >= 4 AND len(db) >= 4 THEN r3.v ELSE 0 END) AS sim
  FROM p JOIN ratio r1 ON r1.a = ka AND r1.b = kb JOIN ratio r2 ON r2.a = ca AND r2.b = cb JOIN ratio r3 ON r3.a = da AND r3.b = db
)
SELECT invoice_id, o AS existing_invoice_id, round(sim, 1) AS similarity, CAST(days AS INTEGER) AS days_apart FROM scored WHERE sim >= 85
QUALIFY row_number() OVER (PARTITION BY invoice_id ORDER BY sim DESC, oc, o) = 1""",
    "po_lookup": _FOUND
    + """SELECT invoice_id, CASE WHEN reason IS NULL THEN 'pass' WHEN reason IN ('SUPPLIER_UNKNOWN', 'AMBIGUOUS_PO') THEN 'skipped' ELSE 'fail' END AS outcome, reason, named,
  CASE WHEN reason IS NULL THEN o_id END AS matched_po_id FROM found""",
    "po_inference": WORLD_SQL
    + _INFERRED.format(tolerance=2000)
    + """SELECT invoice_id, CASE WHEN reason = 'NO_OPEN_PO_WITH_MATCHING_TOTAL' THEN 'fail' ELSE 'skipped' END AS outcome, reason, candidates,
  CASE WHEN candidates = 1 THEN first_po_id END AS matched_po_id FROM inferred""",
    "receipts_by_line": WORLD_SQL
    + """SELECT pol.po_line_id, pol.po_id, CAST(coalesce(q1, 0) AS BIGINT) AS qty_received, coalesce(n, 0) AS receipts FROM pol
LEFT JOIN (SELECT po_line_id, sum(qty_received) AS q1 FROM rec GROUP BY 1) a USING (po_line_id) LEFT JOIN (SELECT po_id, count(DISTINCT receipt_id) AS n FROM rec GROUP BY 1) b ON b.po_id = pol.po_id""",
    "po_overbilled": _FOUND
    + _INFERRED.format(tolerance=200)
    + """, m AS (
  SELECT invoice_id, o_id AS matched_po_id FROM found WHERE reason IS NULL UNION ALL SELECT invoice_id, first_po_id FROM inferred WHERE candidates = 1
), j AS (
  SELECT inv.*, matched_po_id, po.total_minor AS po_total, CASE WHEN subtotal_minor < 0 THEN 'CREDIT_NOTE' WHEN inv.currency IS NULL THEN 'CURRENCY_UNKNOWN'
    WHEN inv.currency <> po.currency THEN 'CURRENCY_DIFFERS_FROM_PO' WHEN subtotal_minor IS NULL THEN 'NO_SUBTOTAL' END AS reason
  FROM inv JOIN m USING (invoice_id) JOIN po ON po.po_id = matched_po_id AND po.tenant_id = inv.tenant_id
), k AS (SELECT *, CASE WHEN reason IS NULL THEN subtotal_minor END AS billed_minor FROM j)
, b AS (
  SELECT *, CAST(coalesce(sum(billed_minor) FILTER (status NOT IN ('failed', 'rejected', 'received', 'extracting', 'extracted')) OVER w, 0) AS BIGINT) AS billed_before_minor,
    count(*) FILTER (status NOT IN ('failed', 'rejected', 'received', 'extracting', 'extracted') AND billed_minor IS NULL) OVER w AS unknown_before
  FROM k WINDOW w AS (PARTITION BY tenant_id, matched_po_id ORDER BY created_at, invoice_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), z AS (SELECT *, billed_before_minor + billed_minor - po_total AS over_minor FROM b)
SELECT invoice_id, matched_po_id, CASE WHEN reason IS NOT NULL OR (over_minor <= 0 AND unknown_before > 0) THEN 'skipped' WHEN over_minor > 0 THEN 'fail' ELSE 'pass' END AS outcome,
  CASE WHEN reason IS NOT NULL THEN reason WHEN over_minor <= 0 AND unknown_before > 0 THEN 'EARLIER_BILLING_UNKNOWN' END AS reason, billed_minor, billed_before_minor, unknown_before, over_minor FROM z""",
    "line_pairs_sku": _PAIRS + "SELECT invoice_id, line_no, po_line_id, 'sku' AS method FROM pairs",
    "price_variance": _PAIRS
    + """SELECT invoice_id, line_no, po_line_id, CASE WHEN unit_price_minor IS NULL THEN 'skipped' WHEN abs(unit_price_minor - po_unit_price_minor) * 10000 > po_unit_price_minor * 200 THEN 'fail' ELSE 'pass' END AS outcome,
  unit_price_minor, po_unit_price_minor, CASE WHEN po_unit_price_minor <> 0 THEN abs(unit_price_minor - po_unit_price_minor) * 10000 // po_unit_price_minor END AS variance_bp FROM pairs""",
    "qty_variance": _PAIRS
    + """, r AS (SELECT po_line_id, sum(qty_received) AS received FROM rec GROUP BY 1), rn AS (SELECT DISTINCT po_id FROM rec)
, b AS (
  SELECT *, CAST(coalesce(sum(qty) FILTER (status NOT IN ('failed', 'rejected', 'received', 'extracting', 'extracted')) OVER (PARTITION BY po_line_id ORDER BY created_at, invoice_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM pairs
)
SELECT invoice_id, line_no, b.po_line_id, CASE WHEN qty IS NULL THEN 'skipped' WHEN before + qty > po_qty THEN 'fail' ELSE 'pass' END AS qty_outcome,
  CASE WHEN rn.po_id IS NULL THEN 'skipped' WHEN qty IS NULL THEN 'skipped' WHEN before + qty > coalesce(received, 0) THEN 'fail' ELSE 'pass' END AS received_outcome,
  before AS billed_before_qty, qty AS billed_qty, po_qty, CAST(coalesce(received, 0) AS BIGINT) AS received_qty
FROM b LEFT JOIN r ON r.po_line_id = b.po_line_id LEFT JOIN rn ON rn.po_id = b.matched_po_id""",
}
