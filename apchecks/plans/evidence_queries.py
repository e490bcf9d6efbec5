"""Queries of text evidence, settings, account numbers and hints from supplier records, with their SQL.

Texts are printed from the invoices' own values in forms that change with the invoice, some of them damaged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import evidence, numbers
from ..functions.numbers import MONTHS
from ..operators import suggestions
from ..sources.ap_view import WORLD_SQL, ApView

KEY = b"an example key"


def _choose(k: Column, *values: Column | str) -> Column:
    return F.element_at(F.array(*(F.lit(v) if isinstance(v, str) else v for v in values)), (k % len(values) + 1).cast("int"))


def text_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = ApView(spark, sf_dir).invoices
    k, total, day = F.col("invoice_id"), F.col("total_minor"), F.col("invoice_date")
    us = F.concat(F.format_number(F.floor(total / 100), 0), F.lit("."), F.lpad((total % 100).cast("string"), 2, "0"))
    eu, plain = F.translate(us, ",.", ".,"), F.replace(us, F.lit(","), F.lit(""))
    amount = _choose(k, us, eu, plain, F.concat(F.lit("9"), us), F.concat(us, F.lit(".5")), F.replace(us, F.lit(","), F.lit("'")), F.replace(us, F.lit("."), F.lit(",")))
    month = _choose(F.month(day) - 1, *MONTHS)
    fmt = lambda p: F.date_format(day, p)
    dated = _choose(
        k + F.expr("invoice_id div 7"), fmt("yyyy-MM-dd"), fmt("d/M/yyyy"), fmt("MM-dd-yyyy"), F.concat(fmt("d "), F.upper(month), fmt(" yyyy")),
        F.concat(F.substring(month, 1, 3), fmt(" dd, yyyy")), F.concat(F.lit("1"), fmt("d.MM.yyyy")), fmt("d/M-yyyy"),
    )
    code = _choose(k + F.expr("invoice_id div 11"), F.coalesce("currency", F.lit("?")), F.concat(F.coalesce("currency", F.lit("?")), F.lit("X")), "€", "$", "pay in gbp ")
    small = ((k % 1000) / 8).cast("decimal(18,4)")
    printed = _choose(k + F.expr("invoice_id div 5"), small.cast("string"), F.translate(small.cast("string"), ".", ","), F.concat(F.lit("7"), small.cast("string")), F.concat(small.cast("string"), F.lit(" %")))
    text = F.concat_ws(" ", F.lit("due"), amount, F.lit("on"), dated, F.lit("in"), code, F.lit("for"), printed, F.lit("."))
    return i.select(
        "invoice_id", evidence.amount_in_text(total, F.lit(2), text).alias("amount_found"), evidence.date_in_text(day, text).alias("date_found"),
        evidence.currency_support(F.col("currency"), text).alias("currency_found"), evidence.number_in_text(small, text).alias("number_found"),
        evidence.percent_in_text(small, text).alias("percent_found"),
        evidence.sum_supports(total, F.array("subtotal_minor", "tax_minor"), 1).alias("sum_holds"),
    )


def tax_rates_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = ApView(spark, sf_dir).invoice_lines
    n = (F.col("po_id") % 150).cast("string")
    digit = (F.col("po_id") % 10).cast("string")
    text = _choose(
        F.col("po_id") + F.col("line_no"), F.concat(n, F.lit("%")), F.concat(n, F.lit(" %")), n, F.concat(F.lit("0."), digit), F.concat(F.lit(" 0,"), digit, F.lit("%")),
        F.concat(n, F.lit(".5")), F.concat(n, F.lit(" pct")),
    )
    read = lines.select("invoice_id", "line_no", numbers.parse_tax_rate(text).alias("r"))
    return read.select("invoice_id", "line_no", F.col("r.value").cast("double").alias("rate"), F.col("r.error").alias("error"))


def tenant_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A setting read from the events' own JSON, or from other kinds of values."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    raw = _choose(F.col("event_id"), F.col("props"), '{"k": true}', '{"k": "12"}', '{"k": 12.0}', "{", '{"k": 60}', '{"k": 61}')
    return e.select("event_id", evidence.int_setting(raw, "k", 30, 10, 60).alias("value"))


def account_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = F.col("o_orderkey")
    account = F.when(key % 50 == 0, "a-1").when(key % 51 != 0, F.concat(F.lit("de"), (key % 90 + 10).cast("string"), F.lit(" "), key.cast("string"), F.lit("/ab")))
    return o.select(key.alias("order_id"), evidence.masked_account(account).alias("masked"), evidence.account_hash(account, KEY).alias("account_hash"))


def supplier_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = ApView(spark, sf_dir)
    return suggestions.master_hints(v.invoices, v.suppliers)


def latest_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 failed invoices received last: a top-k report."""
    i = ApView(spark, sf_dir).invoices.filter("status = 'failed'")
    return i.orderBy(F.desc("created_at"), "invoice_id").limit(20).select("invoice_id", F.date_format("created_at", "yyyy-MM-dd").alias("received"))


QUERIES = {f.__name__: f for f in (text_evidence, tax_rates_read, tenant_settings, account_keys, supplier_hints, latest_failed)}

_INV = f"({WORLD_SQL} SELECT * FROM inv)"
_NAMES = "[" + ", ".join(f"'{m}'" for m in MONTHS) + "]"
_INNER, _OUTER = (b.hex() for b in evidence.hmac_pads(KEY))
_PICK = lambda k, *values: f"([{', '.join(values)}])[CAST(({k}) % {len(values)} + 1 AS INTEGER)]"
_US = "format('{:,}', total_minor // 100) || '.' || lpad(CAST(total_minor % 100 AS VARCHAR), 2, '0')"
_MARKS = ["", ",", "\\.", " ", "\u00a0", "''"]
# All ways to print the whole part, each with every decimal mark but its own.
_AMOUNTS = " || '|' || ".join(
    f"replace(format('{{:,}}', total_minor // 100), ',', '{g}') || '{d}' || lpad(CAST(total_minor % 100 AS VARCHAR), 2, '0')" for g in _MARKS for d in (",", "\\.") if d != g
)
_D, _M = ("(CASE WHEN {0} < 10 THEN '0?' ELSE '' END || {0})".format(f"{p}(invoice_date)") for p in ("day", "month"))
_NAME = f"('(' || {_NAMES}[month(invoice_date)] || '|' || substr({_NAMES}[month(invoice_date)], 1, 3) || ')')"
_DATES = " || '|' || ".join(
    ["strftime(invoice_date, '%Y-%m-%d')"]
    + [f"{a} || '{s}' || {b} || '{s}' || year(invoice_date)" for a, b in ((_D, _M), (_M, _D)) for s in ("/", "\\.", "-")]
    + [f"{_D} || '{s}' || {_NAME} || '{s}' || year(invoice_date)" for s in (" ", "-")]
    + [f"{_NAME} || ' ' || {_D} || ',? ' || year(invoice_date)"]
)
_SMALL = "CAST(CAST(small AS DECIMAL(18, 4)) AS VARCHAR)"
_BARE = "CASE WHEN rtrim(split_part(s, '.', 2), '0') = '' THEN split_part(s, '.', 1) || '([.,]0+)?' ELSE split_part(s, '.', 1) || '[.,]' || rtrim(split_part(s, '.', 2), '0') || '0*' END"

ORACLES = {
    "text_evidence": f"""WITH a AS (SELECT *, invoice_id AS k, (invoice_id % 1000) / 8.0 AS small FROM {_INV})
, b AS (SELECT *, {_SMALL} AS s, {_US} AS us, {_NAMES}[month(invoice_date)] AS mon, coalesce(currency, '?') AS cur FROM a)
, c AS (SELECT *, {_BARE} AS bare, concat_ws(' ', 'due', {_PICK("k", "us", "translate(us, ',.', '.,')", "replace(us, ',', '')", "'9' || us", "us || '.5'", "replace(us, ',', '''')", "replace(us, '.', ',')")}, 'on',
  {_PICK("k + k // 7", "strftime(invoice_date, '%Y-%m-%d')", "strftime(invoice_date, '%-d/%-m/%Y')", "strftime(invoice_date, '%m-%d-%Y')", "day(invoice_date) || ' ' || upper(mon) || ' ' || year(invoice_date)",
         "substr(mon, 1, 3) || strftime(invoice_date, ' %d, %Y')", "'1' || strftime(invoice_date, '%-d.%m.%Y')", "strftime(invoice_date, '%-d/%-m-%Y')")}, 'in',
  {_PICK("k + k // 11", "cur", "cur || 'X'", "'€'", "'$'", "'pay in gbp '")}, 'for', {_PICK("k + k // 5", "s", "translate(s, '.', ',')", "'7' || s", "s || ' %'")}, '.') AS text FROM b)
SELECT invoice_id, regexp_matches(text, '(^|[^0-9.,]|(^|[^0-9])[.,])(' || {_AMOUNTS} || ')($|[^0-9.,]|[.,]($|[^0-9]))') AS amount_found,
  regexp_matches(text, '(?i)(^|[^0-9])(' || {_DATES} || ')($|[^0-9])') AS date_found,
  CASE WHEN currency IS NULL THEN NULL WHEN regexp_matches(text, '(?i)(^|[^a-z])' || currency || '($|[^a-z])') OR (currency = 'EUR' AND contains(text, '€')) OR (currency = 'GBP' AND contains(text, '£')) THEN true
    WHEN (currency = 'USD' AND contains(text, '$')) OR (currency = 'JPY' AND contains(text, '¥')) THEN NULL ELSE false END AS currency_found,
  regexp_matches(text, '(^|[^0-9.,])(' || bare || ')($|[^0-9.,]|[.,]($|[^0-9]))') AS number_found, regexp_matches(text, '(^|[^0-9.,])(' || bare || ')\\s*%') AS percent_found,
  abs(subtotal_minor + tax_minor - total_minor) <= 1 AS sum_holds FROM c""",
    "tax_rates_read": f"""WITH x AS (SELECT invoice_id, line_no, (po_id + line_no) % 7 AS form, po_id % 150 AS n, po_id % 10 AS digit FROM ({WORLD_SQL} SELECT * FROM il))
, y AS (SELECT *, CASE WHEN form = 6 THEN 'NOT_A_NUMBER' WHEN form IN (0, 1, 2) AND n > 100 OR form = 5 AND n + 0.5 > 100 THEN 'OUT_OF_RANGE' WHEN form = 3 AND digit > 0 OR form = 5 AND n = 0 THEN 'AMBIGUOUS' END AS error FROM x)
SELECT invoice_id, line_no, CASE WHEN error IS NULL THEN CASE WHEN form < 3 THEN n WHEN form < 5 THEN digit / 10.0 ELSE n + 0.5 END END::DOUBLE AS rate, error FROM y""",
    "tenant_settings": """WITH x AS (SELECT event_id, event_id % 7 AS form, CASE WHEN json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') THEN CAST(props::JSON ->> '$.k' AS BIGINT) END AS k FROM events)
SELECT event_id, CASE WHEN form = 0 AND k BETWEEN 10 AND 60 THEN k WHEN form = 5 THEN 60 ELSE 30 END::BIGINT AS value FROM x""",
    "account_keys": f"""WITH x AS (SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 50 = 0 THEN 'A1' WHEN o_orderkey % 51 <> 0 THEN 'DE' || (o_orderkey % 90 + 10) || o_orderkey || 'AB' END AS a FROM orders)
SELECT order_id, repeat('•', greatest(len(a) - 4, 0)) || right(a, 4) AS masked, sha256(from_hex('{_OUTER}') || from_hex(sha256(from_hex('{_INNER}') || encode(a)))) AS account_hash FROM x""",
    "supplier_hints": f"""WITH i AS {_INV}, s AS ({WORLD_SQL} SELECT * FROM sup)
, t AS (SELECT i.invoice_id, 't' AS how, default_currency AS c FROM i JOIN s ON s.tenant_id = i.tenant_id AND upper(trim(s.tax_id)) = upper(trim(i.supplier_tax_id)))
, n AS (SELECT i.invoice_id, 'n', default_currency FROM i JOIN (SELECT tenant_id, name AS w, default_currency FROM s UNION ALL SELECT tenant_id, alias, default_currency FROM s) z
  ON z.tenant_id = i.tenant_id AND lower(trim(regexp_replace(w, '\\s+', ' ', 'g'))) = lower(trim(regexp_replace(i.supplier_name, '\\s+', ' ', 'g'))))
SELECT i.invoice_id, coalesce(bool_or(how = 't'), false) AS tax_known, coalesce(bool_or(how = 'n'), false) AS name_known, CASE WHEN count(DISTINCT c) = 1 THEN min(c) END AS currency_hint
FROM i LEFT JOIN (SELECT * FROM t UNION ALL SELECT * FROM n) USING (invoice_id) GROUP BY 1""",
    "latest_failed": f"SELECT invoice_id, strftime(created_at, '%Y-%m-%d') AS received FROM {_INV} WHERE status = 'failed' ORDER BY created_at DESC, invoice_id LIMIT 20",
}
