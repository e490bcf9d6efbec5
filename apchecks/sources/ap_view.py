"""Accounts-payable tables derived from the star-schema tables by integer arithmetic.

Suppliers come from ``supplier``, purchase orders and their lines from ``orders`` and ``lineitem``,
receipts from line statuses, and one invoice per order and return flag. Problems are planted by
remainders of the order key, so that every rule has rows that pass, fail and cannot be checked.
``WORLD_SQL`` is the same derivation as DuckDB common table expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import derived_once

CURRENCIES = ("USD", "EUR", "GBP")
TAX_RATES_BP = (0, 500, 800, 1900, 2000)
#: Of the invoices from this day on, three of five are still being read.
FRESH = "2001-08-01"
UNREAD = ("received", "extracted", "extracting")


def _pick(values: tuple, index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def _hits(key: Column, modulus: int) -> Column:
    return key % modulus == 0


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


@dataclass
class ApView:
    """The derived tables of one data folder.

    Order lines, orders and the heads of invoices, which most checks read, are derived once per session
    and read from the shared folder after that. The others are lazy: what a row of those tables and its
    supplier determine is computed where it is read, so that nothing wide is shuffled or written.
    """

    spark: SparkSession
    folder: str

    def kept(self, name: str, build) -> DataFrame:
        return derived_once(self.spark, self.folder, f"ap-{name}", build)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def suppliers(self) -> DataFrame:
        s = self.table("supplier")
        key = F.col("s_suppkey")
        return s.select(
            _text("t", key % 3).alias("tenant_id"), key.alias("supplier_id"), F.col("s_name").alias("name"),
            F.array(_text("Vendor ", key)).alias("aliases"), _text("TX-", key).alias("tax_id"),
            _pick(CURRENCIES, F.col("s_nationkey") % 3).alias("default_currency"),
            F.when(key % 17 != 0, _pick(TAX_RATES_BP, key % 5)).alias("tax_rate_bp"),
            F.when(key % 13 != 0, F.sha2(_text("bank-", key), 256)).alias("bank_account_hash"),
        )

    @property
    def base(self) -> DataFrame:
        order = Window.partitionBy("l_orderkey").orderBy(
            "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
            "l_linestatus", "l_shipdate",
        )
        # Numbered before anything is computed, so that only the table's own columns are shuffled and the partitions stay known by order.
        li = self.table("lineitem").withColumn("line_no", F.row_number().over(order).cast("long"))
        return li.select(
            F.col("l_orderkey").alias("ok"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"),
            F.col("l_quantity").cast("long").alias("q"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("ext"),
            F.round(F.col("l_discount") * 100).cast("long").alias("disc"), F.round(F.col("l_tax") * 100).cast("long").alias("tax"),
            F.col("l_returnflag").alias("rf"), F.col("l_linestatus").alias("ls"), F.col("l_shipdate").cast("date").alias("ship"),
            "line_no",
        )

    @property
    def order_lines(self) -> DataFrame:
        return self.kept("order_lines", self._order_lines)

    def _order_lines(self) -> DataFrame:
        """Lines with the supplier of their order's first one; both windows run on one shuffle by order."""
        part = self.table("part").select(F.col("p_partkey").alias("pk"), F.col("p_name").alias("description"))
        return self.base.join(part, "pk").select(
            F.col("ok").alias("po_id"), "line_no", "description", F.expr("ext div q").alias("unit_price_minor"), "q", "disc", "tax", "rf", "ls", "ship",
            "pk", "sk", F.min_by("sk", "line_no").over(Window.partitionBy("ok")).alias("order_sk"),
        )

    @property
    def po_lines(self) -> DataFrame:
        return self.order_lines.select(
            "po_id", (F.col("po_id") * 1000 + F.col("line_no")).alias("po_line_id"), "line_no",
            _text("SKU-", F.col("pk")).alias("sku"), "description", F.col("q").cast("decimal(18,4)").alias("qty"),
            "unit_price_minor", "q", "disc", "tax", "rf", "ls", "ship", "pk", "sk",
        )

    @property
    def purchase_orders(self) -> DataFrame:
        return self.kept("purchase_orders", self._purchase_orders)

    def _purchase_orders(self) -> DataFrame:
        heads = self.po_lines.groupBy("po_id").agg(
            F.min_by("sk", "line_no").alias("supplier_id"), F.sum(F.col("q") * F.col("unit_price_minor")).alias("total_minor")
        )
        s = self.suppliers.select("supplier_id", "tenant_id", F.col("default_currency").alias("currency"))
        o = self.table("orders").select(F.col("o_orderkey").alias("po_id"), F.when(F.col("o_orderstatus") == "P", "closed").otherwise("open").alias("status"))
        return heads.join(s, "supplier_id").join(o, "po_id").select(
            "tenant_id", "po_id", _text("PO-", F.col("po_id")).alias("po_number"), "supplier_id", "currency", "total_minor", "status"
        )

    @property
    def receipt_lines(self) -> DataFrame:
        short = F.greatest(F.col("q") - F.col("line_no"), F.lit(0))
        qty = F.when(F.col("ls") == "F", F.col("q")).otherwise(short).cast("decimal(18,4)")
        first = self.po_lines.filter(F.col("po_id") % 13 != 0).select((F.col("po_id") * 2).alias("receipt_id"), "po_id", "po_line_id", qty.alias("qty_received"))
        second = self.po_lines.filter((F.col("po_id") % 13 != 0) & (F.col("line_no") % 2 == 0)).select(
            (F.col("po_id") * 2 + 1).alias("receipt_id"), "po_id", "po_line_id", F.lit(1).cast("decimal(18,4)").alias("qty_received")
        )
        return first.unionByName(second)

    @property
    def invoice_lines(self) -> DataFrame:
        p = self.order_lines.filter(F.col("po_id").isNotNull())
        at = F.col("po_id") + F.col("line_no")
        qty = F.col("q") + F.when(F.col("tax") >= 8, 1).otherwise(0)
        unit = F.col("unit_price_minor") + F.when(F.col("disc") >= 9, F.expr("unit_price_minor div 20")).otherwise(0)
        amount = qty * unit + F.when(_hits(at, 23), 7).otherwise(0)
        sku = F.when(_hits(at, 11), None).when(_hits(F.col("po_id"), 5), _text("sku ", F.col("pk"))).otherwise(_text("SKU-", F.col("pk")))
        s = self.suppliers.select("supplier_id", "tenant_id", "tax_rate_bp")
        rows = p.select(
            (F.col("po_id") * 3 + F.when(F.col("rf") == "A", 0).when(F.col("rf") == "N", 1).otherwise(2)).alias("invoice_id"),
            "po_id", "line_no", sku.alias("sku"), F.when(_hits(at, 22), None).when(_hits(at, 33), F.upper(F.concat("description", F.lit(" x")))).otherwise(F.col("description")).alias("description"),
            F.when(~_hits(at, 83), qty).cast("decimal(18,4)").alias("qty"), unit.alias("unit_price_minor"),
            F.when(~_hits(at, 97), amount).alias("amount_minor"), "ship", (F.col("po_id") * 1000 + F.col("line_no")).alias("po_line_id"), F.col("order_sk").alias("supplier_id"),
        )
        return rows.join(s, "supplier_id").select(
            "po_id", "invoice_id", "line_no", "sku", "description", "qty", "unit_price_minor", "amount_minor", "ship", "po_line_id", "supplier_id", "tenant_id",
            "tax_rate_bp", (F.col("tax_rate_bp") / 100).cast("decimal(7,4)").alias("tax_rate"),
        )

    @property
    def invoice_heads(self) -> DataFrame:
        return self.kept("invoice_heads", self._invoice_heads)

    def _invoice_heads(self) -> DataFrame:
        """What lines add up to, by invoice; grouped by order, whose invoices are at most three, so that its last day needs no window."""
        nth, own = F.col("invoice_id") - F.col("po_id") * 3, lambda k, c: F.when(nth == k, F.col(c))
        parts = [x for k in range(3) for x in (F.count_if(nth == k).alias(f"n{k}"), F.sum(own(k, "amount_minor")).alias(f"a{k}"), F.max(own(k, "ship")).alias(f"d{k}"))]
        orders = self.invoice_lines.groupBy("po_id", "tenant_id", F.col("supplier_id").alias("sk")).agg(*parts)
        head = lambda k: F.struct((F.col("po_id") * 3 + k).alias("invoice_id"), F.coalesce(f"a{k}", F.lit(0)).alias("amounts"), F.col(f"d{k}").alias("day"))
        of_order = F.array_compact(F.array(*(F.when(F.col(f"n{k}") > 0, head(k)) for k in range(3))))
        return orders.select("po_id", "tenant_id", "sk", F.greatest("d0", "d1", "d2").alias("order_day"), F.explode(of_order).alias("h")).select("h.*", "po_id", "tenant_id", "sk", "order_day")

    @property
    def invoices(self) -> DataFrame:
        s = self.suppliers.select(F.col("supplier_id").alias("sk"), F.col("name"), "default_currency", "tax_rate_bp")
        ok, sk = F.col("po_id"), F.col("sk")
        h = self.invoice_heads.join(s, "sk").withColumn("subtotal_minor", F.col("amounts") + F.when(_hits(ok, 29), 100).otherwise(0))
        h = h.withColumn("tax_minor", F.expr("(subtotal_minor * coalesce(tax_rate_bp, 800) + 5000) div 10000") + F.when(_hits(ok, 31), 3).otherwise(0))
        total = F.when(_hits(ok, 73) | (ok % 90 == 45), None).when(_hits(ok, 5), 50000).otherwise(F.col("subtotal_minor") + F.col("tax_minor") + F.when(_hits(ok, 37), 5).otherwise(0))
        one, alike = _hits(ok, 17), _hits(ok, 15)  # orders whose invoices share a number, or have like ones
        n = (F.when(one | alike, ok * 3).otherwise(F.col("invoice_id")) * 48271) % 8999993 + 1000000
        n = F.when(alike & ~one, n - n % 10 + F.col("invoice_id") % 3).otherwise(n)
        renamed = (ok % 34 == 17) & _hits(F.col("invoice_id"), 3)  # no record, and a name that could be another's
        known = ~_hits(ok, 43) & ~_hits(ok, 53) & ~renamed
        fresh = F.col("day") >= F.lit(FRESH).cast("date")
        return h.select(
            "tenant_id", "invoice_id", "po_id", sk.alias("true_supplier_id"),
            F.when(known, sk).alias("supplier_id"),
            F.when(_hits(ok, 53), None).when(_hits(ok, 43), _text("Unknown Vendor ", ok % 10))
            .when(renamed, F.concat("name", F.lit(" Ltd"))).when(_hits(ok, 2), F.upper(F.regexp_replace("name", "#", "  "))).otherwise(F.col("name")).alias("supplier_name"),
            F.when(_hits(ok, 3), None).when(_hits(ok, 47), _text("TX-", sk + 1)).otherwise(_text("tx-", sk)).alias("supplier_tax_id"),
            F.when(_hits(ok, 61), None).when(_hits(ok, 59), F.sha2(_text("other-", sk), 256)).otherwise(F.sha2(_text("bank-", sk), 256)).alias("bank_account_hash"),
            (_hits(ok, 61) & _hits(ok, 2)).alias("bank_absence_certain"),
            F.when(_hits(ok, 103), None).when(_hits(ok, 2), _text("INV-", F.lpad(n.cast("string"), 9, "0"))).otherwise(_text("inv ", n)).alias("invoice_number"),
            F.when(~_hits(ok, 79), F.when(alike, F.col("order_day")).otherwise(F.col("day"))).alias("invoice_date"),
            F.when(_hits(ok, 67), F.date_sub("day", 1)).otherwise(F.date_add("day", 30)).alias("due_date"),
            F.when(_hits(ok, 107), None).when(_hits(ok, 41), "JPY").otherwise(F.col("default_currency")).alias("currency"),
            F.when(_hits(ok, 107), "$").alias("printed_currency"),
            "subtotal_minor", "tax_minor", total.alias("total_minor"),
            F.when(_hits(ok, 7), None).when(_hits(ok, 19), _text("PO-9", ok, "9")).when(_hits(ok, 2), _text("po", ok)).otherwise(_text("PO-", ok)).alias("po_number"),
            F.when(fresh & (F.col("invoice_id") % 5 < 3), _pick(UNREAD, F.col("invoice_id") % 5)).when(_hits(F.col("invoice_id"), 97), "failed")
            .when(_hits(F.col("invoice_id"), 89), "rejected").otherwise("checking").alias("status"),
            F.col("day").cast("timestamp_ntz").alias("created_at"),
        )


WORLD_SQL = """
WITH sup AS (
  SELECT 't' || (s_suppkey % 3) AS tenant_id, s_suppkey AS supplier_id, s_name AS name, 'Vendor ' || s_suppkey AS alias,
    'TX-' || s_suppkey AS tax_id, ['USD', 'EUR', 'GBP'][s_nationkey % 3 + 1] AS default_currency,
    CASE WHEN s_suppkey % 17 <> 0 THEN [0, 500, 800, 1900, 2000][s_suppkey % 5 + 1] END AS tax_rate_bp,
    CASE WHEN s_suppkey % 13 <> 0 THEN sha256('bank-' || s_suppkey) END AS bank_account_hash FROM supplier
), base AS (
  SELECT l_orderkey AS ok, l_partkey AS pk, l_suppkey AS sk, CAST(l_quantity AS BIGINT) AS q,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS ext, CAST(round(l_discount * 100) AS BIGINT) AS disc,
    CAST(round(l_tax * 100) AS BIGINT) AS tax, l_returnflag AS rf, l_linestatus AS ls, CAST(l_shipdate AS DATE) AS ship,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
      l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS line_no FROM lineitem
), pol AS (
  SELECT ok AS po_id, ok * 1000 + line_no AS po_line_id, line_no, 'SKU-' || pk AS sku, p_name AS description, q,
    ext // q AS unit_price_minor, disc, tax, rf, ls, ship, pk, sk FROM base JOIN part ON p_partkey = pk
), po AS (
  SELECT tenant_id, po_id, 'PO-' || po_id AS po_number, h.supplier_id, default_currency AS currency, total_minor,
    CASE WHEN o_orderstatus = 'P' THEN 'closed' ELSE 'open' END AS status
  FROM (SELECT po_id, arg_min(sk, line_no) AS supplier_id, CAST(sum(q * unit_price_minor) AS BIGINT) AS total_minor FROM pol GROUP BY po_id) h
  JOIN sup USING (supplier_id) JOIN orders ON o_orderkey = po_id
), rec AS (
  SELECT po_id * 2 AS receipt_id, po_id, po_line_id, CASE WHEN ls = 'F' THEN q ELSE greatest(q - line_no, 0) END AS qty_received FROM pol WHERE po_id % 13 <> 0
  UNION ALL SELECT po_id * 2 + 1, po_id, po_line_id, 1 FROM pol WHERE po_id % 13 <> 0 AND line_no % 2 = 0
), il AS (
  SELECT po_id * 3 + CASE rf WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS invoice_id, po_id, line_no,
    CASE WHEN (po_id + line_no) % 11 = 0 THEN NULL WHEN po_id % 5 = 0 THEN 'sku ' || pk ELSE sku END AS sku,
    CASE WHEN (po_id + line_no) % 22 = 0 THEN NULL WHEN (po_id + line_no) % 33 = 0 THEN upper(description || ' x') ELSE description END AS description,
    CASE WHEN (po_id + line_no) % 83 <> 0 THEN q + CASE WHEN tax >= 8 THEN 1 ELSE 0 END END AS qty,
    unit_price_minor + CASE WHEN disc >= 9 THEN unit_price_minor // 20 ELSE 0 END AS unit_price_minor,
    CASE WHEN (po_id + line_no) % 97 <> 0 THEN (q + CASE WHEN tax >= 8 THEN 1 ELSE 0 END) * (unit_price_minor + CASE WHEN disc >= 9 THEN unit_price_minor // 20 ELSE 0 END)
      + CASE WHEN (po_id + line_no) % 23 = 0 THEN 7 ELSE 0 END END AS amount_minor, ship, po_line_id, tenant_id, supplier_id, tax_rate_bp
  FROM pol JOIN (SELECT po_id, arg_min(sk, line_no) AS supplier_id FROM pol GROUP BY po_id) USING (po_id) JOIN sup USING (supplier_id)
), h AS (
  SELECT invoice_id, po_id, tenant_id, supplier_id AS sk, CAST(coalesce(sum(amount_minor), 0) AS BIGINT) + CASE WHEN po_id % 29 = 0 THEN 100 ELSE 0 END AS subtotal_minor,
    max(ship) AS day FROM il GROUP BY invoice_id, po_id, tenant_id, supplier_id
), h2 AS (
  SELECT h.*, name, default_currency, (subtotal_minor * coalesce(tax_rate_bp, 800) + 5000) // 10000 + CASE WHEN po_id % 31 = 0 THEN 3 ELSE 0 END AS tax_minor
  FROM h JOIN sup ON sup.supplier_id = h.sk
), h3 AS (
  SELECT *, max(day) OVER (PARTITION BY po_id) AS order_day, po_id % 34 = 17 AND invoice_id % 3 = 0 AS renamed,
    (CASE WHEN po_id % 17 = 0 OR po_id % 15 = 0 THEN po_id * 3 ELSE invoice_id END * 48271) % 8999993 + 1000000 AS n0 FROM h2
), h4 AS (
  SELECT *, CASE WHEN po_id % 15 = 0 AND po_id % 17 <> 0 THEN n0 - n0 % 10 + invoice_id % 3 ELSE n0 END AS n FROM h3
), inv AS (
  SELECT tenant_id, invoice_id, po_id, sk AS true_supplier_id, CASE WHEN po_id % 43 <> 0 AND po_id % 53 <> 0 AND NOT renamed THEN sk END AS supplier_id,
    CASE WHEN po_id % 53 = 0 THEN NULL WHEN po_id % 43 = 0 THEN 'Unknown Vendor ' || (po_id % 10) WHEN renamed THEN name || ' Ltd' WHEN po_id % 2 = 0 THEN upper(replace(name, '#', '  ')) ELSE name END AS supplier_name,
    CASE WHEN po_id % 3 = 0 THEN NULL WHEN po_id % 47 = 0 THEN 'TX-' || (sk + 1) ELSE 'tx-' || sk END AS supplier_tax_id,
    CASE WHEN po_id % 61 = 0 THEN NULL WHEN po_id % 59 = 0 THEN sha256('other-' || sk) ELSE sha256('bank-' || sk) END AS bank_account_hash,
    po_id % 61 = 0 AND po_id % 2 = 0 AS bank_absence_certain,
    CASE WHEN po_id % 103 = 0 THEN NULL WHEN po_id % 2 = 0 THEN 'INV-' || lpad(CAST(n AS VARCHAR), 9, '0') ELSE 'inv ' || n END AS invoice_number,
    CASE WHEN po_id % 79 <> 0 THEN CASE WHEN po_id % 15 = 0 THEN order_day ELSE day END END AS invoice_date, CAST(CASE WHEN po_id % 67 = 0 THEN day - 1 ELSE day + 30 END AS DATE) AS due_date,
    CASE WHEN po_id % 107 = 0 THEN NULL WHEN po_id % 41 = 0 THEN 'JPY' ELSE default_currency END AS currency,
    CASE WHEN po_id % 107 = 0 THEN '$' END AS printed_currency, subtotal_minor, tax_minor,
    CASE WHEN po_id % 73 = 0 OR po_id % 90 = 45 THEN NULL WHEN po_id % 5 = 0 THEN 50000 ELSE subtotal_minor + tax_minor + CASE WHEN po_id % 37 = 0 THEN 5 ELSE 0 END END AS total_minor,
    CASE WHEN po_id % 7 = 0 THEN NULL WHEN po_id % 19 = 0 THEN 'PO-9' || po_id || '9' WHEN po_id % 2 = 0 THEN 'po' || po_id ELSE 'PO-' || po_id END AS po_number,
    CASE WHEN day >= DATE '2001-08-01' AND invoice_id % 5 < 3 THEN ['received', 'extracted', 'extracting'][invoice_id % 5 + 1] WHEN invoice_id % 97 = 0 THEN 'failed' WHEN invoice_id % 89 = 0 THEN 'rejected' ELSE 'checking' END AS status,
    CAST(day AS TIMESTAMP) AS created_at FROM h4
)
"""
