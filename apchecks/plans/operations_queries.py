"""Queries of operations, ingest, parsing, evidence and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers
from ..functions.keys import text_key
from ..operators import ingest, operations

CAP = 1_000_000
NOW = "2024-01-20 12:00:00"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    out_tokens = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        F.col("event_id").alias("call_id"), F.concat(F.lit("t"), (F.col("user_id") % 10).cast("string")).alias("tenant_id"), F.col("ts").alias("created_at"),
        operations.cost_micros(_cents("value"), out_tokens, 3_000_000, 15_000_000).alias("cost_micros"),
        F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"),
        F.when(F.col("event_type") != "view", F.col("props")).alias("response"),
        operations.request_hash(F.concat(F.lit("file-"), (F.col("user_id") % 50).cast("string")), F.col("event_type"), F.lit("v1")).alias("request_hash"),
    )


def _texts(df: DataFrame, *dates: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in dates})


def daily_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(operations.daily_spend(_calls(spark, sf_dir), CAP), "day", "resume_on")


def running_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(operations.first_past_cap(_calls(spark, sf_dir), CAP // 20), "day")


def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _calls(spark, sf_dir)
    requests = calls.filter(F.col("call_id") % 3 == 0).select("tenant_id", "request_hash", F.col("call_id").alias("request_id"))
    return operations.cache_hits(requests, calls.filter(F.col("call_id") % 3 != 0))


_STATUS = {"view": "received", "click": "extracting", "signup": "extracted", "purchase": "checking", "error": "failed"}
_JOBS = {"view": "queued", "click": "running", "signup": "queued", "purchase": "done", "error": "failed"}


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def status_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    return operations.status_timeline(e.select(F.col("user_id").alias("invoice_id"), "event_id", _map(_STATUS)[F.col("event_type")].alias("status"), F.col("ts").alias("created_at")))


def queue_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    jobs = e.select(
        F.concat(F.lit("t"), (F.col("user_id") % 10).cast("string")).alias("tenant_id"), _map(_JOBS)[F.col("event_type")].alias("status"),
        F.col("ts").alias("locked_at"), F.col("ts").alias("run_after"),
    )
    return operations.queue_health(jobs, NOW)


def exact_file_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    return operations.exact_copies(d.select(F.col("lang").alias("tenant_id"), F.col("doc_id").alias("file_id"), F.sha2("text", 256).alias("sha256")))


def upload_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "pages")
    kind = F.col("page_id") % 5
    text = F.when(kind == 0, F.concat(F.lit("%PDF-1.4 "), F.col("html"))).when(kind == 1, "").when(kind == 2, F.concat(F.lit("%PDF-"), F.substring("html", 1, 10))).otherwise(F.col("html"))
    files = p.select(
        F.col("page_id").alias("file_id"), F.concat(F.col("url"), F.lit("<x>.pdf")).alias("name"), text.cast("binary").alias("content"),
        (F.col("page_id") % 13).cast("int").alias("pages"), (F.length(text) % 40).alias("text_chars"),
    )
    return ingest.check_uploads(files, 4000)


def _printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts of line items, printed in several ways by remainder."""
    li = _table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 12).alias("kind"), _cents("l_extendedprice").alias("m")).distinct()
    whole, cents = F.expr("m div 100"), F.lpad((F.col("m") % 100).cast("string"), 2, "0")
    us = F.format_number(whole, 0)
    eu, sp = F.regexp_replace(us, ",", "."), F.regexp_replace(us, ",", " ")
    j = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    kind = F.col("kind")
    text = (
        F.when(kind == 0, j(us, ".", cents)).when(kind == 1, j(eu, ",", cents)).when(kind == 2, j(sp, ",", cents)).when(kind == 3, eu).when(kind == 4, us)
        .when(kind == 5, j("-", whole.cast("string"), ".", cents)).when(kind == 6, j("(", us, ".", cents, ")")).when(kind == 7, j("$", us, ".", cents))
        .when(kind == 8, j(eu, ",", cents, " EUR")).when(kind == 9, j(whole.cast("string"), ",", cents, "5")).when(kind == 10, j("0", whole.cast("string"), ".", cents))
        .otherwise(j("USD ", whole.cast("string"), "..", cents))
    )
    return li.select(text.alias("printed")).distinct()


def parse_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _printed(spark, sf_dir).withColumn("r", numbers.parse_number(F.col("printed")))
    return x.select("printed", F.col("r.value").cast("decimal(20,4)").cast("string").alias("value"), F.col("r.error").alias("error"))


def parse_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _printed(spark, sf_dir).withColumn("r", numbers.parse_money(F.col("printed"), F.lit("USD")))
    return x.select("printed", F.col("r.value").alias("minor"), F.col("r.error").alias("error"))


def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("d"), (F.col("l_orderkey") % 8).alias("kind")).distinct()
    kind, d = F.col("kind"), F.col("d")
    f = lambda p: F.date_format(d, p)
    text = (
        F.when(kind == 0, f("yyyy-MM-dd")).when(kind == 1, f("dd MMM yyyy")).when(kind == 2, f("MMMM dd, yyyy")).when(kind == 3, f("dd.MM.yyyy"))
        .when(kind == 4, f("dd/MM/yyyy")).when(kind == 5, f("M-d-yyyy")).when(kind == 6, f("31.MM.yyyy".replace("31", "'31'"))).otherwise(f("dd/MM/yy"))
    )
    x = days.select(text.alias("printed")).distinct().withColumn("r", numbers.parse_date(F.col("printed")))
    return x.select("printed", F.col("r.value").cast("string").alias("value"), F.col("r.error").alias("error"))


def field_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    tri = lambda n: F.when(k % n == 0, False).when(k % n == 1, True)
    own = F.when(k % 4 == 0, "high").when(k % 4 == 1, "medium").when(k % 4 == 2, "low")
    return d.select("doc_id", numbers.score_field(own, tri(3), tri(5), tri(7)).cast("string").alias("confidence"))


def words_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a document's third and fourth words stand in it as whole tokens, and whether its
    fifteenth character run of three letters stands as a currency code."""
    d = _table(spark, sf_dir, "documents")
    squashed = text_key(F.regexp_replace("text", r"[^\x00-\x7F]", "x"))
    parts = F.split(squashed, " ")
    needle = F.concat_ws(" ", F.get(parts, F.lit(2)), F.get(parts, F.lit(3)))
    broken = F.concat(F.substring(needle, 1, 2), F.lit(" "), F.substring(needle, 4, 50))
    inside = lambda n: F.contains(F.concat(F.lit(" "), squashed, F.lit(" ")), F.concat(F.lit(" "), n, F.lit(" ")))
    return d.select("doc_id", needle.alias("needle"), inside(needle).alias("found"), inside(broken).alias("broken_found"), F.regexp_like("text", F.lit(r"(?i)(?<![A-Za-z])EUR(?![A-Za-z])")).alias("currency_seen"))


def label_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "labels").select(F.concat_ws("", F.col("quality").cast("string"), F.col("toxic").cast("string")).alias("label"), F.col("doc_id").alias("id"))
    return operations.stratified_sample(rows)


def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", (F.col("n_chars") > 2000).cast("int").alias("predicted"))
    rows = _table(spark, sf_dir, "labels").join(d, "doc_id").select("lang", "source", "predicted", F.col("quality").alias("actual"))
    return operations.evaluation(rows, ["lang", "source"])


def conversation_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.max_by("role", "turn").alias("last_role"), F.sum(F.length("text")).alias("chars"), F.max(F.col("role") == "system").alias("has_system")
    )


QUERIES = {
    f.__name__: f
    for f in (
        daily_spend, running_spend, cache_hits, status_timeline, queue_health, exact_file_dedupe, upload_rules, parse_numbers, parse_money,
        parse_dates, field_confidence, words_in_text, label_sample, eval_metrics, conversation_history,
    )
}

_CALLS = """WITH calls AS (
  SELECT event_id AS call_id, 't' || (user_id % 10) AS tenant_id, ts AS created_at,
    (CAST(round(value * 100) AS BIGINT) * 3000000 + CAST(json_extract_string(props, '$.k') AS BIGINT) * 15000000 + 999999) // 1000000 AS cost_micros,
    CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status, CASE WHEN event_type <> 'view' THEN props END AS response,
    sha256(len('file-' || (user_id % 50)) || ':' || 'file-' || (user_id % 50) || '|' || len(event_type) || ':' || event_type || '|2:v1|') AS request_hash FROM events
)
"""

_PRINTED = """WITH li AS (SELECT DISTINCT l_orderkey % 12 AS kind, CAST(round(l_extendedprice * 100) AS BIGINT) AS m FROM lineitem)
, p0 AS (SELECT kind, m // 100 AS w, lpad(CAST(m % 100 AS VARCHAR), 2, '0') AS c, format('{:,}', m // 100) AS us FROM li)
, p1 AS (SELECT *, replace(us, ',', '.') AS eu, replace(us, ',', ' ') AS sp FROM p0)
, p AS (
  SELECT DISTINCT CASE kind WHEN 0 THEN us || '.' || c WHEN 1 THEN eu || ',' || c WHEN 2 THEN sp || ',' || c WHEN 3 THEN eu WHEN 4 THEN us WHEN 5 THEN '-' || w || '.' || c WHEN 6 THEN '(' || us || '.' || c || ')'
    WHEN 7 THEN '$' || us || '.' || c WHEN 8 THEN eu || ',' || c || ' EUR' WHEN 9 THEN w || ',' || c || '5' WHEN 10 THEN '0' || w || '.' || c ELSE 'USD ' || w || '..' || c END AS printed FROM p1
)
"""
_NUMBER = """
, n1 AS (SELECT *, replace(regexp_replace(raw, '^-', ''), ' ', '') AS b, regexp_replace(raw, '^-', '') AS s, raw LIKE '-%' AS neg FROM n0)
, n2 AS (
  SELECT *, regexp_full_match(b, '[1-9]\\d{0,2}[.,]\\d{3}') AS lone,
    CASE WHEN regexp_full_match(b, '\\d+') THEN b
      WHEN regexp_full_match(b, '[1-9]\\d{0,2}(,\\d{3})+\\.\\d+') OR regexp_full_match(b, '[1-9]\\d{0,2}(,\\d{3}){2,}') OR (lim < 3 AND regexp_full_match(b, '[1-9]\\d{0,2},\\d{3}')) THEN replace(b, ',', '')
      WHEN regexp_full_match(b, '[1-9]\\d{0,2}(\\.\\d{3})+,\\d+') THEN replace(replace(b, '.', ''), ',', '.')
      WHEN regexp_full_match(b, '[1-9]\\d{0,2}(\\.\\d{3}){2,}') THEN replace(b, '.', '')
      WHEN regexp_full_match(b, '(0|[1-9]\\d*)[.,]\\d+') THEN replace(b, ',', '.') END AS d FROM n1
), n3 AS (
  SELECT *, CASE WHEN s = '' OR NOT regexp_full_match(s, '[0-9., ]+') OR (contains(s, ' ') AND NOT regexp_full_match(s, '[1-9]\\d{0,2}( \\d{3})+([.,]\\d+)?')) THEN 'NOT_A_NUMBER'
    WHEN lone AND NOT (contains(b, ',') AND coalesce(lim, 9) < 3) THEN 'AMBIGUOUS' WHEN d IS NULL THEN 'NOT_A_NUMBER' WHEN len(regexp_extract(d, '\\.(\\d+)$', 1)) > lim THEN 'TOO_PRECISE' END AS nerr FROM n2
)
"""

ORACLES = {
    "daily_spend": _CALLS
    + f"""SELECT tenant_id, CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, CAST(sum(cost_micros) AS BIGINT) AS spent_micros, count(*) AS calls, sum(cost_micros) >= {CAP} AS cap_reached,
  CAST(CAST(CAST(created_at AS DATE) + 1 AS DATE) AS VARCHAR) AS resume_on FROM calls GROUP BY tenant_id, CAST(created_at AS DATE)""",
    "running_spend": _CALLS
    + f""", r AS (SELECT *, CAST(created_at AS DATE) AS day, sum(cost_micros) OVER (PARTITION BY tenant_id, CAST(created_at AS DATE) ORDER BY created_at, call_id) AS running FROM calls)
SELECT tenant_id, CAST(day AS VARCHAR) AS day, call_id, CAST(running AS BIGINT) AS running_micros FROM r WHERE running >= {CAP // 20} AND running - cost_micros < {CAP // 20}""",
    "cache_hits": _CALLS
    + """, l AS (SELECT tenant_id, request_hash, arg_max(call_id, (created_at, call_id)) AS cached_call_id FROM calls WHERE call_id % 3 <> 0 AND status = 'ok' AND response IS NOT NULL GROUP BY ALL)
SELECT tenant_id, request_hash, call_id AS request_id, cached_call_id FROM calls LEFT JOIN l USING (tenant_id, request_hash) WHERE call_id % 3 = 0""",
    "status_timeline": """WITH e AS (SELECT user_id AS invoice_id, event_id, CASE event_type WHEN 'view' THEN 'received' WHEN 'click' THEN 'extracting' WHEN 'signup' THEN 'extracted' WHEN 'purchase' THEN 'checking' ELSE 'failed' END AS status, ts FROM events)
, w AS (SELECT *, lag(status) OVER x AS previous, lead(ts) OVER x AS until FROM e WINDOW x AS (PARTITION BY invoice_id ORDER BY event_id))
SELECT invoice_id, event_id, status, previous, previous IS NULL OR (previous, status) IN (('received', 'extracting'), ('extracting', 'extracted'), ('extracting', 'failed'), ('failed', 'extracting'), ('extracted', 'checking')) AS legal,
  date_sub('second', ts, until) AS seconds FROM w""",
    "queue_health": f"""WITH j AS (SELECT 't' || (user_id % 10) AS tenant_id, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'done' ELSE 'failed' END AS status, ts FROM events)
SELECT tenant_id, count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed,
  count(*) FILTER (status = 'running' AND date_sub('second', ts, TIMESTAMP '{NOW}') > 300) AS stuck, count(*) FILTER (status = 'queued' AND ts > TIMESTAMP '{NOW}') AS paused,
  max(CASE WHEN status = 'queued' AND ts <= TIMESTAMP '{NOW}' THEN date_sub('second', ts, TIMESTAMP '{NOW}') END) AS oldest_queued_s FROM j GROUP BY 1""",
    "exact_file_dedupe": """WITH d AS (SELECT lang AS tenant_id, doc_id AS file_id, sha256(text) AS sha256 FROM documents)
, w AS (SELECT *, min(file_id) OVER (PARTITION BY tenant_id, sha256) AS e FROM d) SELECT tenant_id, file_id, sha256, CASE WHEN e <> file_id THEN e END AS existing_file_id FROM w""",
    "upload_rules": """WITH f AS (
  SELECT page_id AS file_id, url || '<x>.pdf' AS name, CASE page_id % 5 WHEN 0 THEN '%PDF-1.4 ' || html WHEN 1 THEN '' WHEN 2 THEN '%PDF-' || substr(html, 1, 10) ELSE html END AS t, page_id % 13 AS pages FROM pages
), g AS (SELECT *, len(t) % 40 AS tc, strlen(t) AS size, CASE WHEN t LIKE '\\%PDF-%' ESCAPE '\\' THEN 'application/pdf' END AS mime FROM f)
, h AS (SELECT *, CASE WHEN size <= 0 THEN 'EMPTY_FILE' WHEN size > 4000 THEN 'FILE_TOO_LARGE' WHEN mime IS NULL THEN 'UNSUPPORTED_FILE_TYPE' WHEN pages <= 0 THEN 'UNREADABLE_FILE' WHEN pages > 10 THEN 'TOO_MANY_PAGES' END AS rejected FROM g)
SELECT file_id, coalesce(nullif(left(regexp_replace(regexp_replace(regexp_extract(name, '[^/]*$'), '[<>:"|?*]', '', 'g'), '^[ .]+|[ .]+$', '', 'g'), 200), ''), 'upload') AS name, size, mime, rejected,
  CASE WHEN rejected IS NULL THEN CASE WHEN tc >= 20 THEN 'clean' WHEN tc = 0 THEN 'unknown' ELSE 'scanned' END END AS doc_quality, sha256(t) AS sha256 FROM h""",
    "parse_numbers": _PRINTED
    + ", n0 AS (SELECT printed, trim(printed) AS raw, CAST(NULL AS INTEGER) AS lim FROM p)"
    + _NUMBER
    + "SELECT printed, CASE WHEN nerr IS NULL THEN CAST(CAST(CASE WHEN neg THEN '-' ELSE '' END || d AS DECIMAL(20, 4)) AS VARCHAR) END AS value, nerr AS error FROM n3",
    "parse_money": _PRINTED
    + """, m0 AS (SELECT printed, regexp_full_match(printed, '\\(.*\\)') AS br, trim(CASE WHEN regexp_full_match(printed, '\\(.*\\)') THEN printed[2:-2] ELSE printed END) AS r FROM p)
, m1 AS (SELECT *, regexp_extract(r, '^([A-Za-z]{3})', 1) AS f, regexp_extract(r, '([A-Za-z]{3})$', 1) AS k, trim(regexp_replace(regexp_replace(r, '^[A-Za-z]{3}\\s*', ''), '\\s*[A-Za-z]{3}$', '')) AS r2 FROM m0)
, n0 AS (SELECT *, (f <> '' AND upper(f) <> 'USD') OR (k <> '' AND upper(k) <> 'USD') OR regexp_matches(r2, '[€£¥]') AS other, trim(replace(r2, '$', '')) AS raw, 2 AS lim FROM m1)"""
    + _NUMBER
    + """, z AS (SELECT *, CASE WHEN other THEN 'OTHER_CURRENCY' ELSE nerr END AS error FROM n3)
SELECT printed, CASE WHEN error IS NULL THEN CASE WHEN br OR neg THEN -1 ELSE 1 END * CAST(CAST(d AS DECIMAL(20, 2)) * 100 AS BIGINT) END AS minor, error FROM z""",
    "parse_dates": """WITH x AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d, l_orderkey % 8 AS kind FROM lineitem)
, y AS (
  SELECT *, CASE kind WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN strftime(d, '%d %b %Y') WHEN 2 THEN strftime(d, '%B %d, %Y') WHEN 3 THEN strftime(d, '%d.%m.%Y') WHEN 4 THEN strftime(d, '%d/%m/%Y')
    WHEN 5 THEN month(d) || '-' || day(d) || '-' || year(d) WHEN 6 THEN strftime(d, '31.%m.%Y') ELSE strftime(d, '%d/%m/%y') END AS printed FROM x
), z AS (
  SELECT DISTINCT printed, CASE kind WHEN 4 THEN CASE WHEN day(d) <= 12 AND day(d) <> month(d) THEN 'AMBIGUOUS' END WHEN 5 THEN CASE WHEN day(d) <= 12 AND day(d) <> month(d) THEN 'AMBIGUOUS' END
      WHEN 6 THEN CASE WHEN day(last_day(d)) < 31 THEN 'NOT_REAL' END WHEN 7 THEN 'NOT_A_DATE' END AS error, CASE kind WHEN 6 THEN last_day(d) ELSE d END AS v FROM y
)
SELECT DISTINCT printed, CASE WHEN error IS NULL THEN CAST(CAST(v AS DATE) AS VARCHAR) END AS value, error FROM z""",
    "field_confidence": """WITH s AS (
  SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 0.75 WHEN 1 THEN 0.55 WHEN 2 THEN 0.30 END AS b, doc_id % 3 AS t, doc_id % 5 AS r, doc_id % 7 AS m FROM documents
)
SELECT doc_id, CAST(CAST(coalesce(least(b + CASE WHEN t = 1 THEN 0.15 ELSE 0 END + CASE WHEN r = 1 THEN 0.10 ELSE 0 END + CASE WHEN m = 1 THEN 0.10 ELSE 0 END + CASE WHEN b IS NULL THEN NULL ELSE 0 END,
  CASE WHEN b IS NULL THEN NULL WHEN t = 0 OR r = 0 OR m = 0 THEN 0.4 ELSE 1 END), 0) AS DECIMAL(5, 4)) AS VARCHAR) AS confidence FROM s""",
    "words_in_text": """WITH s AS (SELECT doc_id, text, trim(regexp_replace(lower(regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g')), '[\\W_]+', ' ', 'g')) AS q FROM documents)
, n AS (SELECT *, array_to_string(list_filter([string_split(q, ' ')[3], string_split(q, ' ')[4]], lambda x: x IS NOT NULL), ' ') AS needle FROM s)
SELECT doc_id, needle, contains(' ' || q || ' ', ' ' || needle || ' ') AS found, contains(' ' || q || ' ', ' ' || substr(needle, 1, 2) || ' ' || substr(needle, 4, 50) || ' ') AS broken_found,
  regexp_matches(text, '(?i)(^|[^A-Za-z])EUR($|[^A-Za-z])') AS currency_seen FROM n""",
    "label_sample": """WITH r AS (SELECT concat(quality, toxic) AS label, doc_id AS id FROM labels)
, w AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('1|' || id), id) AS place, count(*) OVER (PARTITION BY label) AS n FROM r)
SELECT label, id, CAST(place AS INTEGER) AS place FROM w WHERE place <= (n + 1) // 2""",
    "eval_metrics": """WITH r AS (SELECT lang, source, CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END AS p, quality AS a FROM labels JOIN documents USING (doc_id))
SELECT lang, source, count(*) AS n, count(*) FILTER (p = 1 AND a = 1) AS true_raised, count(*) FILTER (p = 1 AND a <> 1) AS false_raised, count(*) FILTER (p = 0 AND a = 1) AS false_clear,
  round(count(*) FILTER (p = 1 AND a = 1) / nullif(count(*) FILTER (a = 1), 0), 6) AS recall, round(count(*) FILTER (p = 1 AND a = 1) / nullif(count(*) FILTER (p = 1), 0), 6) AS "precision",
  round(count(*) FILTER (p = 0) / count(*), 6) AS touchless, grouping(lang, source) AS level FROM r GROUP BY ROLLUP (lang, source)""",
    "conversation_history": """SELECT conv_id, count(*) AS turns, arg_max(role, turn) AS last_role, CAST(sum(len(text)) AS BIGINT) AS chars, bool_or(role = 'system') AS has_system FROM conversations GROUP BY 1""",
}
