"""Operations: spend, cache, queue health, status timelines, rule versions, exact-file dedupe, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Moves that an invoice's status may make.
TRANSITIONS = {
    "received": ("extracting",),
    "extracting": ("extracted", "failed"),
    "failed": ("extracting",),
    "extracted": ("checking",),
    "checking": ("cleared", "needs_review"),
    "cleared": ("approved", "rejected", "extracted"),
    "needs_review": ("approved", "rejected", "extracted"),
    "approved": ("exported",),
    "rejected": (),
    "exported": (),
}
JOB_STATUSES = ("queued", "running", "done", "failed")


def cost_micros(input_tokens: Column, output_tokens: Column, in_price: int, out_price: int) -> Column:
    """Cost of a call in millionths, rounded up; prices are per million tokens."""
    total = input_tokens * in_price + output_tokens * out_price
    return F.expr("0").cast("long") - F.floor(-total / F.lit(1_000_000)).cast("long")


def daily_spend(calls: DataFrame, cap_micros: int | None = None) -> DataFrame:
    """Spend per tenant and UTC day of ``calls`` (tenant_id, created_at, cost_micros), and whether it reached the cap."""
    out = calls.groupBy("tenant_id", F.to_date("created_at").alias("day")).agg(F.sum("cost_micros").alias("spent_micros"), F.count("*").alias("calls"))
    reached = F.lit(False) if cap_micros is None else F.col("spent_micros") >= cap_micros
    return out.select("tenant_id", "day", "spent_micros", "calls", reached.alias("cap_reached"), F.date_add("day", 1).alias("resume_on"))


def first_past_cap(calls: DataFrame, cap_micros: int) -> DataFrame:
    """The call with which each tenant's spend of a day reached the cap."""
    w = Window.partitionBy("tenant_id", F.to_date("created_at")).orderBy("created_at", "call_id").rowsBetween(Window.unboundedPreceding, 0)
    c = calls.withColumn("running_micros", F.sum("cost_micros").over(w))
    hit = c.filter((F.col("running_micros") >= cap_micros) & (F.col("running_micros") - F.col("cost_micros") < cap_micros))
    return hit.select("tenant_id", F.to_date("created_at").alias("day"), "call_id", "running_micros")


def cache_hits(requests: DataFrame, calls: DataFrame) -> DataFrame:
    """The latest successful answer of each request, by tenant and request hash; null where there is none."""
    ok = calls.filter((F.col("status") == "ok") & F.col("response").isNotNull())
    latest = ok.groupBy("tenant_id", "request_hash").agg(F.max_by("call_id", F.struct("created_at", "call_id")).alias("cached_call_id"))
    return requests.join(latest, ["tenant_id", "request_hash"], "left")


def request_hash(*parts: Column) -> Column:
    """SHA-256 over length-prefixed parts, so that characters can't move between them."""
    pieces = [F.concat(F.length(p).cast("string"), F.lit(":"), p, F.lit("|")) for p in parts]
    return F.sha2(F.concat(*pieces), 256)


def queue_health(jobs: DataFrame, now: str, timeout_s: int = 300) -> DataFrame:
    """One row per tenant: jobs by status (zeros kept), stuck and paused ones, age of the oldest ready one."""
    at = F.lit(now).cast("timestamp_ntz")
    status = F.col("status")
    counts = [F.count_if(status == s).alias(s) for s in JOB_STATUSES]
    seconds = lambda a, b: F.timestamp_diff("SECOND", a, b)
    return jobs.groupBy("tenant_id").agg(
        *counts,
        F.count_if((status == "running") & (seconds(F.col("locked_at"), at) > timeout_s)).alias("stuck"),
        F.count_if((status == "queued") & (F.col("run_after") > at)).alias("paused"),
        F.max(F.when((status == "queued") & (F.col("run_after") <= at), seconds(F.col("run_after"), at))).alias("oldest_queued_s"),
    )


def status_timeline(events: DataFrame) -> DataFrame:
    """Each status with the one before, the seconds spent in it, and whether the move was allowed."""
    w = Window.partitionBy("invoice_id").orderBy("event_id")
    allowed = F.create_map(*(x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))))
    e = events.withColumns({"previous": F.lag("status").over(w), "until": F.lead("created_at").over(w)})
    legal = F.col("previous").isNull() | F.array_contains(allowed[F.col("previous")], F.col("status"))
    return e.select(
        "invoice_id", "event_id", "status", "previous", legal.alias("legal"), F.timestamp_diff("SECOND", F.col("created_at"), F.col("until")).alias("seconds")
    )


def latest_versions(results: DataFrame) -> DataFrame:
    """The result of the highest rule version per invoice and check; versions compare as numbers."""
    number = F.regexp_replace("rule_version", "^[vV]+", "").cast("long")
    best = F.max_by(F.struct("rule_version", "outcome"), number).alias("b")
    return results.groupBy("invoice_id", "check_code").agg(best).select("invoice_id", "check_code", "b.rule_version", "b.outcome")


def exact_copies(files: DataFrame) -> DataFrame:
    """Files whose content hash an earlier file of the tenant has, with that file's id.

    Only hashes are shuffled; the window orders equal files by arrival.
    """
    w = Window.partitionBy("tenant_id", "sha256").orderBy("file_id")
    f = files.withColumn("existing_file_id", F.first("file_id").over(w))
    return f.select("tenant_id", "file_id", "sha256", F.when(F.col("existing_file_id") != F.col("file_id"), F.col("existing_file_id")).alias("existing_file_id"))


def stratified_sample(rows: DataFrame, seed: str = "1") -> DataFrame:
    """Half of each label's rows, rounded up, in the order of a seeded hash."""
    order = Window.partitionBy("label").orderBy(F.md5(F.concat(F.lit(seed), F.lit("|"), F.col("id").cast("string"))), "id")
    everyone = Window.partitionBy("label")
    r = rows.withColumns({"place": F.row_number().over(order), "n": F.count("*").over(everyone)})
    return r.filter(F.col("place") <= F.ceil(F.col("n") / 2)).select("label", "id", "place")


def evaluation(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Precision, recall and false clears of ``predicted`` against ``actual`` (0/1), with all subtotals."""
    p, a = F.col("predicted") == 1, F.col("actual") == 1
    out = rows.rollup(*groups).agg(
        F.count("*").alias("n"), F.count_if(p & a).alias("true_raised"), F.count_if(p & ~a).alias("false_raised"),
        F.count_if(~p & a).alias("false_clear"),
        F.round(F.count_if(p & a) / F.nullif(F.count_if(a), F.lit(0)), 6).alias("recall"),
        F.round(F.count_if(p & a) / F.nullif(F.count_if(p), F.lit(0)), 6).alias("precision"),
        F.round(F.count_if(~p) / F.count("*"), 6).alias("touchless"), F.grouping_id().alias("level"),
    )
    return out
