"""Streams against their batch twins, with events that arrive in any order within the delay."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from apchecks.operators import matching
from apchecks.streaming import jobs, waiting

EVENTS = "tenant_id string, invoice_id long, kind string, at timestamp, created_at timestamp"
START = datetime(2026, 5, 1)


def reading(rng):
    """Events of invoices that are read within ten minutes, and of some that never are."""
    out = []
    for i in range(120):
        received = START + timedelta(seconds=rng.randrange(7200))
        tenant = rng.choice("ab")
        out.append((tenant, i, "received", received, received))
        if rng.random() < 0.93:
            out.append((tenant, i, rng.choice(["ready"] * 5 + ["failed"]), received + timedelta(seconds=rng.choice([0, 5, 60, 300, 301, 599])), received))
    return out


def test_waiting_equals_batch(spark, tmp_path):
    events = reading(random.Random(4))
    # In files by event time, shuffled inside the delay of twenty minutes.
    rng = random.Random(5)
    arrival = sorted(events, key=lambda e: e[3] + timedelta(seconds=rng.randrange(1200)))
    for n in range(0, len(arrival), 60):
        spark.createDataFrame(arrival[n : n + 60], EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    rows = lambda df: {(r["tenant_id"], r["invoice_id"], r["ready_at"], r["released_at"], r["still_pending"]) for r in df.collect()}
    got = rows(jobs.finish_append(waiting.go_aheads_stream(stream, 300, "20 minutes"), "test-waiting"))
    whole = waiting.go_aheads(spark.createDataFrame(events, EVENTS), 300)
    passed = max(e[3] for e in events) - timedelta(minutes=20)
    want = {r for r in rows(whole) if r[3] <= passed}
    assert got == want and any(r[4] for r in want) and any(not r[4] and r[3] > r[2] for r in want)


def test_running_billing_equals_batch(spark, tmp_path):
    rng = random.Random(6)
    schema = "tenant_id string, matched_po_id long, invoice_id long, created_at timestamp_ntz, status string, billed_minor long"
    rows = [("t", rng.randrange(5), i, START + timedelta(hours=i), rng.choice(["checking", "failed", "approved"]), rng.choice([None, 100, 250])) for i in range(80)]
    for n in range(0, 80, 20):  # a file a batch, in received order
        spark.createDataFrame(rows[n : n + 20], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in-{n // 20}")
    paths = [f"{tmp_path}/in-{n}" for n in range(4)]
    for n, path in enumerate(paths):
        spark.read.parquet(path).withColumn("batch", F.lit(n)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/all")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/all")
    got = jobs.finish_append(jobs.running_billing(stream), "test-billing")
    want = matching.billed_before(spark.createDataFrame(rows, schema))
    key = lambda df: {(r["invoice_id"], r["billed_before_minor"], r["unknown_before"]) for r in df.select("invoice_id", "billed_before_minor", "unknown_before").collect()}
    assert key(got) == key(want)
