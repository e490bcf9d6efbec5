"""Sources and sinks on small tables, checked value by value."""

import datetime
import json

from pyspark.sql import functions as F

from apchecks.operators import review
from apchecks.sources import sinks
from apchecks.sources.shared import derived_once, shared_path


def field(value, page=1):
    return {"value": value, "self_confidence": "high", "page": page}


def test_answers_are_flattened_and_checked(spark, tmp_path):
    answer = {"invoice_id": "a", "total": field("12.00"), "currency": field("E\0R", 3), "supplier_name": field("x" * 2001, 0)}
    answer["lines"] = [{"sku": field("S-1"), "quantity": field("2")}, {"description": field("widget")}]
    (tmp_path / "answers.json").write_text(json.dumps(answer) + "\n")
    read = sinks.read_answers(spark, f"file://{tmp_path}/answers.json")
    header = {r["field"]: r["value"] for r in sinks.header_fields(read).collect()}
    assert set(header) == set(sinks.HEADER_FIELDS) and header["total"] == "12.00" and header["po_number"] is None
    lines = [r.asDict() for r in sinks.line_fields(read).orderBy("line_no").collect()]
    assert [(x["line_no"], x["sku"], x["description"]) for x in lines] == [(1, "S-1", None), (2, None, "widget")]
    pages = spark.createDataFrame([("a", 2)], "invoice_id string, page_count int")
    assert [r["fields"] for r in sinks.invalid_answers(sinks.header_fields(read), pages).collect()] == [["currency", "supplier_name"]]


def test_appending_twice_adds_nothing(spark):
    path = shared_path(spark, "results")
    rows = spark.createDataFrame([(1, "A", "pass"), (1, "B", "fail"), (1, "A", "pass")], "invoice_id long, check_code string, outcome string")
    keys = ["invoice_id", "check_code"]
    assert [sinks.append_new(rows, path, keys), sinks.append_new(rows, path, keys)] == [2, 0]
    more = spark.createDataFrame([(1, "A", "fail"), (2, "A", "pass")], rows.schema)
    assert sinks.append_new(more, path, keys) == 1
    held = sorted(map(tuple, spark.read.parquet(path).collect()))
    assert held == [(1, "A", "pass"), (1, "B", "fail"), (2, "A", "pass")]
    assert sorted(map(tuple, sinks.upsert(rows.distinct(), more, keys).collect())) == [(1, "A", "fail"), (1, "B", "fail"), (2, "A", "pass")]


def test_audit_is_append_only_by_day(spark):
    path = shared_path(spark, "audit")
    event = spark.createDataFrame([("user", "u1", "approved", datetime.datetime(2026, 1, 2, 3))], "actor_type string, actor_id string, event_type string, created_at timestamp")
    for _ in range(2):
        sinks.append_audit(event, path)
    assert [(str(r["day"]), r["count"]) for r in spark.read.parquet(path).groupBy("day").count().collect()] == [("2026-01-02", 2)]


def test_bill_payloads_and_exports(spark, tmp_path):
    bills = spark.createDataFrame([(1, "c", "N-1", datetime.date(2026, 1, 2), "USD", 12345), (2, "c", "N-2", None, "JPY", 500)], "invoice_id long, contact_id string, invoice_number string, invoice_date date, currency string, total_minor long")
    lines = spark.createDataFrame([(1, 2, "b", 45), (1, 1, "a", 12300), (2, 1, "j", 500)], "invoice_id long, line_no int, description string, amount_minor long")
    body = {r["invoice_id"]: json.loads(r["payload"]) for r in sinks.bill_payloads(bills, lines).collect()}
    assert body[1]["total"] == 123.45 and [x["amount"] for x in body[1]["lines"]] == [123.0, 0.45] and body[1]["status"] == "DRAFT"
    assert body[2]["total"] == 500 and "date" not in body[2]
    status = bills.withColumn("status", F.when(F.col("invoice_id") == 1, "approved").otherwise("rejected"))
    sinks.export_approved(status, f"file://{tmp_path}/csv")
    sinks.export_approved(status, f"file://{tmp_path}/json", "json")
    assert [r["invoice_number"] for r in spark.read.option("header", True).csv(f"file://{tmp_path}/csv").collect()] == ["N-1"]
    assert [r["total_minor"] for r in spark.read.json(f"file://{tmp_path}/json").collect()] == [12345]


def test_folder_report(spark, tmp_path):
    for name, content in {"a.pdf": b"%PDF-1", "b.pdf": b"%PDF-1", ".hidden": b"x", "big.bin": b"y" * 50}.items():
        (tmp_path / name).write_bytes(content)
    got = {r["path"].rsplit("/", 1)[1]: r["status"] for r in sinks.ingest_folder(spark, f"file://{tmp_path}", 20).collect()}
    assert got == {"a.pdf": "accepted", "b.pdf": "duplicate", "big.bin": "rejected"}


def test_manifest(spark):
    truths = spark.createDataFrame([("clean", ["NO_PO", "TAX_MISMATCH"]), ("clean", []), ("photo", ["NO_PO"])], "doc_quality string, must_raise array<string>")
    got = {(r["kind"], r["name"]): (r["n"], r["share"]) for r in sinks.manifest(truths).collect()}
    assert got == {("quality", "clean"): (2, 0.6667), ("quality", "photo"): (1, 0.3333), ("code", "NO_PO"): (2, None), ("code", "TAX_MISMATCH"): (1, None)}


def test_derived_tables_are_written_once(spark):
    calls = []
    build = lambda: calls.append(1) or spark.range(3)
    assert [derived_once(spark, "here", "t", build).count() for _ in range(2)] == [3, 3] and len(calls) == 1


def test_confidence_reasons_in_order(spark):
    schema = "c double, s struct<normalize_error string, missing boolean, text_layer boolean, rule boolean, master_data boolean, self_confidence string>"
    cases = [
        (None, (None,) * 6, "it was not read"), (0.9, ("X", True, False, None, None, "low"), None),
        (0.1, ("NO_CURRENCY", True, None, None, None, None), "the amount has no currency to read it in"),
        (0.1, (None, True, False, None, None, None), "it was not found on the document"),
        (0.1, (None, False, None, False, False, None), "it disagrees with another value on the invoice"),
        (0.1, (None, None, None, None, None, "medium"), "the reader was not sure of it"),
        (0.1, (None, None, True, None, None, "high"), "its confidence is below the minimum"),
    ]
    rows = spark.createDataFrame([c[:2] for c in cases], schema).coalesce(1)
    assert [r[0] for r in rows.select(review.confidence_reason(F.col("c"), F.col("s"))).collect()] == [c[2] for c in cases]
