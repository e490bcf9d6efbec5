"""The whole duplicate rule, its similarity join and line pairing against plain versions."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from apchecks.operators import duplicates, matching
from apchecks.operators.keyfilter import keys_of, perhaps_among, shared_keys
from apchecks.operators.near_numbers import Numbers, near_numbers, useful_deletions, with_like

from . import brute

SCHEMA = (
    "tenant_id string, invoice_id long, supplier_id long, supplier_name string, invoice_number string, invoice_date date, total_minor long, currency string, "
    "status string, created_at timestamp_ntz"
)


def invoice(i, number="INV-1043", supplier=1, name="Acme Ltd", day=date(2026, 5, 1), total=50000, currency="USD", status="checking", tenant="t", at=None):
    return dict(
        tenant_id=tenant, invoice_id=i, supplier_id=supplier, supplier_name=name, invoice_number=number, invoice_date=day, total_minor=total, currency=currency,
        status=status, created_at=at or datetime(2026, 5, 1) + timedelta(hours=i),
    )


def checked(spark, rows):
    got = duplicates.check_duplicates(spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA)).collect()
    return {r["invoice_id"]: (r["outcome"], r["reason"]) for r in got}


CASES = {
    "linked, then unlinked with the name in other letters": ([invoice(1, name="Acme"), invoice(2, supplier=None, name="ACME")], ("fail", None)),
    "unlinked, then linked with the same name": ([invoice(1, supplier=None, name="Acme, Ltd."), invoice(2)], ("fail", None)),
    "like number without a total": ([invoice(1), invoice(2, number="INV-1034", total=None)], ("skipped", "INCOMPLETE_FOR_SOFT_MATCH")),
    "like number, the earlier one without a date": ([invoice(1, day=None), invoice(2, number="INV-1034")], ("skipped", "INCOMPLETE_FOR_SOFT_MATCH")),
    "like number, zero total": ([invoice(1, total=0), invoice(2, number="INV-1034", total=0)], ("skipped", "INCOMPLETE_FOR_SOFT_MATCH")),
    "a received copy of an earlier invoice": ([invoice(1), invoice(2, status="received")], ("fail", None)),
    "an earlier invoice that is still being read": ([invoice(1, number="X-9", status="extracted"), invoice(2)], ("skipped", "EARLIER_INVOICES_STILL_PENDING")),
    "an extracted copy is not compared with": ([invoice(1, status="extracted"), invoice(2)], ("skipped", "EARLIER_INVOICES_STILL_PENDING")),
    "a failed copy is not compared with": ([invoice(1, status="failed"), invoice(2)], ("pass", None)),
    "one company written two ways": ([invoice(1, supplier=None, name="Acme Limited"), invoice(2)], ("skipped", "SUPPLIER_UNCERTAIN")),
    "an earlier one without a name": ([invoice(1, supplier=None, name=" "), invoice(2)], ("skipped", "SUPPLIER_UNCERTAIN")),
    "other companies": ([invoice(1, supplier=None, name="Zebra Bolts"), invoice(2)], ("pass", None)),
    "two unknown senders": ([invoice(1, supplier=None, name="Acme Limited"), invoice(2, supplier=None)], ("pass", None)),
    "other records of one name": ([invoice(1, supplier=2), invoice(2)], ("pass", None)),
    "soft": ([invoice(1), invoice(2, number="INV-1034", day=date(2026, 5, 8), currency="usd")], ("fail", None)),
    "soft, eight days": ([invoice(1), invoice(2, number="INV-1034", day=date(2026, 5, 9))], ("pass", None)),
    "hard before incomplete": ([invoice(1, number="INV-01043"), invoice(2, total=None)], ("fail", None)),
    "incomplete before uncertain": ([invoice(1, supplier=None, name="Acme Limited"), invoice(2, day=None, number="1043"), invoice(3)], ("skipped", "INCOMPLETE_FOR_SOFT_MATCH")),
    "nobody": ([invoice(1), invoice(2, supplier=None, name="--")], ("skipped", "NO_SUPPLIER")),
    "no number": ([invoice(1), invoice(2, number=" - ")], ("skipped", "NO_INVOICE_NUMBER")),
    "another tenant": ([invoice(1, tenant="u"), invoice(2)], ("pass", None)),
}


def test_cases(spark):
    rows, want = [], {}
    for n, (case, expected) in enumerate(CASES.values()):
        for r in case:
            rows.append(r | {"tenant_id": f"{n}-{r['tenant_id']}", "invoice_id": n * 10 + r["invoice_id"]})
        want[n * 10 + case[-1]["invoice_id"]] = expected
    got = checked(spark, rows)
    assert {name: got[k] for name, k in zip(CASES, want)} == {name: want[k] for name, k in zip(CASES, want)}
    assert len(got) == len(rows)


def test_generated(spark):
    rng = random.Random(11)
    names = ["Acme Ltd", "ACME LTD", "Acme, Limited", "Bolt & Co", "Bolt and Co", "Zebra", None, " "]
    rows = []
    for i in range(260):
        digits = "".join(rng.choice("012") for _ in range(rng.choice([3, 4, 4, 5, 15])))
        rows.append(
            invoice(
                i, number=rng.choice(["INV-{}", "inv {}", "{}", "00{}", "A{}B"]).format(digits) if rng.random() < 0.95 else None, supplier=rng.choice([1, 1, 2, None, None]), name=rng.choice(names),
                day=None if rng.random() < 0.1 else date(2026, 5, 1) + timedelta(days=rng.randrange(12)), total=rng.choice([100, 100, 200, 0, None]), currency=rng.choice(["USD", "usd", "USD", "EUR", "", None]),
                status=rng.choice(["checking"] * 8 + ["failed", "rejected"] + (["received", "extracted"] if i > 150 else [])), tenant=rng.choice("tu"), at=datetime(2026, 5, 1) + timedelta(hours=i // 3),
            )
        )
    got = checked(spark, rows)
    want = {r["invoice_id"]: brute.duplicate(r, rows) for r in rows}
    assert got == want
    assert len({w for w in want.values()}) == 7


def test_empty(spark):
    assert checked(spark, []) == {}


@pytest.mark.parametrize("least", [85, 95, 72, 60])
def test_near_numbers(spark, least):
    rng = random.Random(least)
    keys = set()
    for _ in range(60):
        base = rng.choice(["INV", "", "A", "INVOICE2024", "Z9"]) + "".join(rng.choice("0123") for _ in range(rng.choice([1, 3, 4, 5, 6, 8, 10])))
        keys.add(base)
        for _ in range(3):
            i = rng.randrange(len(base))
            keys.add(rng.choice([base[:i] + base[i + 1 :], base[:i] + rng.choice("0123AB") + base[i:], base[:i] + rng.choice("0123AB") + base[i + 1 :]]))
    rows = [(f"t{i % 2}", k) for i, k in enumerate(sorted(keys - {""}))]
    df = spark.createDataFrame([*rows, *rows[:5], ("t0", ""), ("t1", None)], "t string, number string")
    got = {(r["t"], r["a"], r["b"]): round(r["similarity"], 9) for r in near_numbers(df, df, ["t"], least).collect()}
    assert got == {(t, a, b): round(s, 9) for t, a in rows for u, b in rows if t == u and (s := brute.similarity(a, b)) >= least}


def test_line_pairs(spark):
    rng = random.Random(5)
    texts = ["Blue widget large", "large blue Widget", "Steel bracket", "Steel brackets", "steel bracket x", "Copper pipe", None, "  "]
    lines, order, want = [], [], set()
    for k in range(60):
        mine = [dict(invoice_id=k, matched_po_id=k, line_no=n, sku=rng.choice(["A-1", "a1", "B2", None, None]), description=rng.choice(texts), amount_minor=rng.choice([100, 200, 300, None])) for n in range(rng.randrange(1, 6))]
        theirs = [dict(po_id=k, po_line_id=k * 10 + n, line_no=n, sku=rng.choice(["A-1", "B-2", "C3", None]), description=rng.choice(texts), qty=rng.choice([1, 2]), unit_price_minor=rng.choice([100, 150])) for n in range(rng.randrange(1, 6))]
        want |= {(k, *p) for p in brute.pair_lines(mine, theirs)}
        lines += mine
        order += theirs
    left = spark.createDataFrame(lines, "invoice_id long, matched_po_id long, line_no long, sku string, description string, amount_minor long")
    right = spark.createDataFrame(order, "po_id long, po_line_id long, line_no long, sku string, description string, qty long, unit_price_minor long")
    got = {(r["invoice_id"], r["line_no"], r["po_line_id"], r["method"]) for r in matching.pair_lines(left, right).collect()}
    assert got == want
    assert {w[3] for w in want} == {"sku", "description", "amount"}


def test_variants_are_never_broadcast(spark):
    """A text has hundreds of variants, which the optimizer's size of a side doesn't count."""
    rows = spark.createDataFrame([("t", "INV001234567"), ("t", "INV001234568")], "tenant_id string, number string")
    plan = near_numbers(rows, rows, ["tenant_id"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("least", [85, 72])
def test_near_numbers_of_one_head(spark, least):
    rng = random.Random(least)
    keys = sorted({f"{'INV' if least == 85 else ''}{rng.choice(['', '', '0', '00'])}{''.join(rng.choice('012') for _ in range(rng.choice([1, 4, 7, 7, 12])))}" for _ in range(120)})
    df = spark.createDataFrame([("t", k) for k in keys], "t string, number string")
    got = {(r["a"], r["b"]): round(r["similarity"], 9) for r in near_numbers(df, df, ["t"], least).collect()}
    assert got == {(a, b): round(s, 9) for a in keys for b in keys if (s := brute.similarity(a, b)) >= least}


def test_few_variants():
    """A number with two leading zeros meets one without them by its canonical form, not by all ways to delete two characters."""
    assert useful_deletions({("key", "z", 12)}, {("key", "z", 12), ("key", "n", 10)}, 85) == {("key", "z", 12): 1}
    assert useful_deletions({("key", "", 12)}, {("key", "", 10)}, 85) == {("key", "", 12): 2}


def test_names_compared_by_edit_distance(spark):
    rng = random.Random(3)
    names = ["".join(rng.choice("abc ") for _ in range(rng.randrange(1, 9))).strip() or "a" for _ in range(40)]
    rows = [(a, b) for a in names for b in names]
    got = spark.createDataFrame(rows, "x string, y string").select(duplicates.could_be_one("x", "y").alias("v")).collect()
    ordered = lambda t: " ".join(sorted(t.split(" ")))
    want = [200 * brute.common(ordered(a), ordered(b)) >= 60 * (len(a) + len(b)) for a, b in rows]
    assert [r["v"] for r in got] == want


def test_digits_need_one_form():
    """Numbers without leading zeros, or with equally many, are found by their canonical forms alone."""
    shapes = {("key", "n", 10), ("key", "z2", 12), ("canonical", "", 10)}
    assert useful_deletions(shapes, shapes, 85) == {("canonical", "", 10): 1}
    assert useful_deletions({("key", "z2", 7)}, {("key", "z2", 7)}, 85) == {("key", "z2", 7): 1}


@pytest.mark.parametrize("least", [85, 0])
def test_one_hit_is_enough(spark, least):
    """Like numbers of many invoices make no pairs: a row comes at most once per variant of its number."""
    new = spark.range(200).select(F.lit("t").alias("t"), F.lit("INV1234567").alias("number"), F.col("id").alias("k"))
    old = spark.range(200).select(F.lit("t").alias("t"), F.concat(F.lit("INV123456"), (F.col("id") % 10).cast("string")).alias("number"), (F.col("id") - 100).alias("o"))
    found = with_like(Numbers(new, old, least), new, old, ["t"], F.col("o") > F.col("k"))
    assert found.count() <= 8 * 99
    assert sorted(r["k"] for r in found.distinct().collect()) == list(range(99))


def test_rows_are_filtered_before_they_are_shuffled(spark):
    """A semi-join of the filter, above which the other one stays."""
    rows = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("g"))
    some = rows.filter("k % 100 = 0")
    assert {r["k"] for r in perhaps_among(rows, keys_of(some, ["k"]), ["k"]).collect()} == set(range(0, 1000, 100))
    twice = rows.unionByName(some)
    assert {r["k"] for r in perhaps_among(rows, shared_keys(twice, ["k"]), ["k"]).collect()} == set(range(0, 1000, 100))
    joined = perhaps_among(rows, keys_of(some, ["k"]), ["k"]).hint("merge").join(some.select(F.col("k").alias("o")).hint("merge"), F.col("k") == F.col("o"), "left_semi")
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("(k#") < plan.index("at_row")


def test_pairs_by_sku_are_made_once(spark):
    """They are read three times, and the plan holds no second or third copy of how they were made."""
    left = spark.createDataFrame([(1, 1, 1, "A-1", "Blue widget", 100), (1, 1, 2, None, "Red widget", 100)], "invoice_id long, matched_po_id long, line_no long, sku string, description string, amount_minor long")
    right = spark.createDataFrame([(1, 10, 1, "A1", "Blue widget", 1, 100), (1, 11, 2, None, "red Widget", 1, 100)], "po_id long, po_line_id long, line_no long, sku string, description string, qty long, unit_price_minor long")
    for of in (matching.pair_lines, matching.paired_keys):
        pairs = of(left, right)
        assert {(r["line_no"], r["po_line_id"], r["method"]) for r in pairs.collect()} == {(1, 10, "sku"), (2, 11, "description")}
        assert "Window" not in pairs._jdf.queryExecution().executedPlan().toString()
