from apchecks.sources.ap_view import ApView

from .conftest import SMALL


def test_order_lines_are_shuffled_once(spark):
    """Line numbers and the order's supplier come from one shuffle, which carries the table's own columns only."""
    plan = ApView(spark, SMALL)._order_lines()._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(shuffles) == 1 and "l_orderkey" in shuffles[0]


def test_invoices_add_up_by_order(spark):
    """Heads agree with a plain grouping of the lines, and every order's invoices know its last day."""
    v = ApView(spark, SMALL)
    plain = v.invoice_lines.groupBy("invoice_id", "po_id").agg({"amount_minor": "sum", "ship": "max"}).collect()
    last = {}
    for r in plain:
        last[r["po_id"]] = max(last.get(r["po_id"], r["max(ship)"]), r["max(ship)"])
    expected = {(r["invoice_id"], r["po_id"], r["sum(amount_minor)"] or 0, r["max(ship)"], last[r["po_id"]]) for r in plain}
    heads = v.invoice_heads.select("invoice_id", "po_id", "amounts", "day", "order_day").collect()
    assert {tuple(r) for r in heads} == expected and len(heads) == len(expected)
