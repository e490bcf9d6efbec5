"""Plain versions of the rules, a pair at a time, for comparison on generated rows."""

import re


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def ratio(a, b):
    return 100.0 if not a and not b else 200.0 * common(a, b) / (len(a) + len(b))


def number(text):
    return re.sub(r"[^A-Z0-9]", "", (text or "").upper())


def canonical(key):
    return re.sub(r"\d+", lambda m: m.group().lstrip("0") or "0", key)


def similarity(a, b):
    best = max(ratio(a, b), ratio(canonical(a), canonical(b)))
    da, db = re.sub(r"\D", "", a), re.sub(r"\D", "", b)
    return max(best, ratio(da, db)) if len(da) >= 4 and len(db) >= 4 else best


def words(text):
    return " ".join(re.sub(r"[^\w\s]", " ", (text or "").lower()).split())


def in_order(text):
    return " ".join(sorted(text.split()))


def relation(new, old):
    """True, False or None of two invoices having one supplier; "out" where the earlier one is not looked at."""
    ia, ib, na, nb = new["supplier_id"], old["supplier_id"], words(new["supplier_name"]), words(old["supplier_name"])
    if ia is None and ib is not None and (new["supplier_name"] or "").lower() != (old["supplier_name"] or "").lower():
        return "out"
    if ia is not None and ib is not None:
        return ia == ib
    if na and nb:
        if na == nb:
            return True
        return False if ia is None and ib is None or ratio(in_order(na), in_order(nb)) < 60 else None
    return None


def duplicate(new, rows, window=7, least=85):
    """Outcome and reason of the duplicate check."""
    at = lambda r: (r["created_at"], r["invoice_id"])
    if new["supplier_id"] is None and not words(new["supplier_name"]):
        return "skipped", "NO_SUPPLIER"
    key = number(new["invoice_number"])
    if not key:
        return "skipped", "NO_INVOICE_NUMBER"
    before = [r for r in rows if r["tenant_id"] == new["tenant_id"] and at(r) < at(new)]
    whole = lambda r: bool(r["total_minor"]) and r["invoice_date"] is not None and bool(r["currency"])
    hard = soft = lacking = unsure = False
    for old in sorted(before, key=at):
        other = number(old["invoice_number"])
        same = relation(new, old)
        if old["status"] in ("received", "extracting", "extracted", "failed") or not other or same is False or same == "out":
            continue
        alike = similarity(key, other) >= least
        if same is None:
            unsure |= alike
            continue
        hard |= canonical(key) == canonical(other)
        lacking |= alike and not (whole(new) and whole(old))
        soft |= (
            alike and whole(new) and whole(old) and new["currency"].upper() == old["currency"].upper() and new["total_minor"] == old["total_minor"]
            and abs((new["invoice_date"] - old["invoice_date"]).days) <= window
        )
    if hard or soft:
        return "fail", None
    reason = "INCOMPLETE_FOR_SOFT_MATCH" if lacking else "SUPPLIER_UNCERTAIN" if unsure else None
    if reason is None and any(r["status"] in ("received", "extracting", "extracted") for r in before):
        reason = "EARLIER_INVOICES_STILL_PENDING"
    return ("skipped", reason) if reason else ("pass", None)


def pair_lines(lines, order, least=80):
    """(line_no, po_line_id, method) of an invoice's lines and its order's lines."""
    text = lambda t: in_order(re.sub(r"[\W_]+", " ", (t or "").lower()).strip())
    used, found = set(), {}

    def fits(line, o):
        a, b = number(line["sku"]), number(o["sku"])
        return o["po_line_id"] not in used and not (a and b and a != b)

    def take(line, o, method):
        used.add(o["po_line_id"])
        found[line["line_no"]] = (line["line_no"], o["po_line_id"], method)

    for line in lines:
        same = [o for o in order if o["po_line_id"] not in used and number(o["sku"]) == number(line["sku"])]
        if number(line["sku"]) and len(same) == 1 and sum(number(o["sku"]) == number(line["sku"]) for o in order) == 1:
            take(line, same[0], "sku")
    for line in lines:
        if line["line_no"] in found or not text(line["description"]):
            continue
        scored = sorted(((ratio(text(line["description"]), text(o["description"])), i, o) for i, o in enumerate(order) if fits(line, o)), key=lambda s: -s[0])
        if scored and scored[0][0] >= least and (len(scored) == 1 or scored[0][0] - scored[1][0] >= 5):
            take(line, scored[0][2], "description")
    for line in lines:
        if line["line_no"] not in found and line["amount_minor"] is not None:
            same = [o for o in order if fits(line, o) and o["qty"] * o["unit_price_minor"] == line["amount_minor"]]
            if len(same) == 1:
                take(line, same[0], "amount")
    return set(found.values())
