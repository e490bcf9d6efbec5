"""Personal data: base spans against plain patterns, the bootstrapping against a plain version of its scores."""

import random
import re
from collections import Counter, defaultdict

import pytest

from apchecks.llm import personal

SCHEMA = "doc_id long, text string, base string, rank int"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    values = [int(c) for c in digits][::-1]
    return 12 <= len(values) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(values)) % 10 == 0


def valid(kind, text):
    digits = re.sub(r"\D", "", text)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in text.split(".")), "card": lambda: luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()


def base(text):
    found = [(m.start(), rank, m.end()) for rank, kind in enumerate(personal.KINDS) for m in re.finditer(PLAIN[kind], text or "") if valid(kind, m.group())]
    return sorted(found)


def described(text):
    """Candidates as (start, rank, end, ok, instance, patterns)."""
    out = []
    matches = list(re.finditer(personal.CANDIDATE, text or ""))
    for i, m in enumerate(matches):
        value = re.sub(r" ?[\[({]dot[\])}] ?|[\[({]\.[\])}]", ".", re.sub(r" ?[\[({]at[\])}] ?", "@", m.group()))
        digits = re.sub(r"\D", "", value)
        local = re.search(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$", value)
        if "@" in value:
            rank, instance, shape, ok = 0, value.lower(), re.sub("[0-9]+", "9", re.sub("[A-Za-z]+", "a", value)), True
        elif re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", value):
            rank, instance, shape, ok = 1, value, "9.9.9.9", valid("ip", value)
        elif local and not re.match("[0-9]{4}[ -][0-9]{4}[ -]", value):
            rank, instance, ok = 3, digits, 9 <= len(digits) <= 15
            shape = re.sub(r"[ ()-]+", "-", re.sub("[0-9]", "9", local.group())).strip("-")
        else:
            rank, instance, shape, ok = 2, digits, f"9x{len(digits)}", luhn(digits)
        before = (text[matches[i - 1].end() if i else 0 : m.start()])[-personal.REACH :].lower()
        after = (text[m.end() : matches[i + 1].start() if i + 1 < len(matches) else len(text)])[: personal.REACH].lower()
        words = re.findall(r"[^\W\d_]+", before), re.findall(r"[^\W\d_]+", after)
        patterns = [f"shape|{rank}|{shape}"]
        if words[0]:
            patterns.append(f"left|{rank}|{words[0][-1]}")
            if words[1]:
                patterns.append(f"around|{rank}|{words[0][-1]}|{words[1][0]}")
        out.append((m.start(), rank, m.end(), ok, instance, patterns))
    return out


def plain(texts, least_seeds, least_score, rounds):
    known, occurrences = {}, []
    for row, text in enumerate(texts):
        spans = base(text)
        for start, rank, end, ok, instance, patterns in described(text):
            seed = (start, rank, end) in spans
            if seed or not any(s < end and start < e for s, _, e in spans):
                occurrences.append((row, start, rank, end, ok, instance, patterns, seed))
                known[rank, instance] = known.get((rank, instance), False) or seed
    edges, fine, degree = Counter(), {}, Counter()
    for _, _, rank, _, ok, instance, patterns, _ in occurrences:
        degree[rank, instance] += len(patterns)
        for p in patterns:
            edges[p, (rank, instance)] += 1
            fine[rank, instance] = ok
    total, seeds, support = Counter(), Counter(), Counter()
    for (p, i), n in edges.items():
        total[p] += n
        seeds[p] += n * known[i]
        support[p] += known[i]
    score = {p: seeds[p] / (total[p] + 1) for p in total if support[p] >= least_seeds}
    for _ in range(rounds):
        value = defaultdict(float)
        for (p, i), n in edges.items():
            if not known[i] and fine[i]:
                value[i] += n * score.get(p, 0) / degree[i]
        gain = Counter()
        for (p, i), n in edges.items():
            if not known[i] and fine[i]:
                gain[p] += n * value[i]
        score = {p: (seeds[p] + gain[p]) / (total[p] + 1) for p in score}
    out = [base(t) for t in texts]
    for row, start, rank, end, ok, _, patterns, seed in occurrences:
        if not seed and ok and any(score.get(p, 0) >= least_score for p in patterns):
            out[row].append((start, rank, end))
    return [sorted(o) for o in out]


def texts(rng, n):
    word = lambda: rng.choice("the card call mail from house number server to Ähre été".split())
    digit = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card():
        start = "4" + digit(14)
        return next(start + c for c in "0123456789" if luhn(start + c))

    def thing():
        phone = f"({digit(3)}) {digit(3)}-{digit(4)}"
        ip = ".".join(str(rng.randrange(256)) for _ in range(4))
        mail = f"{word()}.{digit(2)}@mail{digit(1)}.example.com".replace("Ähre", "a").replace("été", "e")
        c = card()
        return rng.choice([
            "+1 " + phone, "+1 " + phone, phone, ip, ip, ip.replace(".", "[.]"), "999.1.2.3", mail, mail, mail.replace("@", " [at] ").replace(".com", " (dot) com"), c, c, digit(16), f"{c} {ip}",
            f"{c[:4]} {c[4:8]}-{c[8:12]} {c[12:]}", digit(5), f"+1 {phone} {ip}", f"{ip} {c}", "12.5", "a@b", "+12", f"x{c}", f"{mail}.",
        ])

    return [" ".join(rng.choice([word(), word(), thing()]) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


@pytest.mark.parametrize("least_seeds,least_score,rounds", [(5, 0.8, 3), (2, 0.5, 1), (1, 0.3, 2)])
def test_against_plain_version(spark, least_seeds, least_score, rounds):
    rng = random.Random(least_seeds)
    rows = texts(rng, 120)
    rows += rows[:5] + [None, "", "no data at all", "4" * 3000, "1." * 500 + "1", "a.b@" * 40, "+" + "1 " * 300]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(rows)], SCHEMA).repartition(3)
    got = {r["doc_id"]: r for r in personal.find(docs, least_seeds, least_score, rounds).collect()}
    want = plain(rows, least_seeds, least_score, rounds)
    for i, t in enumerate(rows):
        assert [tuple(s) for s in got[i]["base"]] == base(t), t
        assert [tuple(s) for s in got[i]["spans"]] == want[i], t
    assert sum(map(len, want)) > sum(len(base(t)) for t in rows)


def test_repeated_and_missing_ids(spark):
    docs = spark.createDataFrame([(None, "to a.b@c.de now", "x", 1), (7, "10.0.0.1", "x", 1), (7, "10.0.0.1", "x", 1), (8, None, "x", 1)], SCHEMA)
    out = sorted(str((r["doc_id"], [tuple(s) for s in r["spans"]])) for r in personal.find(docs).collect())
    assert out == sorted(map(str, [(None, [(3, 0, 11)]), (7, [(0, 1, 8)]), (7, [(0, 1, 8)]), (8, [])]))
    assert personal.find(docs.limit(0)).count() == 0
