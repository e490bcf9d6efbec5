"""Conversation repair against all sequences of edits, and the query's SQL."""

import random
import zlib
from hashlib import sha256

import duckdb
import pytest

from apchecks.llm import queries, repair

STEP = {("0", "u"): "2", ("0", "s"): "1", ("1", "u"): "2", ("2", "a"): "3", ("3", "u"): "2"}


def cheapest(initials, forced, truncated):
    """(cost, audit) over all edits, by trying them; more than three inserts in a row never pay."""
    best = [(3 * len(initials), "D" * len(initials))]

    def go(i, state, cost, audit, inserted):
        if cost > best[0][0]:
            return
        if i == len(initials) and state in "03":
            best[0] = min(best[0], (cost, audit))
        if inserted < 3:
            for c in "ua":
                if (state, c) in STEP:
                    go(i, STEP[state, c], cost + 2, audit + "I", inserted + 1)
        if i < len(initials):
            go(i + 1, state, cost + 3, audit + "D", 0)
            if not forced[i]:
                if (state, initials[i]) in STEP:
                    go(i + 1, STEP[state, initials[i]], cost + truncated[i], audit + "K", 0)
                for c in "ua":
                    if c != initials[i] and (state, c) in STEP:
                        go(i + 1, STEP[state, c], cost + 2 + truncated[i], audit + "R", 0)

    go(0, "0", 0, "", 0)
    return best[0]


@pytest.mark.parametrize("cells", [1 << 24, 1])
def test_align(cells):
    rng = random.Random(cells)
    for _ in range(1500):
        n = rng.randint(0, 7)
        initials = [rng.choice(["s", "u", "a", "u", "a", "x", " ", ""]) for _ in range(n)]
        forced = [rng.random() < 0.2 for _ in range(n)]
        truncated = [not f and rng.random() < 0.3 for f in forced]
        assert repair.align(repair.Turns(initials, forced, truncated), cells) == cheapest(initials, forced, truncated)


def test_long_conversation():
    """A band that is recomputed in blocks gives what a whole table gives."""
    rng = random.Random(2)
    n = 3000
    initials = ["u" if (i + (rng.random() < 0.1)) % 2 == 0 else "a" for i in range(n)]
    turns = repair.Turns(initials, [rng.random() < 0.05 for _ in range(n)], [False] * n)
    whole, blocks = repair.align(turns), repair.align(turns, 1000)
    assert whole == blocks
    fixed = repair.apply_audit([(repair.ROLES[c], "x.") for c in initials], whole[1])
    assert len(fixed) % 2 == 0 and all(r == repair.ROLES["ua"[i % 2]] for i, (r, _) in enumerate(fixed))


SCHEMA = "conv_id long, turn long, role string, text string, audit string, copies_ int"


def odd_rows():
    rng = random.Random(9)
    out = [
        (1, None, "user", "Hi."), (1, 0, None, "x."), (1, 0, "assistant", None), (2, 5, "user", "same."), (2, 5, "user", "same."), (3, 0, "system", "only"),
        (None, 1, "user", "lost."), (None, None, None, None), (4, 9, "tool", "call me."), (4, 7, "", "no role"), (4, 8, "assistant", "\n\t"), (5, 1, "user", "long " * 50_000),
    ]
    for c in range(10, 60):
        for t in range(rng.randint(1, 7)):
            out.append((c, rng.choice([t, t, t + 1, None]), rng.choice(["user", "assistant", "system", "user"]), rng.choice(["Fine.", "ok", "Why?", "Fine.", f"t{t}!", " "])))
    return [(*r, "x", 1) for r in out]


def plain(rows):
    """What the query returns, a conversation at a time; parts of the rule stated anew."""
    said = lambda x: " " if x is None else str(x)
    groups = {}
    for conv, turn, role, text, *_ in rows:
        kept = groups.setdefault(conv, [])
        fault = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = "user" if fault == 4 else said(role), "" if fault == 1 else said(text)
        if fault == 2:
            text = "".join(c for c in text if c not in ".!?")
        kept += [(turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    out = {}
    for conv, kept in groups.items():
        kept = sorted(kept, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults = []
        for i, (_, role, text) in enumerate(kept):
            bare = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
            again = any(k[1:] == (role, text) for k in kept[:i])
            faults.append("blank" if not bare else "duplicate" if again else "truncated" if bare[-1] not in ".!?" else "")
        initials = [r[1][:1] for r in kept]
        cost, audit = cheapest(initials, [f in ("blank", "duplicate") for f in faults], [f == "truncated" for f in faults])
        turns = {r[0] for r in kept if r[0] is not None}
        length = len(audit) - audit.count("D")
        target = ("s" if length % 2 else "") + "ua" * (length // 2)
        lines, at = [], 0
        for letter in audit:
            if letter != "D":
                role = kept[at][1] if letter == "K" else {"u": "user", "a": "assistant"}[target[len(lines)]]
                lines.append(f"{role}:{'' if letter == 'I' else kept[at][2]}")
            at += letter != "I"
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        counts = tuple(faults.count(f) for f in ("blank", "duplicate", "truncated"))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_query_on_odd_rows(spark, tmp_path):
    rows = odd_rows()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    columns = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    ours = {r["conv_id"]: tuple(r[c] for c in columns) for r in queries.QUERIES["op12_conversation_repair"](spark, str(tmp_path)).collect()}
    assert ours == plain(rows)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    theirs = {r[0]: r[1:] for r in con.execute(f"select conv_id, {', '.join(columns)} from ({repair.ORACLE})").fetchall()}
    assert ours == theirs


def test_empty_table(spark):
    assert repair.repair(repair.damage(spark.createDataFrame([], SCHEMA))).count() == 0
