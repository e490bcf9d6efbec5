"""Repair of conversations by Wagner-Fischer alignment with the alternating grammar ``(s?(ua)+)?``.

A repaired conversation has an optional system turn and then pairs of a user's and an assistant's turn.
Rows are aligned with the grammar's string of every feasible length: keeping a row costs 0, giving it
another role 2, deleting it 3, inserting an empty turn 2, and a truncated row that stays 1 more. Blank and
duplicate rows must go. The strings of all lengths are suffixes of one another (behind the system turn),
so that one table of suffix distances holds the alignment with each of them. Ukkonen's band keeps the
table narrow: an incumbent repair, found in one pass, costs so much more than what every repair must pay;
each step off the diagonal adds 2 at least, hence no better repair leaves the band. Of the cheapest
lengths the alignments are traced back, each to its ASCII-least audit, and the least audit of all wins.

A conversation, like a document, is one row of a task. The table takes its length times the band; where
that is much, only some of its rows are kept and the others are computed again while tracing back.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
_SEEN = re.compile(r"[^\x20\x09-\x0D]")
_ENDED = re.compile(r"[.!?][\x20\x09-\x0D]*\Z")
_FAR = 1 << 29
_SCHEMA = (
    "conv_id {}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired array<struct<role:string,text:string>>"
)


@dataclass
class Turns:
    """Rows of one conversation: role initials, whether a row must go, whether it is truncated."""

    initials: list[str]
    forced: list[bool]
    truncated: list[bool]

    def __len__(self) -> int:
        return len(self.initials)


def incumbent(turns: Turns) -> int:
    """Cost of a repair found in one pass: wrong roles are preceded by an inserted turn, or changed."""
    cost, want, started = 0, "u", False
    for initial, forced, truncated in zip(turns.initials, turns.forced, turns.truncated):
        if forced:
            cost += DELETE
            continue
        cost += TRUNCATED * truncated
        if initial == "s" and not started:
            started = True
            continue
        started = True
        if initial == want:
            want = "a" if want == "u" else "u"
        elif initial in ROLES:
            cost += INSERT
        else:
            cost += REROLE
            want = "a" if want == "u" else "u"
    return cost + 2 * INSERT  # what an open pair or a lone system turn asks for


class Table:
    """Suffix distances within the band: row i, column o is the distance of rows i.. to the last
    ``live[i] + o - half`` characters of the alternating string."""

    def __init__(self, turns: Turns, half: int, most_cells: int):
        self.turns, self.half = turns, half
        n = len(turns)
        self.live = np.concatenate((np.cumsum([not f for f in turns.forced][::-1])[::-1], [0])).astype(int) if n else np.zeros(1, int)
        self.offsets = np.arange(-half, half + 1)
        width = len(self.offsets)
        self.step = 1 if (n + 1) * width <= most_cells else max(int(np.sqrt(n)), 2)
        self.kept: dict[int, np.ndarray] = {}
        self.block: tuple[int, dict[int, np.ndarray]] = (-1, {})
        last = np.where(self.offsets >= 0, INSERT * self.offsets, _FAR)
        self.kept[n] = row = last
        for i in range(n - 1, -1, -1):
            row = self.before(i, row)
            if i % self.step == 0:
                self.kept[i] = row

    def before(self, i: int, after: np.ndarray) -> np.ndarray:
        """Row i of the table from row i + 1."""
        left = self.live[i] + self.offsets
        if self.turns.forced[i]:
            base = after + DELETE
        else:
            base = np.concatenate((after[1:], [_FAR])) + DELETE
            same = (left % 2 == 0) if self.turns.initials[i] == "u" else (left % 2 == 1) if self.turns.initials[i] == "a" else np.zeros(len(left), bool)
            change = after + np.where(same, KEEP, REROLE) + TRUNCATED * self.turns.truncated[i]
            base = np.minimum(base, np.where(left >= 1, change, _FAR))
        base = np.where(left >= 0, base, _FAR)
        return np.minimum(np.minimum.accumulate(base - INSERT * self.offsets) + INSERT * self.offsets, _FAR)

    def row(self, i: int) -> np.ndarray:
        if i in self.kept:
            return self.kept[i]
        first = i - i % self.step
        if self.block[0] != first:
            rows, at = {}, min(first + self.step, len(self.turns))
            row = self.kept[at]
            for j in range(at - 1, first, -1):
                rows[j] = row = self.before(j, row)
            self.block = (first, rows)
        return self.block[1][i]

    def distance(self, i: int, left: int) -> int:
        at = left - int(self.live[i]) + self.half
        return int(self.row(i)[at]) if 0 <= at < len(self.offsets) else _FAR

    def trace(self, i: int, left: int) -> str:
        """The ASCII-least cheapest audit of rows i.. and the last ``left`` characters."""
        out, n = [], len(self.turns)
        while i < n or left:
            here = self.distance(i, left)
            if i < n and here == DELETE + self.distance(i + 1, left):
                out.append("D")
                i += 1
            elif left and here == INSERT + self.distance(i, left - 1):
                out.append("I")
                left -= 1
            else:
                out.append("K" if self.turns.initials[i] == ("u" if left % 2 == 0 else "a") else "R")
                i += 1
                left -= 1
        return "".join(out)


def align(turns: Turns, most_cells: int = 1 << 24) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair over all feasible lengths; of equal ones the ASCII-least audit."""
    n = len(turns)
    must = sum(DELETE if f else TRUNCATED * t for f, t in zip(turns.forced, turns.truncated))
    half = (incumbent(turns) - must) // INSERT  # a deleted row costs 2 more than what it had to pay
    table = Table(turns, half, most_cells)
    m = int(table.live[0])
    lengths = range(max(m - half, 0), m + half + 1)
    ends = [(table.distance(0, length), 0, length, False) for length in lengths if length % 2 == 0]
    gone = 0  # live rows deleted in front of the system turn
    for i in range(n):
        if gone > half:
            break
        if not turns.forced[i]:
            if turns.initials[i] == "s":
                paid = DELETE * i + KEEP + TRUNCATED * turns.truncated[i]
                ends += [(paid + table.distance(i + 1, length - 1), i + 1, length - 1, True) for length in lengths if length % 2 == 1 and length >= 3]
            gone += 1
    cost = min(e[0] for e in ends)
    audits = [("D" * (i - 1) + "K" if led else "") + table.trace(i, left) for c, i, left, led in ends if c == cost]
    return cost, min(audits)


def apply_audit(rows: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The repaired rows (role, text) that an audit gives."""
    total = len(audit) - audit.count("D")
    out: list[tuple[str, str]] = []
    at = 0
    for letter in audit:
        role = ROLES["u" if (total - len(out)) % 2 == 0 else "a"]
        if letter == "K":
            out.append(rows[at])
        elif letter == "R":
            out.append((role, rows[at][1]))
        elif letter == "I":
            out.append((role, ""))
        at += letter != "I"
    return out


def faults(rows: list[tuple[str, str]]) -> list[str]:
    """The first fault of each row: blank, duplicate, truncated or none."""
    seen: set[tuple[str, str]] = set()
    out = []
    for row in rows:
        text = row[1]
        out.append("blank" if not _SEEN.search(text) else "duplicate" if row in seen else "" if _ENDED.search(text) else "truncated")
        seen.add(row)
    return out


def damage(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with faults by crc32 of ``conv_id:turn``; nulls are one space.

    Adds ``copies``, how often a row stands (0: dropped).
    """

    def text_of(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text_of("text"), "[.!?]", "")).otherwise(text_of("text"))
    return turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(fault == 4, "user").otherwise(text_of("role")).alias("role"), text.alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
    )


def repair(turns: DataFrame) -> DataFrame:
    """One row per conv_id: gaps, counts of faults, cost, audit and the repaired turns.

    Rows stand by turn, nulls first, equal turns by role and text; a column ``copies`` says how often a
    row stands (once where there is none), and a conversation all of whose rows stand 0 times is empty:
    zeros, empty audit, no turns. Null roles and texts are one space; rows without a conv_id are one
    conversation; repeated rows are duplicates; an empty table gives no rows; other columns play no part.
    """
    copies = F.col("copies") if "copies" in turns.columns else F.lit(1)
    row = F.struct(
        F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), copies.cast("int").alias("copies")
    )
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.when(copies > 0, row))).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list] = {c: [] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired")}
            for group in batch.column(1).to_pylist():
                rows = [(r["role"], r["text"]) for r in group for _ in range(r["copies"])]
                known = {r["turn"] for r in group if r["turn"] is not None}
                kinds = faults(rows)
                cost, audit = align(Turns([r[0][:1] for r in rows], [k in ("blank", "duplicate") for k in kinds], [k == "truncated" for k in kinds]))
                found["gaps"].append(max(known) - min(known) + 1 - len(known) if known else 0)
                for kind in ("blank", "duplicate", "truncated"):
                    found[kind].append(kinds.count(kind))
                found["illegal"].append(sum(a[0][:1] + b[0][:1] not in LEGAL for a, b in zip(rows, rows[1:])))
                found["cost"].append(cost)
                found["audit"].append(audit)
                found["repaired"].append([{"role": r, "text": t} for r, t in apply_audit(rows, audit)])
            longs = [pa.array(found[c], pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
            kept = pa.array(found["repaired"], pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *longs, pa.array(found["audit"], pa.string()), kept], names=["conv_id", *found])

    return grouped.mapInArrow(run, _SCHEMA.format(dict(turns.dtypes)["conv_id"]))


def rendered(turns: str) -> Column:
    """``role:text`` of each turn, a line each."""
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")


#: DuckDB SQL of the query over the table ``conversations``: a row at a time, the cheapest and then least audit of each
#: state of the grammar (0 start, 1 after the system turn, 2 after a user's, 3 after an assistant's).
ORACLE = r"""
WITH RECURSIVE tab AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS v
  FROM range(256) r(i)
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), hashed AS (
  SELECT keyed.*, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, len(k) + 1), lambda j: ascii(substr(k, j::INTEGER, 1))::BIGINT)),
    lambda c, b: xor(c >> 8, tab.v[(xor(c, b) & 255) + 1]))) % 20 AS f FROM keyed, tab
), hurt AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, range(CASE WHEN f = 0 THEN 0 WHEN f = 3 THEN 2 ELSE 1 END) c(n)
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM ordered
), marked AS (
  SELECT *, left(role, 1) AS c, lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS next_c,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
         WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM placed
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (next_c IS NOT NULL AND c || next_c NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM marked GROUP BY conv_id
), step(s, c, z) AS (
  VALUES (0, 'u', 2), (0, 's', 1), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), added(s, more, z) AS (
  VALUES (0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 0, 3), (0, 1, 2), (1, 1, 2), (2, 1, 3), (3, 1, 2), (0, 2, 3), (1, 2, 3), (2, 2, 2), (3, 2, 3)
), moves(letter, fault, c, s, cost, z) AS (
  SELECT 'D', f, c, s, 3, s FROM (VALUES (0), (1), (2), (3)) a(s), (VALUES ('s'), ('u'), ('a'), ('')) b(c), (VALUES ('out'), ('cut'), ('')) d(f)
  UNION ALL SELECT 'K', f, step.c, step.s, CASE WHEN f = 'cut' THEN 1 ELSE 0 END, step.z FROM step, (VALUES ('cut'), ('')) d(f)
  UNION ALL SELECT 'R', f, b.c, step.s, CASE WHEN f = 'cut' THEN 3 ELSE 2 END, step.z FROM step, (VALUES ('s'), ('u'), ('a'), ('')) b(c), (VALUES ('cut'), ('')) d(f)
    WHERE step.c <> 's' AND b.c <> step.c
), walk(conv_id, i, s, best) AS (
  SELECT n.conv_id, 0::BIGINT, a.z, {'cost': 2 * a.more, 'audit': repeat('I', a.more)} FROM counted n, added a WHERE a.s = 0
  UNION ALL
  SELECT w.conv_id, w.i + 1, a.z, min({'cost': w.best.cost + m.cost + 2 * a.more, 'audit': w.best.audit || m.letter || repeat('I', a.more)})
  FROM walk w JOIN marked r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1
  JOIN moves m ON m.s = w.s AND m.c = CASE WHEN r.c IN ('s', 'u', 'a') THEN r.c ELSE '' END
    AND m.fault = CASE WHEN r.fault IN ('blank', 'duplicate') THEN 'out' WHEN r.fault = 'truncated' THEN 'cut' ELSE '' END
  JOIN added a ON a.s = m.z GROUP BY w.conv_id, w.i, a.z
), ends AS (
  SELECT w.conv_id, min(w.best) AS best FROM walk w JOIN counted n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.n = w.i
  WHERE w.s IN (0, 3) GROUP BY w.conv_id
), letters AS (
  SELECT conv_id, p, substr(best.audit, p::INTEGER, 1) AS letter, substr(best.audit, 1, p::INTEGER) AS sofar,
    len(best.audit) - len(replace(best.audit, 'D', '')) AS gone, len(best.audit) AS size FROM ends, range(1, len(best.audit) + 1) g(p)
), lines AS (
  SELECT l.conv_id, l.p, CASE WHEN l.letter = 'K' THEN r.role WHEN (l.size - l.gone - len(replace(l.sofar, 'D', ''))) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN l.letter = 'I' THEN '' ELSE r.text END AS line
  FROM letters l LEFT JOIN marked r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.i = len(replace(l.sofar, 'I', '')) WHERE l.letter <> 'D'
), repaired AS (
  SELECT conv_id, string_agg(line, chr(10) ORDER BY p) AS whole FROM lines GROUP BY conv_id
)
SELECT o.conv_id, coalesce(n.gaps, 0) AS gaps, coalesce(n.blank, 0) AS blank, coalesce(n.duplicate, 0) AS duplicate, coalesce(n.truncated, 0) AS truncated,
  coalesce(n.illegal, 0) AS illegal, coalesce(e.best.cost, 0)::BIGINT AS cost, coalesce(e.best.audit, '') AS audit, sha256(coalesce(t.whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted n ON n.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN repaired t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
"""
