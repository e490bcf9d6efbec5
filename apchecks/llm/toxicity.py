"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult (with a learnt weight), threat, target, negation, reported speech, clause
boundary, or other. Five small weighted transducers read symbols and pass them on with a factor:
negation weakens what follows it for a few words, reported speech weakens the rest of its clause, a
target strengthens insults and threats in its clause, a threat next to a target counts as an attack, and
the insult transducer scores what reaches it. They are composed into one table, which runs over the
clauses that hold an insult or a threat; a document's score comes from its matched clauses.

The insult lexicon holds words and word beginnings, learnt from labelled rows: counts of the documents
of either label that hold them, over all labelled training rows, grouped by Spark. What enters it is
decided by two fixed bars, whatever the number of labels: ``least_pos`` toxic counts, and a log ratio of
``least_weight``. Together they bound the ratio from below: from 6 counts on its standard error is 1.47
at most, so at 3.3 or more it is above 0 by two standard errors. Every entry that passes is used: the
``max_broadcast`` with the best evidence from a broadcast table, the others by a shuffled join of the
words that a bit filter lets through. Two parameters of a
logistic curve turn clause scores into probabilities; they are fitted on documents that the lexicon used
there has not seen, at most ``fit_rows`` of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, materialize, small_batches
from .idfilter import hits, key_filter
from .textops import (
    NOT_ALNUM,
    Slice,
    Words,
    _BYTE_VALUE,
    _power_tables,
    distinct_per_row,
    mix64,
    slices,
    words,
)
from .tokens import release

# Seed words of the classes; a parameter of the grammar.
TARGETS = "you your yours youre u he she they them him her his this these tu toi vous votre vos du dich dir ihr euch sie usted ustedes te ti"
NEGATIONS = "not no never isnt arent wasnt dont doesnt nobody pas jamais aucun ne nicht kein keine nie nunca ningun ninguna tampoco"
REPORTS = "said says say called calls wrote writes quote quoted claimed reported dit sagte schrieb zitat dijo escribio cita"
THREATS = "kill hurt destroy beat stab shoot burn murder tuer frapper töten schlagen matar golpear"
INSULTS = (
    "idiot moron stupid loser scum trash clown pathetic worthless disgusting fool dumb imbecile crap jerk freak creep "
    "garbage useless ugly imbécile crétin connard abruti dumm trottel arschloch idiota estúpido imbécil tonto basura"
)

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, BOUNDARY = range(7)
#: Lengths in bytes of the word beginnings that may enter the lexicon; 0 is the whole word.
BEGINNINGS = (0, 4, 5, 6, 7, 8)
#: So many lexicon entries are broadcast, by evidence; the others are joined.
MAX_BROADCAST = 1 << 19
#: Clause scores above this count as this in the curve.
HIGHEST = 30.0
_FILTER_BITS = 20
#: Bits of the filter of the entries that are joined, as a power of two; a fixed size.
_REST_BITS = 24

_ENDS_CLAUSE = np.zeros(256, dtype=bool)
_ENDS_CLAUSE[[ord(c) for c in ".!?;:\n"]] = True


@dataclass
class Transducer:
    """A sequential transducer: for (state, symbol) the next state, the symbol passed on and a factor."""

    step: list[dict[int, tuple[int, int, float]]]

    def read(self, state: int, symbol: int) -> tuple[int, int, float]:
        return self.step[state].get(symbol, (self.step[state].get(-1, (state, symbol, 1.0))[0], symbol, 1.0))


def _scope(opens: int, length: int, factor: float, closes: tuple[int, ...] = (BOUNDARY,)) -> Transducer:
    """``opens`` starts a scope of ``length`` symbols (or up to a closing one) with a factor on insults and threats."""
    step: list[dict[int, tuple[int, int, float]]] = [{opens: (1, OTHER, 1.0)}]
    for i in range(1, length + 1):
        after = i + 1 if i < length else 0
        rules = {-1: (after, OTHER, 1.0), INSULT: (after, INSULT, factor), THREAT: (after, THREAT, factor), opens: (1, OTHER, 1.0)}
        step.append(rules | {c: (0, c, 1.0) for c in closes})
    return Transducer(step)


def _while_open(opens: int, factor: float) -> Transducer:
    """From ``opens`` up to the clause's end insults and threats get a factor."""
    return Transducer(
        [
            {opens: (1, opens, 1.0)},
            {INSULT: (1, INSULT, factor), THREAT: (1, THREAT, factor), BOUNDARY: (0, BOUNDARY, 1.0)},
        ]
    )


def _threat(weight: float, near: int = 3) -> Transducer:
    """A target within ``near`` symbols after a threat makes it an attack of a fixed weight."""
    step: list[dict[int, tuple[int, int, float]]] = [{THREAT: (1, OTHER, 1.0)}]
    for i in range(1, near + 1):
        after = i + 1 if i < near else 0
        step.append({TARGET: (0, INSULT, weight), THREAT: (1, OTHER, 1.0), -1: (after, OTHER, 1.0), BOUNDARY: (0, BOUNDARY, 1.0)})
    return Transducer(step)


class Grammar:
    """The composition of transducers, as tables over (state, symbol)."""

    def __init__(self, parts: list[Transducer]):
        index: dict[tuple[int, ...], int] = {(0,) * len(parts): 0}
        rows: list[list[tuple[int, int, float]]] = []
        todo = [(0,) * len(parts)]
        while todo:
            states = todo.pop(0)
            row = []
            for symbol in range(BOUNDARY + 1):
                out, factor, after = symbol, 1.0, []
                for part, state in zip(parts, states):
                    state, out, f = part.read(state, out)
                    factor *= f
                    after.append(state)
                key = tuple(after)
                if key not in index:
                    index[key] = len(index)
                    todo.append(key)
                row.append((index[key], out, factor))
            rows.append(row)
        self.rows = rows

    def score(self, symbols: Iterable[int], weights: Iterable[float]) -> float:
        """The weight of the insults and attacks that come through."""
        state, total = 0, 0.0
        for symbol, weight in zip(symbols, weights):
            state, out, factor = self.rows[state][symbol]
            if out == INSULT:
                total += factor * (weight if symbol == INSULT else 1.0)
        return total


def grammar(negated: float = 0.4, reported: float = 0.5, aimed: float = 1.25, attack: float = 3.0) -> Grammar:
    return Grammar([_scope(NEGATION, 3, negated), _while_open(REPORT, reported), _while_open(TARGET, aimed), _threat(attack)])


def _parts(s: Slice, w: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each kind of beginning: its length, the words that have it, and their hashes."""
    n = len(s.data)
    power, inverse = _power_tables(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUE[s.data] * power[:n], out=total[1:])
    size = w.ends - w.starts
    for k in BEGINNINGS:
        which = np.flatnonzero(size >= 3) if k == 0 else np.flatnonzero(size > k)
        start = w.starts[which]
        end = w.ends[which] if k == 0 else start + k
        yield k, which, mix64((total[end] - total[start]) * inverse[start] + np.uint64(k * 7919) + (end - start).astype(np.uint64))


def _seed_hashes(seed: str) -> np.ndarray:
    (s,) = slices(pa.array([seed]), limit=1 << 30)
    w = words(s, NOT_ALNUM)
    _, which, h = next(_parts(s, w))
    out = np.zeros(len(w.starts), dtype=np.uint64)
    out[which] = h
    return out[which]


def _class_hash(s: Slice, w: Words) -> np.ndarray:
    """Hashes of all words, also short ones, for the seed classes."""
    n = len(s.data)
    power, inverse = _power_tables(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUE[s.data] * power[:n], out=total[1:])
    return mix64((total[w.ends] - total[w.starts]) * inverse[w.starts] + (w.ends - w.starts).astype(np.uint64))


class Lexicon:
    """Weights of words and beginnings, behind a bit filter of fixed size."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.weights = keys[order], weights[order]
        self.bits = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.bits[(self.keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def word_weights(self, s: Slice, w: Words) -> np.ndarray:
        """The largest weight among a word's entries, 0 without one."""
        out = np.zeros(len(w.starts))
        if not len(self.keys):
            return out
        for _, which, h in _parts(s, w):
            maybe = np.flatnonzero(self.bits[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            i = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
            hit = self.keys[i] == h[maybe]
            at = which[maybe[hit]]
            np.maximum.at(out, at, self.weights[i[hit]])
        return out


class Model:
    """Lexicon, seed classes and composed grammar; sent to the tasks."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.grammar = grammar()
        classes = {}
        for symbol, seed in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS)):
            (s,) = slices(pa.array([seed]), limit=1 << 30)
            for h in _class_hash(s, words(s, NOT_ALNUM)):
                classes[int(h)] = symbol
        self.class_keys = np.array(sorted(classes), dtype=np.uint64)
        self.class_of = np.array([classes[int(k)] for k in self.class_keys], dtype=np.int8)

    def clause_scores(self, s: Slice, more: Lexicon | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row: summed clause scores, matched clauses, and words; ``more`` are entries beside the lexicon's."""
        w = words(s, NOT_ALNUM)
        rows, n = s.rows, len(w.starts)
        score, matched = np.zeros(rows), np.zeros(rows, dtype=np.int64)
        if not n:
            return score, matched, w.counts()
        weight = self.lexicon.word_weights(s, w)
        if more is not None:
            weight = np.maximum(weight, more.word_weights(s, w))
        h = _class_hash(s, w)
        i = np.minimum(np.searchsorted(self.class_keys, h), len(self.class_keys) - 1)
        symbol = np.where(self.class_keys[i] == h, self.class_of[i], OTHER)
        symbol = np.where(weight > 0, INSULT, symbol)
        live = np.flatnonzero((symbol == INSULT) | (symbol == THREAT))
        if not len(live):
            return score, matched, w.counts()
        # Clause numbers: a new one after a boundary byte between two words, and at each row.
        ends = np.concatenate(([0], np.cumsum(_ENDS_CLAUSE[s.data])))
        cut = np.zeros(n, dtype=bool)
        cut[1:] = ends[w.starts[1:]] > ends[w.ends[:-1]]
        cut[w.first[:-1][w.first[:-1] < n]] = True
        cut[0] = True
        first = np.flatnonzero(cut)
        clause = np.cumsum(cut) - 1
        after = np.append(first[1:], n)
        row_of = np.repeat(np.arange(rows), w.counts())
        for c in np.unique(clause[live]):
            a, b = int(first[c]), int(after[c])
            value = self.grammar.score(symbol[a:b].tolist(), weight[a:b].tolist())
            if value > 0:
                score[row_of[a]] += value
                matched[row_of[a]] += 1
        return score, matched, w.counts()


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text modulo 4; a null id counts as the empty text. 2 is held out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4


def _feature_counts(labelled: DataFrame, most_words: int) -> DataFrame:
    """For each feature the training documents that hold it, by label and by part (a: folds 0 and 3).

    A document counts for a word beginning by the distinct words in it that share it, up to ``most_words``.
    """

    seeds = np.sort(_seed_hashes(INSULTS))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            part = batch.column("fold").to_numpy(zero_copy_only=False).astype(np.int64)
            for s in slices(batch.column("text")):
                w = words(s, NOT_ALNUM)
                row_of = np.repeat(np.arange(s.rows), w.counts())
                keys, rows = [], []
                seed = np.zeros(len(w.starts), dtype=bool)
                for k, which, h in _parts(s, w):
                    if k == 0:
                        i = np.minimum(np.searchsorted(seeds, h), len(seeds) - 1)
                        seed[which] = seeds[i] == h
                        new = np.zeros(len(w.starts), dtype=bool)  # the first of each distinct word of a row
                        new[which[np.unique(mix64(h + row_of[which].astype(np.uint64)), return_index=True)[1]]] = True
                    else:  # a seed word says nothing about other words with its beginning
                        keep = new[which] & ~seed[which]
                        which, h = which[keep], h[keep]
                    keys.append(h)
                    rows.append(row_of[which])
                keys, rows = np.concatenate(keys), np.concatenate(rows)
                v, at = distinct_per_row(keys, rows, s.rows)
                owner = np.repeat(np.arange(s.rows), np.diff(at)) + s.first
                # A row counts more for a beginning that several of its words share.
                order = np.lexsort((keys, rows))
                edge = np.ones(len(order) + 1, dtype=bool)
                edge[1:-1] = (keys[order][1:] != keys[order][:-1]) | (rows[order][1:] != rows[order][:-1])
                weight = np.minimum(np.diff(np.flatnonzero(edge)), most_words) if len(order) else np.zeros(0)
                unique, inverse = np.unique(v, return_inverse=True)
                one, late = toxic[owner] == 1, part[owner] == 1
                masks = (one, ~one, one & late, ~one & late)
                count = [np.bincount(inverse, m * weight, len(unique)).astype(np.int64) for m in masks]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(unique.view(np.int64)), *map(pa.array, count)], names=["key", "pos", "neg", "pos_b", "neg_b"]
                )

    counted = labelled.select("text", "toxic", "fold").mapInArrow(run, "key long, pos long, neg long, pos_b long, neg_b long")
    return counted.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("pos", "neg", "pos_b", "neg_b")))


def _lexicon(
    counts: DataFrame, totals: dict, early: bool, least_pos: int, least_weight: float, max_broadcast: int
) -> tuple[Lexicon, DataFrame | None]:
    """The entries with the best evidence, and the others (key, w) if there are more than ``max_broadcast``.

    Seeds have pseudo-counts and stay unless data contradict them.
    """
    pos, neg = (F.col("pos") - F.col("pos_b"), F.col("neg") - F.col("neg_b")) if early else (F.col("pos"), F.col("neg"))
    n_pos = totals["pos"] - totals["pos_b"] if early else totals["pos"]
    n_neg = totals["neg"] - totals["neg_b"] if early else totals["neg"]
    weight = F.log((pos + 0.5) / (n_pos + 1.0)) - F.log((neg + 0.5) / (n_neg + 1.0))
    seeds = _seed_hashes(INSULTS)
    seed_rows = counts.filter(F.col("key").isin(seeds.view(np.int64).tolist())).select("key", pos.alias("p"), neg.alias("n")).collect()
    level = F.floor(F.log2(F.greatest(weight * F.sqrt(pos), F.lit(1e-9))) * 8).cast("int")
    found = counts.filter((pos >= least_pos) & (weight >= least_weight)).select("key", weight.alias("w"), level.alias("level"))
    kept, lowest = 0, None
    sizes = {r["level"]: r["n"] for r in found.groupBy("level").agg(F.count("*").alias("n")).collect()}
    for k in sorted(sizes, reverse=True):
        if kept + sizes[k] > max_broadcast:
            break
        kept, lowest = kept + sizes[k], k
    whole = kept == sum(sizes.values())
    best = found if whole else found.filter(F.lit(False) if lowest is None else F.col("level") >= lowest)
    rest = None if whole else materialize(found.filter(F.lit(True) if lowest is None else F.col("level") < lowest).select("key", "w"), "toxicity-rest")
    top = best.select("key", "w").toArrow()  # at most max_broadcast rows
    keys = np.concatenate([np.zeros(0, np.int64), *(c.to_numpy() for c in top.column(0).chunks)]).view(np.uint64)
    weights = np.concatenate([np.zeros(0), *(c.to_numpy() for c in top.column(1).chunks)])
    at = {int(keys[i]): i for i in np.flatnonzero(np.isin(keys, seeds))}
    seen = {r["key"] & (2**64 - 1): (r["p"], r["n"]) for r in seed_rows}
    more: dict[int, float] = {}
    for key in seeds.tolist():
        p, n = seen.get(key, (0, 0))
        w = float(np.log((p + 2.5) / (n_pos + 5.0)) - np.log((n + 0.5) / (n_neg + 100.0)))
        if w >= least_weight:
            if key in at:
                weights[at[key]] = max(weights[at[key]], w)
            else:
                more[key] = w
    keys = np.concatenate((keys, np.array(list(more), dtype=np.uint64)))
    return Lexicon(keys, np.concatenate((weights, np.array(list(more.values()), dtype=np.float64)))), rest


_SCORES = "clause_score double, clauses long, n_words long"


def _rest_filter(rest: DataFrame) -> np.ndarray:
    """A bit set over the keys of ``rest``, of a fixed size."""
    place = F.shiftrightunsigned("key", 64 - _REST_BITS)
    bits = rest.groupBy(F.shiftrightunsigned(place, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - _REST_BITS}) & 63 as int))")).alias("bits"))
    out = np.zeros(1 << (_REST_BITS - 6), dtype=np.uint64)
    table = bits.toArrow()  # at most as many rows as the filter has words
    if table.num_rows:
        out[table.column("at").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return out


def _with_rest(docs: DataFrame, rest: DataFrame) -> DataFrame:
    """``docs`` with the entries of ``rest`` that their texts hold, as arrays ``more_keys`` and ``more_weights``.

    Texts are told apart by two 64-bit hashes; texts that hold no entry get null.
    """
    bits = docs.sparkSession.sparkContext.broadcast(_rest_filter(rest))
    named = docs.withColumns({"text_1": F.xxhash64("text"), "text_2": F.xxhash64(F.lit(1), "text")})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for s in slices(batch.column("text")):
                w = words(s, NOT_ALNUM)
                row_of = np.repeat(np.arange(s.rows), w.counts())
                keys, rows = [], []
                for _, which, h in _parts(s, w):
                    place = h >> np.uint64(64 - _REST_BITS)
                    hit = (bits.value[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
                    keys.append(h[hit])
                    rows.append(row_of[which[hit]])
                v, at = distinct_per_row(np.concatenate(keys), np.concatenate(rows), s.rows)
                owner = pa.array(np.repeat(np.arange(s.rows), np.diff(at)) + s.first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("text_1").take(owner), batch.column("text_2").take(owner), pa.array(v.view(np.int64))],
                    names=["text_1", "text_2", "key"],
                )

    held = named.select("text", "text_1", "text_2").mapInArrow(run, "text_1 long, text_2 long, key long").distinct()
    of_text = held.join(rest.hint("merge"), "key").groupBy("text_1", "text_2").agg(F.collect_list(F.struct("key", "w")).alias("more"))
    of_text = of_text.select("text_1", "text_2", F.col("more.key").alias("more_keys"), F.col("more.w").alias("more_weights"))
    return named.join(of_text.hint("merge"), ["text_1", "text_2"], "left").drop("text_1", "text_2")


def _apply(docs: DataFrame, model: Model, rest: DataFrame | None, columns: str, inside: str | None = None) -> DataFrame:
    """Append the clause columns to ``docs`` (whose text column is "text"), row by row.

    Where the text stands ``inside`` another column, a struct, only that is sent to Python and back.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if not (inside and c == "text")]

    def text_of(batch: pa.RecordBatch) -> pa.Array:
        return pc.fill_null(batch.column(inside).field("text").cast(pa.string()), "") if inside else batch.column("text")

    def more(part: pa.RecordBatch) -> Lexicon | None:
        if rest_is_none:
            return None
        keys, weights = (part.column(c).flatten().to_numpy() for c in ("more_keys", "more_weights"))
        keys, first = np.unique(keys.view(np.uint64), return_index=True)
        return Lexicon(keys, weights[first])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            parts = [sent.value.clause_scores(s, more(batch.slice(s.first, s.rows))) for s in slices(text_of(batch))]
            if parts:
                score, matched, n = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in names), pa.array(score), pa.array(matched.astype(np.int64)), pa.array(n.astype(np.int64))],
                    names=[*names, "clause_score", "clauses", "n_words"],
                )

    rest_is_none = rest is None
    whole = docs if rest_is_none else _with_rest(docs, rest)
    return (whole.drop("text") if inside else whole).mapInArrow(run, f"{columns}, {_SCORES}")


#: The curve without labels, and what few labels are drawn to: intercept, clause score, log of words.
DEFAULT_CURVE = np.array([-3.0, 1.0, 0.0])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 2.0) -> np.ndarray:
    """Weights of a logistic regression with an intercept, by Newton steps, with a ridge around the default curve."""
    x = np.column_stack((np.ones(len(x)), x))
    w = DEFAULT_CURVE.copy()
    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + ridge / 2 * ((w - DEFAULT_CURVE) ** 2).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * (w - DEFAULT_CURVE))
        here, size = loss(w), 1.0
        while size > 1e-6 and loss(w + size * step) > here:
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return w


def fit(
    documents: DataFrame, labels: DataFrame, fit_rows: int = 50_000, least_pos: int = 6, least_weight: float = 3.3,
    max_broadcast: int = MAX_BROADCAST, most_words: int = 4, highest: float = HIGHEST,
) -> tuple[Model, DataFrame | None, np.ndarray]:
    """Learn lexicon (with what is joined of it) and curve from labelled rows whose fold is not 2.

    ``fit_rows`` bounds the rows that the curve is fitted on, ``least_pos`` and ``least_weight`` are the lexicon's
    bars, ``max_broadcast`` entries are broadcast. A document counts for a word beginning by the distinct words in
    it that share it, up to ``most_words``; clause scores above ``highest`` count as that in the curve, so that
    one very long or foul text doesn't bend it.
    """
    small_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.max("toxic").cast("int").alias("toxic")).filter(fold() != 2)
    wanted = documents.sparkSession.sparkContext.broadcast(key_filter(marks.select(F.col("doc_id").alias("id"))))
    rows = docs.withColumn("h", F.xxhash64("doc_id"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            yield batch.filter(pa.array(hits(batch.column("h"), wanted.value))).select(["doc_id", "text"])

    some = rows.filter("doc_id is not null").mapInArrow(run, "doc_id long, text string")
    labelled = some.join(marks.hint("merge"), "doc_id").withColumn("fold", fold().cast("int"))
    scratch = Scratch(documents.sparkSession, "toxicity")
    labelled = scratch.save(labelled.select("doc_id", "text", "toxic", "fold"), "labelled")
    counts = scratch.save(_feature_counts(labelled, most_words), "features")
    is_pos = F.col("toxic") == 1
    late = F.col("fold") == 1
    totals = labelled.agg(
        F.count_if(is_pos).alias("pos"), F.count_if(~is_pos).alias("neg"),
        F.count_if(is_pos & late).alias("pos_b"), F.count_if(~is_pos & late).alias("neg_b"),
    ).first().asDict()
    lexicon, rest = _lexicon(counts, totals, True, least_pos, least_weight, max_broadcast)
    sample = labelled.filter(late).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    seen = _apply(sample.select("toxic", "text"), Model(lexicon), rest, "toxic int, text string").select("toxic", "clause_score", "n_words").toPandas()
    if len(seen) and 0 < seen["toxic"].sum() < len(seen):
        curve = _logistic(_inputs(seen["clause_score"].to_numpy(), seen["n_words"].to_numpy(), highest), seen["toxic"].to_numpy().astype(float))
    else:
        curve = DEFAULT_CURVE
    lexicon, rest = _lexicon(counts, totals, False, least_pos, least_weight, max_broadcast)
    scratch.drop("labelled", "features")  # what is joined of the lexicon is a table of its own
    return Model(lexicon), rest, curve


def _inputs(score: np.ndarray, n_words: np.ndarray, highest: float) -> np.ndarray:
    return np.column_stack((np.minimum(score, highest), np.log1p(n_words) - 5.0))


def probability(curve: np.ndarray, highest: float = HIGHEST) -> Column:
    z = F.lit(float(curve[0])) + F.lit(float(curve[1])) * F.least("clause_score", F.lit(highest)) + F.lit(float(curve[2])) * (F.log1p("n_words") - 5.0)
    return 1.0 / (1.0 + F.exp(-z))


def score(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, **settings) -> DataFrame:
    """Toxicity of every whole text of ``documents`` (doc_id, text), learnt from ``labels`` (doc_id, toxic).

    Returns doc_id, held_out (fold 2), score, predicted, clause_score, clauses and n_words. Null and
    empty texts have no clauses and get the curve's lowest scores; null ids and repeated rows are
    kept; labels without an id or value are left out, and of repeated labels the largest counts;
    without labels the seed lexicon and a default curve stand; other columns are ignored.
    """
    model, rest, curve = fit(documents, labels, **settings)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    curved = probability(curve, settings.get("highest", HIGHEST))
    scored = _apply(docs, model, rest, "doc_id long, text string").drop("text").withColumn("score", curved)
    return scored.select(
        "doc_id", (fold() == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
        "clause_score", "clauses", "n_words",
    )


def keep_clean(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, **settings) -> DataFrame:
    """The rows of ``documents`` whose text scores below ``threshold``, with all their columns."""
    model, rest, curve = fit(documents, labels, **settings)
    wrapped = documents.select(F.struct("*").alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    inner = wrapped.schema["row"].dataType.simpleString()
    scored = _apply(wrapped, model, rest, f"row {inner}", inside="row")
    kept = scored.filter(probability(curve, settings.get("highest", HIGHEST)) < threshold)
    return kept.select(*(F.col(f"row.`{c}`").alias(c) for c in documents.columns))
