"""Language-model scoring by context-tree weighting over binary-decomposed byte contexts.

A text is its lower-cased token sequence: the words joined by one space, then one end byte 0xFF,
which no UTF-8 text holds. Each byte is eight binary decisions; the node of a decision is the pair of
the preceding ``d`` bytes and the bits of the byte decided so far, for every depth ``d`` from 0 to
``DEPTH``. Every node has a Krichevsky-Trofimov estimate, and the tree weights "stop here" against
"split by one more byte" with one half each. The weighted block probabilities of the training text
give each node its posterior stopping weight, so that a decision's probability is a mixture of the
estimates along its path. Weight that would pass below a context never seen stays at the deepest
context that was seen, which keeps every conditional distribution normalised.

The work is set-wise. Windows of ``DEPTH + 1`` bytes are counted over all documents; the subtrees
below each pair of preceding bytes are independent, so they are weighted group by group; only the
nodes of depth 0 and 1 (at most 65,280) meet on the driver. Every distinct window gets its code
length once. Scoring broadcasts the heaviest windows and words, at most ``max_broadcast`` of each,
and looks up whatever is rarer by a shuffled join, so that no size of corpus changes a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .textops import SPACE, Lookup, Slice, slices, word_hashes, words

DEPTH = 5
WINDOW = 0
WORD = 1
#: The key of the end token among the word hashes.
END_KEY = np.uint64(0x7FFF_FFFF_FFFF_FFFF)

#: Keys that a counting task gathers before it merges them; it gives them out at half of that.
MERGE_KEYS = 1 << 20

_LOG_HALF = float(np.log(0.5))


def held_out_column(doc_id: str = "doc_id", modulus: int = 10, remainder: int = 0) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def _windows(s: Slice, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a slice (oldest byte highest, the coded byte lowest) and each row's offsets.

    Rows are padded in front with ``depth`` zero bytes and end with 0xFF.
    """
    w = words(s, SPACE)
    rows = s.rows
    # Bytes of words keep their order; after each word comes a space, after a row's last one the end.
    keep = ~SPACE[s.data]
    position = np.cumsum(keep) - keep  # rank among word bytes
    word_row = np.repeat(np.arange(rows), w.counts())
    n_words = len(w.starts)
    has = w.counts() > 0
    spaces = np.maximum(w.counts() - 1, 0)
    letters = np.searchsorted(np.flatnonzero(keep), s.offsets) if n_words else np.zeros(rows + 1, np.int64)
    length = np.diff(letters) + spaces + 1 + depth
    begin = np.concatenate(([0], np.cumsum(length)))
    buf = np.full(int(begin[-1]), 0x20, dtype=np.uint64)
    for i in range(depth):
        buf[begin[:-1] + i] = 0
    buf[begin[1:] - 1] = 0xFF
    if n_words:
        word_rank = np.arange(n_words) - w.first[:-1][word_row]
        shift = begin[:-1][word_row] + depth + word_rank - letters[:-1][word_row]
        sizes = w.ends - w.starts
        buf[position[keep] + np.repeat(shift, sizes)] = s.data[keep]
    del has
    n = len(buf) - depth
    out = np.zeros(n, dtype=np.uint64)
    for i in range(depth + 1):
        out = (out << np.uint64(8)) | buf[i : i + n]
    # Windows that start inside a row and end in its next row are no windows of either.
    ok = np.ones(n, dtype=bool)
    for i in range(depth):
        at = begin[1:-1] - depth + i
        ok[at] = False
    offsets = np.concatenate(([0], np.cumsum(length - depth)))
    return out[ok], offsets


def _merge(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys = np.concatenate([p[0] for p in parts])
    unique, inverse = np.unique(keys, return_inverse=True)
    train = np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(unique))
    total = np.bincount(inverse, np.concatenate([p[2] for p in parts]), len(unique))
    return unique, train.astype(np.int64), total.astype(np.int64)


_COUNT_SCHEMA = "kind int, key long, train long, total long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of windows and words, merged inside the task; it emits and restarts when they grow."""
    held: dict[int, list] = {WINDOW: [], WORD: []}

    def flush(kind: int) -> pa.RecordBatch:
        key, train, total = _merge(held[kind])
        held[kind] = []
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(key), kind, np.int32)), pa.array(key.view(np.int64)), pa.array(train), pa.array(total)],
            names=["kind", "key", "train", "total"],
        )

    for batch in batches:
        learn = ~batch.column("held_out").to_numpy(zero_copy_only=False)
        for s in slices(batch.column("text")):
            rows = slice(s.first, s.first + s.rows)
            window, at = _windows(s)
            w = words(s)
            h = word_hashes(s, w)
            for kind, keys, counts in ((WINDOW, window, np.diff(at)), (WORD, h, w.counts())):
                weight = np.repeat(learn[rows], counts)
                unique, inverse, total = np.unique(keys, return_inverse=True, return_counts=True)
                held[kind].append((unique, np.bincount(inverse, weight, len(unique)), total))
            ends = s.rows
            held[WORD].append((np.array([END_KEY]), np.array([float(learn[rows].sum())]), np.array([ends])))
            for kind in held:
                if sum(len(p[0]) for p in held[kind]) > MERGE_KEYS:
                    held[kind] = [_merge(held[kind])]
                    if len(held[kind][0][0]) > MERGE_KEYS // 2:
                        yield flush(kind)
    for kind in held:
        if held[kind]:
            yield flush(kind)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma for positive arguments, by Stirling's series after shifting above 8."""
    y = np.asarray(x, dtype=np.float64).copy()
    shift = np.zeros_like(y)
    for _ in range(8):
        low = y < 8
        shift[low] -= np.log(y[low])
        y[low] += 1
    return shift + (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3)


def kt_log_block(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov block probability of n0 zeros and n1 ones."""
    return _lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - _lgamma(n0 + n1 + 1.0) - np.log(np.pi)


def _prefix(byte: np.ndarray, bit: int) -> np.ndarray:
    return (np.uint64(1) << np.uint64(bit)) | (byte >> np.uint64(8 - bit))


class _Subtree:
    """The weighted nodes below one pair of preceding bytes, depths 2 to ``DEPTH``."""

    def __init__(self, window: np.ndarray, train: np.ndarray):
        seen = train > 0
        w, c = window[seen], train[seen].astype(np.float64)
        byte, context = w & np.uint64(255), w >> np.uint64(8)
        self.keys, self.n0, self.n1, self.kt = {}, {}, {}, {}
        for d in range(2, DEPTH + 1):
            at = context & np.uint64((1 << (8 * d)) - 1)
            pair, inverse = np.unique((at << np.uint64(8)) | byte, return_inverse=True)
            count = np.bincount(inverse, c, len(pair))
            last = pair & np.uint64(255)
            at = pair >> np.uint64(8)
            key = np.concatenate([(at << np.uint64(8)) | _prefix(last, b) for b in range(8)])
            one = np.concatenate([((last >> np.uint64(7 - b)) & np.uint64(1)).astype(np.float64) for b in range(8)])
            weight = np.tile(count, 8)
            node, inverse = np.unique(key, return_inverse=True)
            self.keys[d] = node
            self.n1[d] = np.bincount(inverse, weight * one, len(node))
            self.n0[d] = np.bincount(inverse, weight * (1 - one), len(node))
            self.kt[d] = kt_log_block(self.n0[d], self.n1[d]) if len(node) else np.zeros(0)
        self.stop = {DEPTH: np.ones(len(self.keys[DEPTH]))}
        weighted = self.kt[DEPTH]
        for d in range(DEPTH - 1, 1, -1):
            child = self.keys[d + 1]
            context = (child >> np.uint64(8)) & np.uint64((1 << (8 * d)) - 1)
            parent = np.searchsorted(self.keys[d], (context << np.uint64(8)) | (child & np.uint64(255)))
            below = np.bincount(parent, weighted, len(self.keys[d]))
            whole = np.logaddexp(self.kt[d], below) + _LOG_HALF
            self.stop[d] = np.exp(self.kt[d] + _LOG_HALF - whole)
            weighted = whole
        self.weighted = weighted


def _top_nodes(pdf: pd.DataFrame) -> pd.DataFrame:
    tree = _Subtree(pdf["key"].to_numpy().view(np.uint64), pdf["train"].to_numpy())
    node = tree.keys[2]
    return pd.DataFrame(
        {
            "c1": ((node >> np.uint64(8)) & np.uint64(255)).astype(np.int32),
            "prefix": (node & np.uint64(255)).astype(np.int32),
            "n0": tree.n0[2].astype(np.int64),
            "n1": tree.n1[2].astype(np.int64),
            "below": tree.weighted,
        }
    )


class _Upper:
    """Depths 0 and 1: mixed probability of a one, weight left for depth 2, and the deepest estimate."""

    def __init__(self, top: pd.DataFrame):
        n0, n1, below = (np.zeros((256, 256)) for _ in range(3))
        at = (top["c1"].to_numpy(), top["prefix"].to_numpy())
        for table, name in ((n0, "n0"), (n1, "n1"), (below, "below")):
            table[at] = top[name].to_numpy()
        seen = n0 + n1 > 0
        kt1 = kt_log_block(n0, n1)
        whole1 = np.where(seen, np.logaddexp(kt1, below) + _LOG_HALF, 0.0)
        stop1 = np.exp(kt1 + _LOG_HALF - whole1)
        z, a = n0.sum(axis=0), n1.sum(axis=0)
        kt0 = kt_log_block(z, a)
        whole0 = np.logaddexp(kt0, whole1.sum(axis=0)) + _LOG_HALF
        stop0 = np.exp(kt0 + _LOG_HALF - whole0)
        q0 = np.broadcast_to((a + 0.5) / (z + a + 1.0), (256, 256))
        q1 = (n1 + 0.5) / (n0 + n1 + 1.0)
        self.mixed = np.where(seen, stop0 * q0 + (1 - stop0) * stop1 * q1, 0.0)
        self.left = np.where(seen, (1 - stop0) * (1 - stop1), 1.0)
        self.last = np.where(seen, q1, q0)
        self.seen = seen


def _code(window: np.ndarray, train: np.ndarray, upper: _Upper) -> np.ndarray:
    """log10 of the probability of the last byte of each window, all of one pair of preceding bytes."""
    tree = _Subtree(window, train)
    byte, context = window & np.uint64(255), window >> np.uint64(8)
    c1 = (context & np.uint64(255)).astype(np.int64)
    out = np.zeros(len(window))
    for b in range(8):
        prefix = _prefix(byte, b)
        at = (c1, prefix.astype(np.int64))
        p, left, last, alive = upper.mixed[at], upper.left[at], upper.last[at], upper.seen[at]
        for d in range(2, DEPTH + 1):
            if not len(tree.keys[d]):
                break
            key = ((context & np.uint64((1 << (8 * d)) - 1)) << np.uint64(8)) | prefix
            i = np.minimum(np.searchsorted(tree.keys[d], key), len(tree.keys[d]) - 1)
            alive = alive & (tree.keys[d][i] == key)
            q = (tree.n1[d][i] + 0.5) / (tree.n0[d][i] + tree.n1[d][i] + 1.0)
            stop = tree.stop[d][i]
            p = np.where(alive, p + left * stop * q, p)
            left = np.where(alive, left * (1 - stop), left)
            last = np.where(alive, q, last)
        p = p + left * last
        one = ((byte >> np.uint64(7 - b)) & np.uint64(1)).astype(bool)
        out += np.log10(np.where(one, p, 1 - p))
    return out


def _heavy(table: DataFrame, value: str, at_most: int) -> tuple[DataFrame, int]:
    """The heaviest keys, by a power-of-two threshold that leaves at most ``at_most``, and it."""
    level = F.floor(F.log2(F.col("total"))).cast("int")
    counts = {r["level"]: r["n"] for r in table.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()}
    kept, threshold = 0, 1 << 62
    for k in sorted(counts, reverse=True):
        if kept + counts[k] > at_most:
            break
        kept, threshold = kept + counts[k], 1 << k
    if kept == sum(counts.values()):
        threshold = 1
    return table.filter(F.col("total") >= threshold).select("key", value, "total"), threshold


def train(documents: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """Count ``documents`` (text, held_out) and weight the tree.

    Returns the code table (key, value = log10 probability, total) of all windows, the vocabulary
    (key, value = training count, total) of all words, and N and V of the training tokens.
    """
    counted = documents.mapInArrow(_count, _COUNT_SCHEMA)
    counts = counted.groupBy("kind", "key").agg(F.sum("train").alias("train"), F.sum("total").alias("total"))
    counts = materialize(counts, "ctw-counts")
    windows = counts.filter(F.col("kind") == WINDOW).select("key", "train", "total")
    by_pair = F.shiftrightunsigned(F.col("key"), 8).bitwiseAND(F.lit(0xFFFF))
    top = (
        windows.groupBy(by_pair.alias("pair"))
        .applyInPandas(_top_nodes, "c1 int, prefix int, n0 long, n1 long, below double")
        .groupBy("c1", "prefix")
        .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("below").alias("below"))
        .toPandas()  # at most 256 x 255 rows
    )
    upper = documents.sparkSession.sparkContext.broadcast(_Upper(top))

    def code(pdf: pd.DataFrame) -> pd.DataFrame:
        value = _code(pdf["key"].to_numpy().view(np.uint64), pdf["train"].to_numpy(), upper.value)
        return pd.DataFrame({"key": pdf["key"], "value": value, "total": pdf["total"]})

    codes = materialize(windows.groupBy(by_pair.alias("pair")).applyInPandas(code, "key long, value double, total long"), "ctw-codes")
    vocabulary = counts.filter(F.col("kind") == WORD).select("key", F.col("train").cast("double").alias("value"), "total")
    known = vocabulary.agg(
        F.coalesce(F.sum("value"), F.lit(0.0)).cast("long").alias("n"), F.count_if(F.col("value") > 0).alias("v")
    ).first()
    return codes, vocabulary, known["n"], known["v"]


def _lookup(frame: DataFrame) -> Lookup:
    t = frame.toArrow()
    key = np.concatenate([np.zeros(0, np.int64), *(c.to_numpy() for c in t.column(0).chunks)]).view(np.uint64)
    value = np.concatenate([np.zeros(0), *(c.to_numpy() for c in t.column(1).chunks)]).astype(np.float64)
    total = np.concatenate([np.zeros(0, np.int64), *(c.to_numpy() for c in t.column(2).chunks)])
    return Lookup(key, value, total)


_SCORED = (
    "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, "
    "rare array<struct<kind:int,key:long,n:long>>"
)


def score(documents: DataFrame, max_broadcast: int = 1 << 19, modulus: int = 10) -> DataFrame:
    """Score every text of ``documents`` (doc_id, text) by the tree learnt from those not held out.

    Held out are the rows whose crc32(doc_id as text) modulo ``modulus`` is 0. Returns doc_id,
    held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte (over the bytes of
    the token sequence, its end counted as one). A null text is an empty one, with the end as its one
    token; a null id is kept and hashed as an empty text; repeated rows are scored each; without
    training rows every decision has probability one half; an empty table gives no rows. Other
    columns are ignored. Long texts are read whole.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("held_out", held_out_column(modulus=modulus))
    spark = documents.sparkSession
    codes, vocabulary, n_train, v_train = train(docs.select("text", "held_out"))
    heavy_codes, code_threshold = _heavy(codes, "value", max_broadcast)
    heavy_words, word_threshold = _heavy(vocabulary, "value", max_broadcast)
    tables = {
        WINDOW: spark.sparkContext.broadcast(_lookup(heavy_codes)),
        WORD: spark.sparkContext.broadcast(_lookup(heavy_words)),
    }
    denominator = n_train + 0.1 * (v_train + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code_table, word_table = tables[WINDOW].value, tables[WORD].value
        for batch in batches:
            for s in slices(batch.column("text")):
                window, at = _windows(s)
                w = words(s)
                h = word_hashes(s, w)
                found = code_table.find(window)
                value = np.where(found >= 0, code_table.values[found], 0.0) if len(code_table.values) else np.zeros(len(window))
                total = np.concatenate(([0.0], np.cumsum(value, dtype=np.float64)))
                log_p = total[at[1:]] - total[at[:-1]]
                # Words, with each row's end token after them.
                counts = w.counts() + 1
                key = np.full(int(counts.sum()), END_KEY, dtype=np.uint64)
                word_row = np.repeat(np.arange(s.rows), w.counts())
                key[np.arange(len(h)) + word_row] = h
                first = np.concatenate(([0], np.cumsum(counts)))
                spot = word_table.find(key)
                c = np.where(spot >= 0, word_table.values[spot], 0.0).astype(np.float64) if len(word_table.values) else np.zeros(len(key))
                base = np.where(spot >= 0, np.log10((c + 0.1) / denominator), 0.0)
                base_sum = np.concatenate(([0.0], np.cumsum(base)))
                known = np.concatenate(([0], np.cumsum(c > 0)))
                kinds, keys, numbers, owner = [], [], [], []
                for kind, k, miss, offsets in ((WINDOW, window, found < 0, at), (WORD, key, spot < 0, first)):
                    index = np.flatnonzero(miss)
                    row = np.searchsorted(offsets, index, side="right") - 1
                    order = np.lexsort((k[index], row))
                    r, v = row[order], k[index][order]
                    new = np.ones(len(r), dtype=bool)
                    new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
                    begin = np.flatnonzero(new)
                    owner.append(r[begin])
                    keys.append(v[begin])
                    numbers.append(np.diff(np.concatenate((begin, [len(r)]))))
                    kinds.append(np.full(len(begin), kind, np.int32))
                owner_all = np.concatenate(owner)
                order = np.argsort(owner_all, kind="stable")
                offsets = np.searchsorted(owner_all[order], np.arange(s.rows + 1)).astype(np.int32)
                rare = pa.ListArray.from_arrays(
                    pa.array(offsets),
                    pa.StructArray.from_arrays(
                        [
                            pa.array(np.concatenate(kinds)[order]),
                            pa.array(np.concatenate(keys)[order].view(np.int64)),
                            pa.array(np.concatenate(numbers)[order].astype(np.int64)),
                        ],
                        names=["kind", "key", "n"],
                    ),
                )
                part = batch.slice(s.first, s.rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row"),
                        part.column("doc_id"),
                        part.column("held_out"),
                        pa.array(counts.astype(np.int64)),
                        pa.array((known[first[1:]] - known[first[:-1]]).astype(np.int64)),
                        pa.array(base_sum[first[1:]] - base_sum[first[:-1]]),
                        pa.array(log_p),
                        rare,
                        pa.array(np.diff(at).astype(np.int64)),
                    ],
                    names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare", "n_bytes"],
                )

    scored = docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, _SCORED + ", n_bytes long")
    scored = materialize(scored, "ctw-scored")
    rare = scored.select("row", F.explode("rare").alias("x")).select("row", "x.kind", "x.key", "x.n")
    rare_code = codes.filter(F.col("total") < code_threshold).select(F.lit(WINDOW).alias("kind"), "key", "value")
    rare_word = vocabulary.filter(F.col("total") < word_threshold).select(F.lit(WORD).alias("kind"), "key", "value")
    joined = rare.join(rare_code.unionByName(rare_word), ["kind", "key"])
    is_word = F.col("kind") == WORD
    late = joined.groupBy("row").agg(
        F.sum(F.when(is_word & (F.col("value") > 0), F.col("n")).otherwise(0)).alias("n_known"),
        F.sum(F.when(is_word, F.col("n") * F.log10((F.col("value") + 0.1) / F.lit(denominator))).otherwise(0.0)).alias("base_score"),
        F.sum(F.when(is_word, 0.0).otherwise(F.col("n") * F.col("value"))).alias("score"),
    )
    none = F.lit(None)
    both = scored.drop("rare").unionByName(
        late.select(
            "row", none.cast("long").alias("doc_id"), none.cast("boolean").alias("held_out"), none.cast("long").alias("n_tokens"),
            "n_known", "base_score", "score", none.cast("long").alias("n_bytes"),
        )
    )
    return (
        both.groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
            F.sum("n_known").alias("n_known"), F.sum("base_score").alias("base_score"), F.sum("score").alias("score"),
            F.max("n_bytes").alias("n_bytes"),
        )
        .select(
            "doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score",
            (-F.col("score") * F.lit(float(np.log2(10))) / F.col("n_bytes")).alias("bits_per_byte"),
        )
    )
