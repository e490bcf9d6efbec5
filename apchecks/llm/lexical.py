"""Ranked lexical search as exact maximum inner products, in buckets of vectors ordered by length.

A document is a vector of integer impacts over the terms that some query asks for, a query a vector of
integer weights; a score is their inner product. Each task orders its documents' vectors by length and
cuts them into buckets, in the manner of LEMP. A query skips every bucket whose longest vector cannot
reach the query's threshold by the Cauchy-Schwarz inequality. Inside a bucket the query's heaviest
coordinates are looked at first: what they give, plus the lengths of the rests multiplied, bounds the
score of each vector. Survivors are scored again in 64-bit integers, so results are exact.

Thresholds come from the longest vectors, which are searched first: a query's k-th best score among
them holds for all other vectors. Vectors never move between tasks: a task sorts what it reads, and
hands on at most k rows a query.

Queries are worked on in blocks of at most ``block_terms`` terms (a single query may have more), whose
vocabulary and weights go to all tasks; every block searches all documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, materialize

#: Terms, on characters and on UTF-8 bytes: every byte from 0x80 belongs to a term.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM_BYTES = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_COUNTED = "doc_id long, n long, terms array<int>, tfs array<int>"


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms): the distinct terms of all rows of an item; null texts have none."""
    lowered = F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER)
    found = items.select("item_id", F.explode(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))).alias("term")).distinct()
    return found.groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms"))


def query_blocks(terms: DataFrame, block_terms: int) -> tuple[DataFrame, int]:
    """``terms`` with a column ``block``, and the number of blocks: none has more terms than the bound,
    but for one that holds a single query."""
    size = F.size("terms").cast("long")
    blocks = max(-(-(terms.select(F.sum(size)).first()[0] or 0) // block_terms), 1)
    while True:
        dealt = terms.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
        sums = dealt.groupBy("block").agg(F.sum(size).alias("s"), F.count("*").alias("c"))
        if sums.filter((F.col("s") > block_terms) & (F.col("c") > 1)).isEmpty():
            return dealt, blocks
        blocks *= 2


@dataclass
class Block:
    """Queries as a sparse matrix: of query i the ids and weights ``offsets[i]`` to ``offsets[i + 1]``, heaviest first."""

    offsets: np.ndarray
    ids: np.ndarray
    weights: np.ndarray

    def query(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.offsets[i], self.offsets[i + 1])
        return self.ids[part], self.weights[part]


def count_terms(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of every row that has a term: all its terms counted, those of the vocabulary one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, sizes, lengths, ids, tfs = [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                found = _TERM_BYTES.findall(text.as_buffer().to_pybytes().lower()) if text.is_valid else ()
                if found:
                    known = [(vocabulary[t], c) for t, c in Counter(found).items() if t in vocabulary]
                    keep.append(row)
                    sizes.append(len(found))
                    lengths.append(len(known))
                    ids += [k[0] for k in known]
                    tfs += [k[1] for k in known]
            offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (ids, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, _COUNTED)


def impact_vectors(counted: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """(doc_id, terms, impacts, length) of the rows with a term of the vocabulary; impacts are integers."""
    m = F.expr(f"10 + (90 * n * {n_docs}L) div {n_terms}L")
    v = counted.filter(F.size("terms") > 0).withColumn("m", m)
    v = v.select("doc_id", "terms", F.expr("transform(tfs, f -> (1000000000L * f) div (1000L * f + 8 * m))").alias("impacts"))
    return v.withColumn("length", F.expr("sqrt(aggregate(impacts, 0D, (s, x) -> s + double(x) * double(x)))"))


class Best:
    """The k best of a query so far: highest score, then smallest doc_id, null last."""

    def __init__(self, k: int, floor: int):
        self.k, self.floor = k, floor
        self.scores = np.empty(0, np.int64)
        self.ids = np.empty(0, np.int64)
        self.null = np.empty(0, bool)

    @property
    def threshold(self) -> int:
        return max(self.floor, int(self.scores[-1])) if len(self.scores) == self.k else self.floor

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        s, i, z = np.concatenate((self.scores, scores)), np.concatenate((self.ids, ids)), np.concatenate((self.null, null))
        first = np.lexsort((i, z, -s))[: self.k]
        self.scores, self.ids, self.null = s[first], i[first], z[first]


class Bucket:
    """Vectors of like length, by row and by coordinate."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, lengths: np.ndarray, offsets: np.ndarray, terms: np.ndarray, impacts: np.ndarray, vocabulary: int):
        self.ids, self.null, self.offsets, self.terms, self.impacts = ids, null, offsets, terms, impacts
        self.longest = float(lengths.max())
        self.squares = lengths**2
        rows = np.repeat(np.arange(len(ids)), np.diff(offsets))
        order = np.argsort(terms, kind="stable")
        self.rows, self.values = rows[order], impacts[order].astype(np.float64)
        self.starts = np.searchsorted(terms[order], np.arange(vocabulary + 1))

    def survivors(self, terms: np.ndarray, weights: np.ndarray, focus: int, threshold: int) -> np.ndarray:
        """Rows whose bound by the query's heaviest coordinates reaches the threshold."""
        part, seen = np.zeros(len(self.ids)), np.zeros(len(self.ids))
        for t, w in zip(terms[:focus], weights[:focus]):
            at = slice(self.starts[t], self.starts[t + 1])
            rows, x = self.rows[at], self.values[at]
            part[rows] += w * x
            seen[rows] += x * x
        rest = float(np.sqrt((weights[focus:].astype(np.float64) ** 2).sum()))
        bound = part + rest * np.sqrt(np.maximum(self.squares - seen, 0.0))
        return np.nonzero(bound * (1 + 1e-9) + 1 >= threshold)[0]

    def scores(self, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores of some rows in integers."""
        order = np.argsort(terms)
        terms, weights = terms[order], weights[order]
        sizes = (self.offsets[rows + 1] - self.offsets[rows]).astype(np.int64)
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        at = np.arange(sizes.sum()) - np.repeat(starts - self.offsets[rows], sizes)
        place = np.minimum(np.searchsorted(terms, self.terms[at]), len(terms) - 1)
        gain = np.where(terms[place] == self.terms[at], weights[place] * self.impacts[at], 0)
        return np.add.reduceat(gain, starts)


def search_vectors(vectors: DataFrame, block: Block, vocabulary: int, k: int, floors: np.ndarray, bucket_rows: int, focus: int) -> DataFrame:
    """(query, doc_id, score): what each task finds best for each query of the block, at most k rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(block.offsets) - 1
        best = [Best(k, int(f)) for f in floors]
        lengths = np.array([np.sqrt((block.query(i)[1].astype(np.float64) ** 2).sum()) for i in range(n)])
        limits = floors.astype(np.float64)
        for batch in batches:
            for first in range(0, batch.num_rows, bucket_rows):
                part = batch.slice(first, bucket_rows)
                doc, terms, impacts = part.column(0), part.column(1), part.column(2)
                offsets = terms.offsets.to_numpy() - terms.offsets[0].as_py()
                bucket = Bucket(
                    doc.fill_null(0).to_numpy(zero_copy_only=False), doc.is_null().to_numpy(zero_copy_only=False), part.column(3).to_numpy(), offsets,
                    terms.flatten().to_numpy(), impacts.flatten().to_numpy(), vocabulary,
                )
                for i in np.nonzero(lengths * bucket.longest * (1 + 1e-9) + 1 >= limits)[0]:
                    ids, weights = block.query(i)
                    rows = bucket.survivors(ids, weights, focus, best[i].threshold)
                    if len(rows):
                        scores = bucket.scores(rows, ids, weights)
                        good = scores >= best[i].threshold
                        best[i].add(scores[good], bucket.ids[rows[good]], bucket.null[rows[good]])
                        limits[i] = best[i].threshold
        sizes = [len(b.scores) for b in best]
        if sum(sizes):
            join = lambda name: np.concatenate([getattr(b, name) for b in best])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(n), sizes).astype(np.int32)), pa.array(join("ids"), mask=join("null")), pa.array(join("scores"))], names=["query", "doc_id", "score"]
            )

    ordered = vectors.select("doc_id", "terms", "impacts", "length").sortWithinPartitions(F.desc("length"))
    return ordered.mapInArrow(run, "query int, doc_id long, score long")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = 1 << 18, bucket_rows: int = 2048, focus: int = 12, first_share: float = 0.05
) -> DataFrame:
    """The k highest-scoring documents with a score above 0 of every item: (item_id, rank, doc_id, score).

    Equal scores stand by ascending doc_id, null last. Rows of ``docs`` are documents of their own, also
    where an id or a text repeats; null and empty texts and texts without a term are none. Rows of one
    item_id are one item with the terms of all, a null item_id is an item like others, items without
    a term or without a match give no rows, as do empty tables. Other columns play no part.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lexical")
    dealt, blocks = query_blocks(materialize(query_terms(items), "lexical-items"), block_terms)
    out = None
    for b in range(blocks):
        queries = dealt.filter(F.col("block") == b).select("item_id", "terms").collect()  # at most block_terms terms
        words = sorted({t for q in queries for t in q["terms"]})
        vocabulary = {t.encode(): i for i, t in enumerate(words)}
        counted = scratch.save(count_terms(docs, vocabulary), "counts")
        n_docs, n_terms = counted.select(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs or not queries:
            continue
        df = np.zeros(len(words), np.int64)
        for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most a row a term of the block
            df[r["t"]] = r["count"]
        weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
        sparse = [np.array([vocabulary[t.encode()] for t in q["terms"]], np.int64) for q in queries]
        sparse = [s[np.argsort(-weight[s], kind="stable")] for s in sparse]
        ids = np.concatenate(sparse)
        block = Block(np.concatenate(([0], np.cumsum([len(s) for s in sparse]))), ids, weight[ids])

        vectors = impact_vectors(counted, n_docs, n_terms)
        cut = vectors.select(F.percentile_approx("length", 1 - first_share, 1000)).first()[0] or 0.0
        floors = np.ones(len(queries), np.int64)
        longest = search_vectors(vectors.filter(F.col("length") >= cut), block, len(words), k, floors, bucket_rows, focus)
        seeds = scratch.save(_top(longest, k).drop("rank"), "seeds")
        for r in seeds.groupBy("query").agg(F.min("score").alias("s"), F.count("*").alias("c")).filter(F.col("c") == k).collect():
            floors[r["query"]] = r["s"]
        others = search_vectors(vectors.filter(F.col("length") < cut), block, len(words), k, floors, bucket_rows, focus)
        names = spark.createDataFrame([(i, q["item_id"]) for i, q in enumerate(queries)], f"query int, item_id {dict(items.dtypes)['item_id']}")
        top = _top(seeds.unionByName(others), k).join(names, "query").select("item_id", "rank", "doc_id", "score")
        found = materialize(top, "lexical-found")
        scratch.drop("counts", "seeds")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"item_id {dict(items.dtypes)['item_id']}, rank int, doc_id long, score long")
    return out


#: DuckDB SQL of the query over the tables ``documents`` and ``benchmark``.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), s AS (
  SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0
), tf AS (
  SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark
), df AS (
  SELECT t, count(*)::BIGINT AS df FROM tf WHERE t IN (SELECT t FROM q) GROUP BY t
), hit AS (
  SELECT q.item_id, d.r, d.doc_id,
    sum(floor(1000 * ln((2 * s.n + 2) / (2 * df.df + 1)::DOUBLE))::BIGINT
      * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (10 + (90 * len(d.w)::BIGINT * s.n) // s.l))))::BIGINT AS score
  FROM q JOIN df USING (t) JOIN tf USING (t) JOIN d USING (r) CROSS JOIN s GROUP BY ALL
), best AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS k FROM hit WHERE score > 0
)
SELECT item_id, k::INTEGER AS rank, doc_id, score FROM best WHERE k <= 10
"""
