"""Mixing sources to target weights by pivotal dependent rounding in a reduction tree.

A source's target gives each of its documents the same real number of copies. The whole part is taken
at once; the fractional parts are rounded dependently. Two documents at a time exchange word mass:
their fractions move in opposite directions, in one of the two ways chosen at random so that
expectations stay, until one of them is 0 or 1. Mass is kept, so a source's words stay at its target.

The tree's leaves are fixed hash prefixes of the document ids inside a source, so a source with a
third of all rows is spread over ``2**LEAF_BITS`` leaves. A leaf walks its documents in hash order and
leaves at most one fractional document; the next levels join ``2**LEVEL_BITS`` groups each, up to one
document per source. That last document is taken in part: the words that its fraction is of its size.
The random numbers are hashes of the ids, so that reruns, retries and other partitionings agree.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, materialize

LEAF_BITS = 12
LEVEL_BITS = 4
#: Fractions this near to 0 or 1 count as whole.
NEAR = 1e-9

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
_MASK = (1 << 64) - 1


def word_count(text: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, at_most: float = 2.0) -> DataFrame:
    """Targets of ``sizes`` (source, source_size): one row per source with rank and target.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` of all words.
    A target stops at ``at_most`` times its source's size and what is above is shared again by weight,
    until none is above: then every target is the smaller of its limit and one common rate times its
    weight. The rate is found from running sums in the order in which sources reach their limits.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    ranked = sizes.select("source", "source_size", F.row_number().over(by_name).alias("rank"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    limit = F.col("source_size") * at_most
    t = ranked.withColumns({"weight": weight, "limit": limit, "full_at": limit / weight})
    order = Window.orderBy("full_at", "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    free = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    t = t.withColumn("rate", left / free).withColumn("place", F.row_number().over(order))
    fits = F.when(F.col("rate") <= F.col("full_at") * (1 + 1e-12), F.struct("place", "rate"))
    t = t.withColumn("common", F.min(fits).over(everything)["rate"])
    target = F.when(F.col("common").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("common") * F.col("weight")))
    return t.select("source", "source_size", F.col("rank").cast("long").alias("rank"), target.alias("target"))


def _unit(a: int, b: int) -> float:
    """A number in [0, 1) from two 64-bit hashes."""
    x = (a * 0x9E3779B97F4A7C15 + (b ^ (b >> 31)) * 0xBF58476D1CE4E5B9) & _MASK
    x ^= x >> 30
    x = (x * 0x94D049BB133111EB) & _MASK
    x ^= x >> 31
    return (x >> 11) / float(1 << 53)


def exchange(p: float, w: float, q: float, v: float, u: float) -> tuple[float, float]:
    """New fractions of two documents (fractions p and q, sizes w and v); one of them is whole."""
    up, down = min(w * (1 - p), v * q), min(w * p, v * (1 - q))
    if u * (up + down) < down:
        p, q = p + up / w, q - up / v
    else:
        p, q = p - down / w, q + down / v
    near = lambda x: 0.0 if x < NEAR else 1.0 if x > 1 - NEAR else x
    return near(p), near(q)


_STATE = "rank long, leaf long, h long, doc_id long, size long, source_size long, target double, p double, copies long, row_hash long"


def _level(rows: DataFrame, shift: int) -> DataFrame:
    """Rounds inside the groups of one level; at most one row of a group keeps a fraction."""
    group = F.shiftright("leaf", shift)
    dealt = rows.repartition(F.col("rank"), group).sortWithinPartitions("rank", group, "h", "doc_id", "size", "row_hash")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list | None = None
        carry_group: tuple | None = None
        for batch in batches:
            done: list[list] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                new = list(row)
                here = (new[0], new[1] >> shift)
                if carry is not None and carry_group != here:
                    done.append(carry)
                    carry = None
                if 0.0 < new[7] < 1.0 and new[4] > 0:
                    if carry is not None:
                        carry[7], new[7] = exchange(carry[7], carry[4], new[7], new[4], _unit(carry[2] & _MASK, new[2] & _MASK))
                        if 0.0 < new[7] < 1.0:
                            carry, new = new, carry
                        elif not 0.0 < carry[7] < 1.0:
                            done.append(carry)
                            carry = None
                    else:
                        carry, new = new, None
                    carry_group = here
                if new is not None:
                    done.append(new)
            if done:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*done), batch.schema)], schema=batch.schema
                )
        if carry is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(carry, batch.schema)], schema=batch.schema)

    return dealt.mapInArrow(run, _STATE)


def mix_plan(
    documents: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, at_most: float = 2.0, seed: int = 7
) -> DataFrame:
    """How much the mix takes of each row of ``documents`` (doc_id, text, source).

    Returns doc_id, source, size (words), source_size, target (the source's), copies (whole copies),
    cut (words of one more, partial copy) and taken (words in all). A null source is a source of its
    own, the last; a text without words (null, empty or blank) comes once, whatever its source's rate, and
    nothing is taken of it; null ids hash as one value; repeated rows count each; an empty table gives no rows;
    other columns are ignored.
    """
    return _plan(documents, F.xxhash64("text"), weights, share, at_most, seed).drop("row_hash")


def _plan(
    documents: DataFrame, row_hash: Column, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, at_most: float = 2.0, seed: int = 7
) -> DataFrame:
    """The plan with ``row_hash``, which tells rows of one id, source and size apart."""
    docs = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count("text").alias("size"),
        row_hash.alias("row_hash"),
    )
    scratch = Scratch(documents.sparkSession, "mix")
    docs = scratch.save(docs, "sizes")
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = scratch.save(source_targets(sizes, weights, share, at_most), "targets")
    h = F.xxhash64(F.lit(seed), "doc_id")
    named = docs.withColumn("named", F.struct(F.col("source").isNull(), F.coalesce("source", F.lit(""))))
    keys = targets.select(
        F.struct(F.col("source").isNull(), F.coalesce("source", F.lit(""))).alias("named"), "source_size", "target", "rank"
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = named.join(keys, "named").withColumn("rate", rate)
    whole = F.floor(F.col("rate") + NEAR)
    part = F.greatest(F.col("rate") - whole, F.lit(0.0))
    state = rows.select(
        "rank", F.shiftrightunsigned(h, 64 - LEAF_BITS).alias("leaf"), h.alias("h"), "doc_id", "size", "source_size", "target",
        F.when(part < NEAR, 0.0).otherwise(part).alias("p"), whole.cast("long").alias("copies"), "row_hash",
    )
    done = []
    open_rows = state
    for shift in (*range(0, LEAF_BITS, LEVEL_BITS), LEAF_BITS):
        level = scratch.save(_level(open_rows, shift), f"level-{shift}")
        fractional = (F.col("p") > 0) & (F.col("p") < 1) & (F.col("size") > 0)
        open_rows = level.filter(fractional)
        done.append(level.filter(~fractional) if shift < LEAF_BITS else level)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    fractional = (F.col("p") > 0) & (F.col("p") < 1)
    copies = F.when(F.col("size") == 0, 1).otherwise(F.col("copies") + F.when(F.col("p") >= 1, 1).otherwise(0))
    cut = F.when(fractional, F.round(F.col("p") * F.col("size"))).otherwise(0).cast("long")
    names = targets.select("rank", "source")
    plan = out.join(names, "rank").select(
        "doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"), cut.alias("cut"),
        (copies * F.col("size") + cut).cast("long").alias("taken"), "row_hash",
    )
    plan = materialize(plan, "mix-plan")
    scratch.drop(*list(scratch.paths))
    return plan


def _row_hash(documents: DataFrame) -> Column:
    """A hash of all columns, in which a null differs from a value left out; nested ones count as JSON."""
    flat = [F.to_json(F.struct(f"`{c}`")) if kind.startswith(("struct", "array", "map")) else F.col(f"`{c}`") for c, kind in documents.dtypes]
    return F.xxhash64(*flat, *(F.col(f"`{c}`").isNull() for c in documents.columns))


def mix(documents: DataFrame, **settings) -> DataFrame:
    """The mixed rows: each document's row once per copy, and the cut text where a part is taken.

    Only rows that agree in all columns count as repeats of one document; they are known by a hash of
    the row beside doc_id, source and size. Documents without words have nothing to take and come once for
    each of their rows.
    """
    row_hash = _row_hash(documents)
    plan = _plan(documents, row_hash, **settings)
    per_document = plan.groupBy("doc_id", "source", "size", "row_hash").agg(F.sum("copies").alias("n_copies"), F.max("cut").alias("n_cut"))
    per_document = per_document.filter("n_copies > 0 or n_cut > 0")
    columns = documents.columns
    # Rows are shuffled once: alike ones are dropped by the same columns, none of them null, that the plan is joined on.
    key = lambda id_, source: {"no_id": id_.isNull(), "id": F.coalesce(id_, F.lit(0)), "no_src": source.isNull(), "src": F.coalesce(source, F.lit(""))}
    wrapped = documents.select(F.struct("*").alias("row"), row_hash.alias("hash"))
    left = wrapped.withColumns(key(F.col("row.doc_id").cast("long"), F.col("row.source").cast("string")) | {"words": word_count(F.col("row.text"))})
    right = per_document.select(
        *(c.alias(n) for n, c in key(F.col("doc_id"), F.col("source")).items()), F.col("size").alias("words"), F.col("row_hash").alias("hash"), "n_copies", "n_cut"
    )
    same = ["no_id", "id", "no_src", "src", "words", "hash"]
    joined = left.dropDuplicates(same).join(right, same)
    first = F.col("row").withField("text", F.expr(_first_words_sql()))
    rows = F.concat(F.array_repeat("row", F.col("n_copies").cast("int")), F.when(F.col("n_cut") > 0, F.array(first)).otherwise(F.array_repeat("row", F.lit(0))))
    return joined.select(F.explode(rows).alias("row")).select(*(F.col(f"row.`{c}`").alias(c) for c in columns))


def _first_words_sql() -> str:
    """The text up to the end of its ``n_cut``-th word, with the separators as they stand."""
    words = r"regexp_extract_all(row.text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+', 0)"
    return f"array_join(slice({words}, 1, cast(n_cut as int)), '')"
