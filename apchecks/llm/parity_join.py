"""Near-duplicate groups by a parity-sketch join on word shingles.

A document's set is its distinct ``k``-word shingles, each a 64-bit hash. A parity sketch gives every
shingle one bit and toggles it, so that the Hamming distance of two sketches is never above the size
of the sets' symmetric difference. Two sets of sizes a <= b with a Jaccard similarity of p percent or
more differ in at most (a + b)(100 - p)/(100 + p) shingles.

Candidates. Size bands are so wide that linked sets lie in one band or in two neighbours. For each band
join the sketch is dealt into more blocks than the largest difference t allowed there: t + 1 + spare.
By the pigeonhole principle linked sets agree on ``spare + 1`` blocks. Blocks are wide and sparse, so a
block stands as the XOR of 64-bit words of its set bits. Each document leaves out its ``thin`` thinnest
blocks, in one order for all (shingles held, then place): what it leaves out of the agreeing blocks is a
beginning of these, so linked sets still have ``spare + 1 - thin`` agreeing blocks in common. Sets of up to
``SMALL_SET`` shingles, where blocks would often be empty, take each shingle as a block of its own: linked
sets share p percent of either's shingles.

Documents with the same block meet in a bucket. Of the blocks that some other document shares, a document
leaves out the most frequent ones in turn, all but one of those that it must share with a linked set
(``need``); with fewer than ``need`` shared blocks it links with nothing. So passages that many documents
share make few candidates. Buckets that hold a large part of a fixed sample of documents are known
beforehand and dealt over several tasks.

Equal sets are one class beforehand. In each bucket members are compared with its smallest and its largest
key (never all pairs), pairs pass a size test and the Hamming test of a 256-bit sketch, and then their
sets are compared exactly: first each with its likeliest partner, then those that this left apart.
Components of these links are formed. Members of buckets that still hold several components are compared
with 16 of the bucket; in what is still mixed then, members outside the bucket's main component are tested
against the others, in parts of a bounded size, and only pairs that pass the Hamming test leave the join.
As every linked pair shares a bucket, it is then either compared or inside one component.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, materialize, small_batches
from .graph import components
from .idfilter import hits, key_filter
from .textops import distinct_per_row, mix64, shingle_hashes, slices, word_hashes, words
from .tokens import release

SKETCH_LONGS = 4
#: Words of the sketch that members of mixed buckets are tested by, which still tells large sets apart.
WIDE_LONGS = 24
#: Sets up to this size have their shingles as blocks, joined in one band.
SMALL_SET = 32
#: Documents of the fixed sample that finds hot buckets, and the count there that makes a bucket hot.
HOT_SAMPLE, HOT_COUNT = 4096, 16
#: Tasks over which the entries of a hot bucket are dealt.
HOT_PARTS = 64
#: Members of a mixed bucket with which all its others are compared before it is compared whole.
MORE_PIVOTS = 16
#: Members of a bucket that one task holds against the others.
CHUNK = 4096


def band_edges(largest: int, percent: int) -> np.ndarray:
    """First sizes of the bands above ``SMALL_SET``: linked sizes lie in the same band or in neighbours."""
    edges = [SMALL_SET + 1]
    while edges[-1] <= largest:
        edges.append(max(edges[-1] + 1, -(-100 * edges[-1] // percent)))
    for _ in range(2):
        edges.append(max(edges[-1] + 1, -(-100 * edges[-1] // percent)))
    return np.array(edges, dtype=np.int64)


def most_different(edges: np.ndarray, percent: int) -> np.ndarray:
    """For each band join, the most shingles in which linked sets with their larger in it differ."""
    return 2 * (edges[1:] - 1) * (100 - percent) // (100 + percent)


def _small_entries(values: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, row and group (need * 4) of the shingles of sets that can have a linked set of small size."""
    sizes = np.diff(at)
    linkable = 100 * sizes >= percent * (sizes + 1)  # else no other set is near enough
    chosen = linkable & (percent * sizes <= 100 * SMALL_SET)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    held = chosen[owner]
    need = -(-percent * sizes // 100)
    return mix64(values[held] + np.uint64(0x2545F4914F6CDD1D)), owner[held], need[owner[held]] * 4


def _entries_of(values: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, row and group of all entries; a group is its need times four and the row's band join."""
    sizes = np.diff(at)
    rows = len(sizes)
    edges = band_edges(int(sizes.max(initial=1)), percent)
    limit = most_different(edges, percent)
    spare = 3 + -(-limit // 4)  # more than a set usually has empty blocks
    thin = spare // 2
    blocks = limit + 1 + spare
    need = spare + 1 - thin
    own = np.searchsorted(edges, sizes, side="right") - 1
    large = sizes > SMALL_SET
    owner = np.repeat(np.arange(rows), sizes)
    owner, values_ = owner[large[owner]], values[large[owner]]
    place = mix64(values_ ^ np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)
    word = mix64(values_ + np.uint64(0x165667B19E3779F9))
    found = [_small_entries(values, at, percent)]
    for side in (0, 1):
        join = np.where(large, own + side, 0)
        k = np.where(large, blocks[join], 0)
        begin = np.concatenate(([0], np.cumsum(k)))
        block = ((place * k[owner].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        flat = begin[owner] + block
        sketch = np.zeros(int(begin[-1]), dtype=np.uint64)
        np.bitwise_xor.at(sketch, flat, word)
        held = np.bincount(flat, minlength=len(sketch))
        row = np.repeat(np.arange(rows), k)
        index = np.arange(len(sketch)) - begin[row]
        order = np.argsort((row << 40) + (np.minimum(held, (1 << 16) - 1) << 24) + np.minimum(index, (1 << 24) - 1), kind="stable")
        keep = order[np.arange(len(order)) - begin[row[order]] >= thin[join[row[order]]]]
        keep.sort()
        tag = mix64(join[row].astype(np.uint64) * np.uint64(0x100000001B3) + index.astype(np.uint64) + np.uint64(1))
        found.append((mix64(sketch ^ tag)[keep], row[keep], need[join[row[keep]]] * 4 + 1 + side))
    return tuple(np.concatenate(part) for part in zip(*found))


def _parity(values: np.ndarray, at: np.ndarray, longs: int = SKETCH_LONGS) -> np.ndarray:
    """The parity sketch of each row, as rows of ``longs`` 64-bit words."""
    rows = len(at) - 1
    owner = np.repeat(np.arange(rows), np.diff(at))
    bit = mix64(values * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7))
    out = np.zeros(rows * longs, dtype=np.uint64)
    spot = owner * longs + ((bit >> np.uint64(6)) % np.uint64(longs)).astype(np.int64)
    np.bitwise_xor.at(out, spot, np.uint64(1) << (bit & np.uint64(63)))
    return out.reshape(rows, longs)


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for s in slices(column):
        w = words(s)
        value, row = shingle_hashes(word_hashes(s, w), w.first, k)
        v, at = distinct_per_row(value, row, s.rows)
        yield s.first, s.rows, v, at


def _long_list(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))


def _sketched(docs: DataFrame, k: int) -> DataFrame:
    """Of each row its key and id, the size of its set, two sums that stand for the set, and its parity sketch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for first, rows, v, at in _sets(batch.column("text"), k):
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(v)))
                mixed = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(v ^ np.uint64(0x27D4EB2F165667C5)))))
                parity = _parity(v, at)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row_key").slice(first, rows),
                        batch.column("doc_id").slice(first, rows),
                        pa.array(np.diff(at).astype(np.int64)),
                        pa.array((total[at[1:]] - total[at[:-1]]).view(np.int64)),
                        pa.array((mixed[at[1:]] - mixed[at[:-1]]).view(np.int64)),
                        *(pa.array(np.ascontiguousarray(parity[:, i]).view(np.int64)) for i in range(SKETCH_LONGS)),
                    ],
                    names=["row_key", "doc_id", "n", "k1", "k2", *(f"s{i}" for i in range(SKETCH_LONGS))],
                )

    longs = ", ".join(f"s{i} long" for i in range(SKETCH_LONGS))
    return docs.mapInArrow(run, f"row_key long, doc_id long, n long, k1 long, k2 long, {longs}")


def _wide(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """Of the rows with key ``ids`` the wide sketch (id, w0..)."""
    sent = docs.sparkSession.sparkContext.broadcast(key_filter(ids))
    names = [f"w{i}" for i in range(WIDE_LONGS)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.filter(pa.array(hits(batch.column("h"), sent.value)))
            for first, rows, v, at in _sets(part.column("text"), k):
                wide = _parity(v, at, WIDE_LONGS)
                key = part.column("row_key").slice(first, rows)
                yield pa.RecordBatch.from_arrays([key, *(pa.array(np.ascontiguousarray(wide[:, i]).view(np.int64)) for i in range(WIDE_LONGS))], names=["id", *names])

    rows = docs.select("row_key", "text", F.xxhash64("row_key").alias("h"))
    # Rows of one key are equal in id and text, so any of them will do.
    return rows.mapInArrow(run, "id long, " + ", ".join(f"{n} long" for n in names)).dropDuplicates(["id"])


def _hot_buckets(docs: DataFrame, rows: int, k: int, percent: int) -> np.ndarray:
    """Buckets that hold a large part of a sample of at most about ``HOT_SAMPLE`` documents, sorted.

    They number at most the sample's entries over ``HOT_COUNT``, whatever the corpus. A bucket outside
    is treated like any other, so the sample decides where entries are dealt to, not which there are.
    """
    some = docs.filter(F.pmod(F.xxhash64("row_key"), F.lit(max(1, rows // HOT_SAMPLE))) == 0).select("text").distinct()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, v, at in _sets(batch.column("text"), k):
                yield pa.RecordBatch.from_arrays([pa.array(_entries_of(v, at, percent)[0].view(np.int64))], names=["bucket"])

    hot = some.mapInArrow(run, "bucket long").groupBy("bucket").count().filter(F.col("count") >= HOT_COUNT).select("bucket").toArrow()
    return np.sort(np.concatenate([np.zeros(0, np.int64), *(c.to_numpy() for c in hot.column(0).chunks)]))


def _entries(docs: DataFrame, ids: DataFrame, hot: np.ndarray, k: int, percent: int) -> DataFrame:
    """Bucket entries (bucket, id, grp, part) of the class representatives ``ids``; part is over 0 in hot buckets.

    A row that the filter lets through too brings the entries of its representative's equal or of one
    more document, which is no harm: what it shares is then tested like any other pair.
    """
    sent = docs.sparkSession.sparkContext.broadcast((key_filter(ids), hot))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, hot_ = sent.value
        for batch in batches:
            part = batch.filter(pa.array(hits(batch.column("h"), wanted)))
            for first, rows, v, at in _sets(part.column("text"), k):
                key, row, grp = _entries_of(v, at, percent)
                owner = part.column("row_key").slice(first, rows).to_numpy()[row]
                key = key.view(np.int64)
                spread = np.zeros(len(key), dtype=np.int32)
                if len(hot_):
                    found = hot_[np.minimum(np.searchsorted(hot_, key), len(hot_) - 1)] == key
                    spread[found] = 1 + (mix64(owner[found].view(np.uint64)) % np.uint64(HOT_PARTS)).astype(np.int32)
                grp = grp.astype(np.int32)
                for lo in range(0, len(key), 1 << 16):
                    cut = slice(lo, lo + (1 << 16))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[cut]), pa.array(owner[cut]), pa.array(grp[cut]), pa.array(spread[cut])], names=["bucket", "id", "grp", "part"]
                    )

    rows = docs.select("row_key", "text", F.xxhash64("row_key").alias("h"))
    return rows.mapInArrow(run, "bucket long, id long, grp int, part int")


def _verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """Those pairs (a, b) of row keys whose shingle sets are similar enough, by the sets themselves."""
    pairs = scratch.save(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sent = docs.sparkSession.sparkContext.broadcast(key_filter(ids))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.filter(pa.array(hits(batch.column("h"), sent.value)))
            for first, n, v, at in _sets(part.column("text"), k):
                yield pa.RecordBatch.from_arrays([part.column("row_key").slice(first, n), _long_list(v, at)], names=["id", "set"])

    sets = docs.select("row_key", "text", F.xxhash64("row_key").alias("h")).mapInArrow(run, "id long, set array<long>")
    # Rows of one key are equal in id and text, so any of them will do.
    sets = scratch.save(sets.join(ids, "id", "left_semi").dropDuplicates(["id"]), "sets")
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    common = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    union = F.size("set_a") + F.size("set_b") - common
    return both.filter(100 * common >= percent * union).select("a", "b")


def _distance(x: str = "s", y: str = "t", longs: int = SKETCH_LONGS) -> Column:
    """Hamming distance of the sketches s0.. and t0.. of a pair."""
    return reduce(lambda a, b: a + b, [F.bit_count(F.col(f"{x}{i}").bitwiseXOR(F.col(f"{y}{i}"))) for i in range(longs)])


def _ordered(pairs: DataFrame) -> DataFrame:
    """Pairs (id, y) as distinct (a, b) with a < b."""
    return pairs.select(F.least("id", "y").alias("a"), F.greatest("id", "y").alias("b")).distinct()


def _may_link(percent: int) -> Column:
    """Size and Hamming tests between columns n, s0.. and m, t0.. of a pair."""
    sizes = (100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    return sizes & _near(_distance(), percent)


def _near(distance: Column, percent: int) -> Column:
    """Whether a distance of sketches is none that linked sets of sizes n and m can't have."""
    return distance * (100 + percent) <= (F.col("n") + F.col("m")) * (100 - percent)


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (id, y) that pass the size and Hamming tests, with their distance."""
    sketch = [f"s{i}" for i in range(SKETCH_LONGS)]
    x = classes.select("id", "n", *sketch)
    y = x.withColumnsRenamed({"id": "y", "n": "m"} | {f"s{i}": f"t{i}" for i in range(SKETCH_LONGS)})
    return pairs.distinct().join(x, "id").join(y, "y").filter(_may_link(percent)).select("id", "y", _distance().alias("distance"))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those pairs (id, y) that lie in different components."""
    left = pairs.join(roots.withColumnRenamed("root", "x_root"), "id", "left")
    left = left.join(roots.select(F.col("id").alias("y"), F.col("root").alias("y_root")), "y", "left")
    return left.filter(F.coalesce("x_root", "id") != F.coalesce("y_root", "y")).select("id", "y")


def _mixed(members: DataFrame, roots: DataFrame, classes: DataFrame, done: int) -> DataFrame:
    """The members of buckets of more than ``done`` that hold several components, with their class's columns.

    ``home`` is the component of most members of the bucket, ``parts`` the tasks over which they are dealt.
    """
    placed = members.select("bucket", "id").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    of = placed.groupBy("bucket", "root").agg(F.count("*").alias("here")).groupBy("bucket")
    of = of.agg(F.max_by("root", F.struct("here", "root")).alias("home"), F.count("*").alias("several"), F.sum("here").alias("size"))
    of = of.filter((F.col("several") > 1) & (F.col("size") > done))
    of = of.select("bucket", "home", F.ceil(F.col("size") / CHUNK).cast("int").alias("parts"))
    return placed.join(of, "bucket").join(classes.select("id", "n", *(f"s{i}" for i in range(SKETCH_LONGS))), "id")


def _across(members: DataFrame, pivots: int | None, percent: int) -> DataFrame:
    """Pairs (a, b) of members of a bucket and of different components that pass the size and Hamming tests.

    With ``pivots``, all members are held against that many of the bucket; else members outside the
    bucket's home against all, and by the wide sketch too. What fails the tests never leaves the join.
    """
    y = members.drop("home")
    if pivots:
        y = y.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy("id"))).filter(F.col("place") <= pivots).drop("place")
    y = y.withColumnsRenamed({"id": "y", "n": "m", "root": "y_root"} | {f"s{i}": f"t{i}" for i in range(SKETCH_LONGS)})
    y = y.withColumnsRenamed({f"w{i}": f"v{i}" for i in range(WIDE_LONGS)})
    x = members if pivots else members.filter("root <> home")
    # The members of a large bucket meet the other side in parts.
    x = x.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    y = y.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    once = F.lit(True) if pivots else (F.col("y_root") == F.col("home")) | (F.col("id") < F.col("y"))
    may_link = _may_link(percent) if pivots else _may_link(percent) & _near(_distance("w", "v", WIDE_LONGS), percent)
    return _ordered(x.join(y, ["bucket", "part"]).filter((F.col("root") != F.col("y_root")) & once & may_link))


def _edges(roots: DataFrame) -> DataFrame:
    return roots.select(F.col("id").alias("a"), F.col("root").alias("b"))


def _candidates(entries: DataFrame, scratch: Scratch) -> DataFrame:
    """Bucket members (bucket, id) among which each linked pair meets at least once."""
    # A bucket's part is one partition, so that it can be counted and joined after one shuffle.
    dealt = entries.repartition("bucket", "part")
    # The largest id and group keep these columns in the count's shuffle, so that it is the join's as well.
    sizes = dealt.groupBy("bucket", "part").agg(F.count("*").alias("size"), F.max("id").alias("i"), F.max("grp").alias("g"))
    sizes = sizes.filter("(size > 1 or part > 0) and i is not null and g is not null")
    sizes = sizes.select("bucket", "part", F.when(F.col("part") > 0, F.lit(1 << 50)).otherwise(F.col("size")).alias("size"))
    shared = dealt.join(sizes.hint("shuffle_hash"), ["bucket", "part"]).select("bucket", "id", "grp", "size")
    shared = scratch.save(shared, "shared")
    frequent_first = Window.partitionBy("id", "grp").orderBy(F.desc("size"), "bucket")
    kept = shared.distinct().withColumn("place", F.row_number().over(frequent_first))
    kept = kept.filter(F.col("place") >= F.shiftright("grp", 2)).select("bucket", "id")
    kept = scratch.save(kept, "members")
    scratch.drop("shared")
    return kept


def _linked(docs: DataFrame, classes: DataFrame, members: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """The component (id, root) of each class that links with another."""
    ends = members.groupBy("bucket").agg(F.min("id").alias("p0"), F.max("id").alias("p1"), F.count("*").alias("size")).filter("size > 1")
    star = members.join(ends, "bucket").select("id", F.explode(F.array("p0", "p1")).alias("y")).filter("id <> y")
    star = scratch.save(_likely(star, classes, percent), "star")
    order = Window.partitionBy("id").orderBy("distance", "y")
    first = _ordered(star.withColumn("place", F.row_number().over(order)).filter("place = 1"))
    first = scratch.save(first, "first")
    roots = components(_verified(docs, first, k, percent, scratch), scratch)
    again = _ordered(_apart(star, roots)).join(first, ["a", "b"], "left_anti")
    roots = components(_edges(roots).unionByName(_verified(docs, again, k, percent, scratch)), scratch)
    tested = scratch.save(_ordered(star), "tested")
    scratch.drop("star", "first")
    for pivots in (MORE_PIVOTS, None):
        # Up to three members have been compared with each other, later up to one more than the pivots.
        members = scratch.save(_mixed(members, roots, classes, 3 if pivots else MORE_PIVOTS + 1), "mixed")
        if members.isEmpty():
            break
        if not pivots:
            # The 256 bits let all pairs of large sets pass, so that the whole of a bucket is tested by a wider sketch.
            ids = members.select("id").distinct()
            members = members.join(scratch.save(_wide(docs, ids, k).join(ids, "id", "left_semi"), "wide"), "id")
        pairs = _across(members, pivots, percent).join(tested, ["a", "b"], "left_anti")
        roots = components(_edges(roots).unionByName(_verified(docs, pairs, k, percent, scratch)), scratch)
        tested = scratch.save(tested.unionByName(pairs), "tested") if pivots else tested
    scratch.drop("members", "mixed", "wide", "pairs", "sets", "tested")
    return roots


def groups(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """As `near_duplicates`, a row per input row, with two more columns.

    ``row_key`` is the xxhash64 of doc_id and text, which tells rows apart; ``group_key`` names the
    row's group also where none of its rows has a doc_id (null for texts without words).
    """
    small_batches(documents.sparkSession)
    scratch = Scratch(documents.sparkSession, "parity")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("row_key", F.xxhash64("doc_id", "text"))
    base = scratch.save(_sketched(docs, k), "sketches")
    sketch = [f"s{i}" for i in range(SKETCH_LONGS)]
    # A class of equal sets is represented by its smallest row key; equal sets have equal sketches.
    classes = base.filter("n > 0").groupBy("n", "k1", "k2")
    classes = classes.agg(F.min("row_key").alias("id"), F.min("doc_id").alias("least"), *(F.min(c).alias(c) for c in sketch))
    classes = scratch.save(classes, "classes")
    hot = _hot_buckets(docs, classes.count(), k, percent)
    members = _candidates(_entries(docs, classes.select("id"), hot, k, percent), scratch)
    roots = _linked(docs, classes, members, k, percent, scratch)
    placed = classes.select("n", "k1", "k2", "id", "least").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = placed.join(least, "root").select("n", "k1", "k2", F.col("root").alias("group_key"), "component_id")
    out = base.select("row_key", "doc_id", "n", "k1", "k2").join(placed, ["n", "k1", "k2"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = materialize(out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "row_key", "group_key"), "parity-groups")
    scratch.drop(*list(scratch.paths))
    return out


def near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Groups of ``documents`` (doc_id, text) linked at a Jaccard similarity of ``percent`` or more.

    Words are what stands between spaces and 0x09 to 0x0D, with A-Z lower-cased; the set is that of
    ``k``-word shingles, of shorter texts the whole sequence. Returns a row per input row: doc_id,
    n_shingles, component_id (the smallest doc_id reachable by links, itself included). Rows are linked
    by their texts, each row by its own, also where ids repeat; sharing an id is no link. Null texts and
    texts without words link with nothing and have their own doc_id as component. A row with a null
    doc_id takes part like others; the component is null where no row of it has an id. An empty table
    gives no rows. Other columns are ignored. There is no cap on partners or candidates.
    """
    return groups(documents, k, percent).select("doc_id", "n_shingles", "component_id")


def keep_one(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``documents`` with one row of each group: that of the smallest doc_id (rows without one come last).

    Of rows alike in doc_id and text, the one with the smallest hash of its columns stays. Null texts and
    texts without words form no groups, so all such rows stay. Columns and values are kept as they are.
    """
    found = groups(documents, k, percent).filter("group_key is not null")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key"))["row_key"]
    several = found.groupBy("group_key").agg(best.alias("stays"), F.count("*").alias("rows")).filter("rows > 1").select("group_key", "stays")
    touched = materialize(found.join(several, "group_key").select(F.col("row_key").alias("id"), "stays").distinct(), "parity-touched")
    names = documents.columns
    taken = {c.lower() for c in names}
    key, hit = ("".join(("_",) * n) + "row_key" for n in (1, 2))
    while key in taken or hit in taken:
        key, hit = f"_{key}", f"_{hit}"
    sent = documents.sparkSession.sparkContext.broadcast(key_filter(touched.select("id")))
    keyed = documents.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))).withColumn(hit, F.xxhash64(key))

    def passing(want: bool):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(hits(batch.column(hit), sent.value) == want))

        return keyed.mapInArrow(run, keyed.schema)

    rows = passing(True).join(touched.withColumnRenamed("id", key), key, "left")
    plain = [f.name for f in documents.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    alike = Window.partitionBy(key).orderBy(F.xxhash64(*plain))
    alone = rows.filter("stays is null").select(*names)
    stays = rows.filter(F.col("stays") == F.col(key)).withColumn(hit, F.row_number().over(alike)).filter(F.col(hit) == 1).select(*names)
    return passing(False).select(*names).unionByName(alone).unionByName(stays)
