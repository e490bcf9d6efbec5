"""The pipeline's stages on nulls in every column, empty and long texts, repeats, clashing names and no rows."""

import pytest

import corpus_pipeline as c
from apchecks.llm.common import materialize

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, h long, row struct<a:int>, row_key int"


@pytest.fixture(scope="module")
def rows():
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    texts = ["a clean text on rivers and boats", None, "", " \n\t", long, "same text in two rows", "same text in two rows", "short"]
    out = [(i, t, "en", f"s{i % 2}", len(t or ""), 0.5, i, (i,), i) for i, t in enumerate(texts)]
    return [*out, (None, "no id at all but words enough here", None, None, None, None, None, None, None), (None,) * 9, (None,) * 9]


def test_stages_on_odd_rows(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    counts = {}
    for name, stage in c.STAGES:
        after = stage(spark, docs, SMALL)
        if name != "packing":
            assert after.columns == docs.columns
            after = materialize(after, f"edge-{name}")
        counts[name] = after.collect()
        docs = after
    assert sorted(map(str, counts["toxicity"])) == sorted(map(str, map(tuple_row, rows, [spark] * len(rows))))
    kept = counts["near_duplicates"]
    assert len(kept) == len(rows) - 1  # one of the two equal texts goes; texts without words all stay
    assert sum(r["text"] == "same text in two rows" for r in kept) == 1 and min(r["doc_id"] for r in kept if r["text"] == "same text in two rows") == 5
    wordless = lambda rows: sorted(str(r["doc_id"]) for r in rows if not (r["text"] or "").split())
    assert wordless(counts["source_mix"]) == wordless(kept) and len(wordless(kept)) == 5  # each comes once
    pieces = counts["packing"]
    tokens = {}
    for r in pieces:
        assert 0 < r["length"] <= 2048
        tokens.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in tokens.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length


def tuple_row(row, spark):
    from pyspark.sql import Row

    names = [f.split(" ")[0] for f in SCHEMA.split(", ")]
    return Row(**dict(zip(names, [*row[:7], None if row[7] is None else Row(a=row[7][0]), row[8]])))


def test_stages_on_no_rows(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in c.STAGES:
        after = stage(spark, docs, SMALL)
        assert after.count() == 0
        docs = after if name != "packing" else docs
