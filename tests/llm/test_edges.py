"""Nulls, empty and very long texts, repeated rows, ties, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

from apchecks.llm import anisotropic, audio, ctw, licences, mixing, packing, parity_join, preference, token_store, toxicity
from apchecks.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, score double, size long, component_id long"
LONG = "word and another " * 40_000


@pytest.fixture(scope="module")
def docs(spark):
    texts = [
        (1, "The quick brown fox jumps over the lazy dog"), (2, "The quick brown fox jumps over the lazy dog"), (3, None), (4, ""), (None, "no id here at all"),
        (5, LONG), (6, "é ß 中文 \x00 x"), (7, "under the MIT license"), (8, "one"), (8, "one"), (9, " \n\t "), (10, "You are a stupid idiot."),
    ]
    rows = [(i, t, "en", None if i == 6 else f"s{(i or 0) % 2}", None if t is None else len(t), "r", 0.5, 7, 1) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 0), (10, 0, 1), (None, 1, 1), (2, 1, None), (5, 1, 0)], "doc_id long, quality int, toxic int")


def runs(labels, shared):
    path = tokenizer_path()
    return {
        "ctw": lambda d: ctw.score(d),
        "toxicity": lambda d: toxicity.score(d, labels),
        "clean": lambda d: toxicity.keep_clean(d, labels),
        "store": lambda d: token_store.read_shards(token_store.write_shards(d, path, 0)),
        "join": lambda d: parity_join.near_duplicates(d, 3, 90),
        "mix": lambda d: mixing.mix_plan(d),
        "licences": lambda d: licences.scan(d),
        "audio": lambda d: audio.digests(audio.store(d)),
    }


NAMES = ["ctw", "toxicity", "clean", "store", "join", "mix", "licences", "audio"]


@pytest.mark.parametrize("name", NAMES)
def test_every_row_comes_back(spark, docs, labels, name):
    out = runs(labels, None)[name](docs).collect()
    assert len(out) == (11 if name == "clean" else 12)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, docs, labels, name):
    assert runs(labels, None)[name](docs.limit(0)).count() == 0


def test_packing_and_mix_edges(spark, docs):
    assert packing.pack(docs.limit(0), tokenizer_path(), 1).count() == 0
    pieces = packing.pack(docs, tokenizer_path(), 1)
    assert pieces.select("doc_id").distinct().count() == 11
    assert mixing.mix(docs.limit(0)).count() == 0
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.select(F.sum(mixing.word_count("text"))).first()[0] == pytest.approx(mixing.mix_plan(docs.dropDuplicates(["doc_id", "text"])).select(F.sum("taken")).first()[0], abs=2)


def test_join_groups_copies_only(docs):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in parity_join.near_duplicates(docs, 3, 90).collect()), key=str)
    assert (2, 7, 1) in got and (3, 0, 3) in got and (4, 0, 4) in got and (None, 3, None) in got and got.count((8, 1, 8)) == 2


def test_conversation_edges(spark):
    rows = [(2, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, None, None), (3, None, "assistant", "z"), (None, 0, "user", "lost"), (9, 0, "user", "alone")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("chosen", F.lit("x"))
    out = {r["conv_id"]: r for r in preference.format_preferences(preference.reply_pairs(preference.conversations_of(turns))).collect()}
    assert set(out) == {2, 3, 9} and out[2]["prefix_turns"] == 1 and out[9]["rejected_text"] == "" and out[9]["chosen_text"] == "<|user|>\nalone<|end|>\n"
    assert preference.format_preferences(preference.reply_pairs(preference.conversations_of(turns.limit(0)))).count() == 0


def test_vector_edges(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, None]), (6, [2.0, 0.0]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (8, [])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in anisotropic.nearest(e).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 0.0), (0, 2, 6, 1.0)]
    assert anisotropic.nearest(e.limit(0)).count() == 0
