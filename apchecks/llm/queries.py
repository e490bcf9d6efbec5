"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The vocabulary of the token queries; a parameter of the operators.
VOCABULARY = "byte_bpe_50k.json"


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ctw_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ctw

    return ctw.score(table(spark, sf_dir, "documents"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_store

    manifest = token_store.write_shards(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=0)
    return token_store.read_shards(manifest).select(
        "doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ctw_score": op1_ctw_score,
    "op3_token_store": op3_token_store,
    "op4_packing": op4_packing,
}

ORACLES: dict[str, str] = {}


def op5_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import parity_join

    return parity_join.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=90)


def op6_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import preference as p

    pairs = p.reply_pairs(p.conversations_of(table(spark, sf_dir, "conversations")))
    return p.format_preferences(pairs).select(
        "conv_id", "prefix_turns", "prompt", "chosen_text", "rejected_text",
        p.spans_text("chosen_spans").alias("chosen_mask"), p.spans_text("rejected_spans").alias("rejected_mask"),
    )


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def _oracles() -> dict[str, str]:
    from . import preference

    return {"op6_preference_format": preference.ORACLE}


QUERIES |= {"op5_parity_join": op5_parity_join, "op6_preference_format": op6_preference_format, "op7_source_mix": op7_source_mix}
ORACLES |= _oracles()


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import licences

    return licences.scan(table(spark, sf_dir, "documents")).drop("spans")


def op9_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import audio

    return audio.digests(audio.store(table(spark, sf_dir, "documents")))


def op10_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import anisotropic

    return anisotropic.nearest(table(spark, sf_dir, "embeddings"))


QUERIES |= {
    "op2_toxicity": op2_toxicity,
    "op8_licence_scan": op8_licence_scan,
    "op9_audio_features": op9_audio_features,
    "op10_anisotropic_search": op10_anisotropic_search,
}


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lexical

    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _search_oracles() -> dict[str, str]:
    from . import lexical

    return {"op13_lexical_search": lexical.ORACLE}


QUERIES |= {"op13_lexical_search": op13_lexical_search}
ORACLES |= _search_oracles()


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import repair

    fixed = repair.repair(repair.damage(table(spark, sf_dir, "conversations")))
    return fixed.withColumn("repaired_sha256", F.sha2(repair.rendered("repaired"), 256)).drop("repaired")


def _repair_oracles() -> dict[str, str]:
    from . import repair

    return {"op12_conversation_repair": repair.ORACLE}


QUERIES |= {"op12_conversation_repair": op12_conversation_repair}
ORACLES |= _repair_oracles()


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import personal

    found = personal.find(table(spark, sf_dir, "documents"))
    counts = [personal.counted("base", kind).alias(f"n_{kind}") for kind in personal.KINDS]
    return found.select("doc_id", *counts, F.sha2(personal.spans_text("base"), 256).alias("base_sha256"), personal.spans_text("spans").alias("spans"))


QUERIES |= {"op11_personal_data": op11_personal_data}
