"""Training-corpus pipeline: toxicity filter, near-duplicate removal, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. A stage's result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apchecks.llm import mixing, packing, parity_join, toxicity
from apchecks.llm.common import Scratch
from apchecks.llm.queries import table, tokenizer_path

#: Cuts that a packing worker remembers: fewer than op4's, since the executor's heap is grown by the stages before.
CACHE_CUTS = 60_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text's toxicity score is below 0.3, with all their columns.

    Null and empty texts have no clauses, score lowest and stay; ids, ties and repeated rows play no part,
    each row is judged by its whole text; an empty table gives no rows.
    """
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group on five-word shingles at 0.8, that of the smallest id; decided row by row.

    Rows without a doc_id take part and come last in their group; null texts and texts without words link
    with nothing and all stay; of repeated rows one stays; an empty table gives no rows.
    """
    return parity_join.keep_one(docs, k=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated and cut as the mix takes them; n_chars follows the text.

    Null and wordless texts have size 0 and come once for each of their rows; rows without a source form the last source; rows
    alike in id, source and size are told apart by a hash of the whole row, so that ties and repeats are
    settled alike in every run; a text is cut once per source at most; an empty table gives no rows.
    """
    mixed = mixing.mix(docs)
    if "n_chars" in mixed.columns:
        mixed = mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return mixed


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 ids, a row for each.

    A null or empty text is its end id alone; rows without an id and repeated rows are packed like others;
    texts longer than a sequence are cut; an empty table gives no rows.
    """
    return packing.pack(docs, tokenizer_path(), end_id=1, cache_cuts=CACHE_CUTS).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

#: No SQL can express the learnt filter; the pipeline is tested stage by stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``; a stage's table is removed when the next one's is written."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.save(docs, name)
            scratch.drop(*(before for before, _ in STAGES[:i]))
    return docs
