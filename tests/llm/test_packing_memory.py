"""What a packing task remembers and gives out at a time doesn't change its result."""

from apchecks.llm import packing, queries, tokens

MEDIUM = "/root/testdata/sf0.01"


def test_small_cache_same_pieces(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").coalesce(1)
    rows = lambda **k: sorted(map(tuple, packing.pack(docs, queries.tokenizer_path(), 1, **k).collect()), key=str)
    assert rows(cache_cuts=50) == rows()


def test_cache_is_bounded():
    enc = tokens.Encoder(queries.tokenizer_path(), cache_cuts=50)
    for i in range(40):
        enc.encode([" ".join(f"w{i} x{j}y" for j in range(i, i + 20))])
    assert len(enc.young) + len(enc.old) <= 2 * (50 + 4 * 20)


def test_batches_are_small():
    assert packing.BATCH_ROWS * 2048 * 4 <= 2 << 20
