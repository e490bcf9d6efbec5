import numpy as np

from apchecks.llm import parity_join as pj


def test_unrelated_large_sets_stay_in_the_join(spark):
    """Of a bucket's large sets only the pairs leave the last join that can link, not all that 256 bits can't tell apart."""
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 62, 2000, dtype=np.uint64)) for _ in range(30)]
    sets[29] = np.unique(np.concatenate((sets[28][:1950], rng.integers(0, 1 << 62, 50, dtype=np.uint64))))
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    values = np.concatenate(sets)
    narrow = pj._parity(values, at).view(np.int64)
    wide = pj._parity(values, at, 24).view(np.int64)
    rows = [(1, i, i, 0, 1, len(s), *map(int, narrow[i]), *map(int, wide[i])) for i, s in enumerate(sets)]
    names = ["bucket", "id", "root", "home", "parts", "n", *(f"s{j}" for j in range(4)), *(f"w{j}" for j in range(24))]
    members = spark.createDataFrame(rows, names)
    found = {tuple(r) for r in pj._across(members, None, 80).collect()}
    assert found == {(28, 29)}
