"""A bit filter of row keys, of a bounded size whatever their number.

Before a join that keeps few rows, the filter keeps most other texts out of the shuffle. It lets all
wanted rows through; as it fills up it lets others through too, and the join decides. Its size follows
the number of keys up to ``MOST_WORDS`` (16 MB, useful to some 10^8 keys); beyond that every row goes
to the join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of 64 bits in the smallest and the largest filter.
LEAST_WORDS, MOST_WORDS = 1 << 14, 1 << 21


def key_filter(keys: DataFrame) -> np.ndarray:
    """A bit set over the hashed keys (a long column named ``id``)."""
    wanted, words = keys.count(), LEAST_WORDS
    while words < MOST_WORDS and 64 * words < 8 * wanted:
        words *= 2
    h = F.xxhash64("id")
    word = F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(words - 1))
    bits = keys.groupBy(word.alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(xxhash64(id) & 63 as int))")).alias("bits"))
    out = np.zeros(words, dtype=np.uint64)
    table = bits.toArrow()  # at most MOST_WORDS rows
    if table.num_rows:
        out[table.column("w").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return out


def hits(hashed: pa.Array, wanted: np.ndarray) -> np.ndarray:
    """True for rows, given as the xxhash64 of their keys, that the filter lets through."""
    h = hashed.to_numpy().view(np.uint64)
    word = (h >> np.uint64(6)) & np.uint64(len(wanted) - 1)
    return ((wanted[word.astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1)).astype(bool)
