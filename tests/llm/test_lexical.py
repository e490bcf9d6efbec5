"""Ranked lexical search against plain scores."""

import math
import random
import re
from collections import Counter

import pytest

from apchecks.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, score long, terms string"


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(docs, items, k):
    counted = [(d, Counter(terms_of(t))) for d, t in docs]
    n_docs, total = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms_of(text))
    out = set()
    for item, terms in asked.items():
        found = []
        for d, c in counted:
            m = 10 + (90 * sum(c.values()) * n_docs) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out |= {(item, i + 1, f[3], -f[0]) for i, f in enumerate(sorted(found)[:k])}
    return out


def rows(spark, docs):
    return spark.createDataFrame([(d, t, 7, "x") for d, t in docs], DOCS).repartition(3)


def got(found):
    return {(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found.collect()}


@pytest.mark.parametrize("bucket,focus,block,share", [(2048, 12, 1 << 18, 0.05), (7, 2, 20, 0.2), (3, 1, 1, 0.9), (16, 0, 50, 0.0)])
def test_against_plain_scores(spark, bucket, focus, block, share):
    rng = random.Random(bucket)
    words = [f"w{i}" for i in range(60)] + ["Éte", "中文", "STRASSE"]
    text = lambda n: rng.choice([" ", "-", ", "]).join(rng.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=n))
    docs = [(i, text(rng.choice([1, 3, 10, 40, 300]))) for i in range(150)]
    docs += [(i, docs[i % 20][1]) for i in range(150, 190)] + [(200, None), (201, ""), (202, " -- "), (None, docs[3][1]), (3, docs[3][1])]
    items = [(i, text(rng.choice([1, 5, 30]))) for i in range(25)] + [(3, "w1 w59"), (30, None), (31, "!!"), (32, "nowhere"), (None, "w2 éte")]
    rng.shuffle(docs)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert got(lexical.search(rows(spark, docs), asked, 10, block, bucket, focus, share)) == plain(docs, items, 10)


def test_edges(spark):
    items = spark.createDataFrame([(1, "a b"), (1, "a b")], "item_id long, text string")
    assert lexical.search(rows(spark, []), items).count() == 0
    assert lexical.search(rows(spark, [(1, "a"), (2, None)]), items.limit(0)).count() == 0
    long = "A " * 200_000 + "b"
    docs = [(1, long), (2, "b"), (3, "zz"), (4, "b"), (5, "b")]
    assert got(lexical.search(rows(spark, docs), items, 3)) == plain(docs, [(1, "a b")], 3)
