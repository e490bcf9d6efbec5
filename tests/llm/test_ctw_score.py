"""The context-tree model's score against a plain version that walks every bit of every context."""

import collections
import math
import zlib

import pytest

from apchecks.llm import ctw

from .test_brute_force import split

DEPTH = 5


def sequence(text):
    return b"\0" * DEPTH + " ".join(split(text)).encode() + b"\xff"


def decisions(data):
    """(contexts of depth 0 to DEPTH, bits decided so far, next bit) of each bit of each byte."""
    for at in range(DEPTH, len(data)):
        bits = f"{data[at]:08b}"
        for i in range(8):
            yield [data[at - d : at] for d in range(DEPTH + 1)], bits[:i], int(bits[i])


class PlainTree:
    def __init__(self, texts):
        self.count = collections.defaultdict(lambda: [0, 0])
        self.below = collections.defaultdict(set)
        for text in texts:
            for contexts, done, bit in decisions(sequence(text)):
                for d, c in enumerate(contexts):
                    self.count[c, done][bit] += 1
                    if d < DEPTH:
                        self.below[c, done].add(contexts[d + 1])
        self.weighted = {}
        for c, done in sorted(self.count, key=lambda node: -len(node[0])):
            own = self.estimate(c, done)
            if len(c) < DEPTH:
                split_ = sum(self.weighted[x, done] for x in self.below[c, done])
                top = max(own, split_)
                own = top + math.log((math.exp(own - top) + math.exp(split_ - top)) / 2)
            self.weighted[c, done] = own

    def estimate(self, c, done):
        a, b = self.count[c, done]
        g = math.lgamma
        return g(a + 0.5) + g(b + 0.5) - 2 * g(0.5) - g(a + b + 1)

    def log10(self, text):
        total = 0.0
        for contexts, done, bit in decisions(sequence(text)):
            p, left = 0.0, 1.0
            for d, c in enumerate(contexts):
                known = (c, done) in self.count
                n = self.count[c, done] if known else [0, 0]
                deeper = d < DEPTH and (contexts[d + 1], done) in self.count
                stop = 0.5 * math.exp(self.estimate(c, done) - self.weighted[c, done]) if deeper else 1.0
                p += left * stop * (n[bit] + 0.5) / (sum(n) + 1)
                left *= 1 - stop
            total += math.log10(p)
        return total


TEXTS = ["the cat sat on the mat", "The dog sat on the log", "", "a cat and a dog", "é ü 中", None, "the the the the cat", "zq xj", "on the mat the cat sat", "dog log", "the end of it all", "and the cat"]


def test_score_is_the_tree_s_in_both_look_ups(spark):
    rows = list(enumerate(TEXTS * 2))
    tree = PlainTree([t for i, t in rows if zlib.crc32(str(i).encode()) % 10])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scores = [{r["doc_id"]: r["score"] for r in ctw.score(docs, max_broadcast=most).collect()} for most in (1 << 19, 8)]
    for i, text in rows:
        assert scores[0][i] == pytest.approx(tree.log10(text), rel=1e-7)  # the operator's log-gamma is a series
        assert scores[1][i] == pytest.approx(scores[0][i], rel=1e-12)
