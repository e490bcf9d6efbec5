"""Byte-level BPE ids of whole texts, with the cuts between spaces encoded once.

The tokenizer splits a text into pieces before merging bytes, and a piece never crosses a space that
stands before a non-space character. Texts are cut there, each distinct cut is encoded once by the
tokenizers library and kept in a dictionary of bounded size, and a text's ids are the cuts' ids in order.

Most cuts are made of letters or digits, perhaps with marks behind them and line ends between such words. Their pieces are known without the tokenizer's own splitting, so these pieces go to the library's
model alone, many in one text; every other cut is encoded whole.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa

#: Cuts kept in a generation of a worker's memory; it holds two generations, the younger in use.
CACHE_CUTS = 500_000
#: Longer cuts are encoded but not kept.
CACHE_CHARS = 32
#: Texts whose cuts are looked up together, and pieces encoded together.
GROUP_TEXTS = 512
GROUP_PIECES = 4096

_CUT = re.compile(r" (?=\S)")
#: Letters of scripts that Unicode has held since long, so that every library agrees that they are letters.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ʯΑ-ΡΣ-ωЀ-ҁא-תء-غف-يぁ-ゖァ-ヺ一-鿋가-힣"
#: Letters or digits, then marks without an apostrophe (which can begin a contraction).
_WORD = re.compile(rf"([{_LETTERS}]+|[0-9]+)([!-&(-/:-@\[-`{{-~]*)")
_PLAIN = re.compile(rf"{_WORD.pattern}(?:\n\n?{_WORD.pattern})*")
_ALPHA = re.compile(rf"[{_LETTERS}]+")
_LINES = re.compile(r"\n+")


class Encoder:
    """Encodes texts as little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, cache_cuts: int = CACHE_CUTS):
        self.cache_cuts = cache_cuts
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        # The same model with pieces told apart by spaces; a piece's own space is the model's letter for it.
        self.pieces = Tokenizer.from_file(path)
        self.pieces.encode_special_tokens = True
        self.pieces.model._resize_cache(0)  # each piece comes once, so a cache would only cost time
        self.pieces.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letter: dict[int, str] = {}
        for c in map(chr, (*range(0x80), *range(0x80, 0x800), *range(0x800, 0xD800, 64))):
            self.letter.update(zip(c.encode(), split.pre_tokenize_str(c)[0][0]))
        self.space, self.line = self.letter[32], self.letter[10]
        (self.line_id,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.begins[[i for t, i in vocabulary.items() if t.startswith(self.space)]] = True
        self.newline = np.array([self.line_id], dtype="<u4").tobytes()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        #: Pieces without a space in front: words after a line end, and marks.
        self.bare: dict[str, bytes] = {"": b""}

    def _letters(self, piece: str) -> str:
        """A piece in the model's letters, one for each byte."""
        return piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letter)

    def _pieces(self, pieces: list[str], spaced: bool) -> list[bytes]:
        """Ids of pieces, many encoded as one text.

        Pieces with a space in front begin where an id begins with the space. Others are told apart by a
        line end, an id of its own, between them.
        """
        out = []
        between = f" {self.space}" if spaced else f" {self.line} "
        for i in range(0, len(pieces), GROUP_PIECES):
            some = pieces[i : i + GROUP_PIECES]
            whole = between.join(map(self._letters, some))
            whole = self.space + whole if spaced else f"{self.line} {whole}"
            ids = np.array(self.pieces.encode_batch_fast([whole], add_special_tokens=False)[0].ids, dtype="<u4")
            starts = np.flatnonzero(self.begins[ids] if spaced else ids == self.line_id)
            if len(starts) != len(some):
                raise ValueError("pieces and their ids do not agree")
            ends = (4 * np.append(starts[1:], len(ids))).tolist()
            starts = (4 * (starts if spaced else starts + 1)).tolist()
            raw = ids.tobytes()
            out += [raw[x:y] for x, y in zip(starts, ends)]
        return out

    def _fresh(self, cuts: Iterable[str]) -> None:
        """Encode cuts that aren't kept yet."""
        young, bare, match, word, alpha = self.young, self.bare, _PLAIN.fullmatch, _WORD.findall, _ALPHA.fullmatch
        alone, composed, others = [], [], []
        spaced, unspaced = set(), set()
        for c in cuts:
            if c.isalpha() and (c.isascii() or alpha(c)):
                alone.append(c)
            elif match(c):
                parts = word(c)
                composed.append((c, parts))
                (head, marks), *rest = parts
                if head not in young:
                    spaced.add(head)
                if marks not in bare:
                    unspaced.add(marks)
                for pair in rest:
                    unspaced.update(pair)
            else:
                others.append(c)
        alone += spaced.difference(alone)
        young.update(zip(alone, self._pieces(alone, True)))
        some = [p for p in unspaced if p not in bare]
        bare.update(zip(some, self._pieces(some, False)))
        for c, ((head, marks), *rest) in composed:
            ids = young[head] + bare[marks]
            if rest:
                for (w, m), ends in zip(rest, _LINES.findall(c)):
                    ids += self.newline * len(ends) + bare[w] + bare[m]
            young[c] = ids
        for i in range(0, len(others), GROUP_PIECES):
            some = others[i : i + GROUP_PIECES]
            for c, e in zip(some, self.tokenizer.encode_batch_fast([" " + c for c in some], add_special_tokens=False)):
                young[c] = np.array(e.ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Nothing here makes cycles, so the collector needn't walk the dictionaries."""
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for lo in range(0, len(texts), GROUP_TEXTS):
            group = texts[lo : lo + GROUP_TEXTS]
            parts = [t.split(" ") for t in group]
            # All cuts of a text but the first lose the space in front of them.
            heads = [p.pop(0) for p in parts]
            distinct = set().union(*parts)
            # A cut that begins with white space was no place to cut; kept cuts never do.
            fresh = distinct.difference(self.young)
            wrong = {c for c in fresh if not c or c[0].isspace()}
            if wrong:
                for i, p in enumerate(parts):
                    if not wrong.isdisjoint(p):
                        parts[i] = _CUT.split(group[i])
                        heads[i] = parts[i].pop(0)
                fresh = set().union(*parts).difference(self.young)
            young, old = self.young, self.old
            young.update([(c, old[c]) for c in fresh if c in old])
            fresh = fresh.difference(young)
            self._fresh(fresh)
            get = young.__getitem__
            first = self.tokenizer.encode_batch_fast(heads, add_special_tokens=False)
            for p, head in zip(parts, first):
                out.append(np.array(head.ids, dtype="<u4").tobytes() + b"".join(map(get, p)))
            for c in fresh:
                if len(c) > CACHE_CHARS:
                    del young[c]
            if len(young) > self.cache_cuts:
                self.old, self.young = young, {}
            if len(self.bare) > self.cache_cuts // 4:
                self.bare = {"": b""}
        return out


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, cache_cuts: int = CACHE_CUTS) -> Encoder:
    """The encoder of a vocabulary file, made once in each worker process."""
    key = path, cache_cuts
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(path, cache_cuts)
    return _ENCODERS[key]


def release() -> None:
    """Forget the encoders of this worker process. Other operators' tasks call it, since Spark's workers
    live on between stages and would hold an encoder's memory all that time."""
    _ENCODERS.clear()
    give_back()


def give_back() -> None:
    """Return to the system what earlier tasks of this worker process have freed and its allocators still hold."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
