"""Byte-pair encoding as a lazily determinised finite-state transducer.

The merges of a vocabulary are compiled into a transducer over bytes. Its
hypotheses are ways in which the bytes read so far may end inside a token; a
token may follow another only if no merge across their border would come before
the merges that make them, and under this rule every string has exactly one
segmentation, the one the merges give. The deterministic states, sets of
hypotheses with the tokens not yet certain, are made when they are first
reached. A token is emitted as soon as all hypotheses agree on it, which takes
at most the bytes of the longest token.

Decoding turns ids into bytes and these, piece by piece, into characters with an
incremental UTF-8 state machine.

Defined cases: null and empty text give the empty list; strings that look like
special tokens are ordinary text; a text is read whole, whatever its length.
"""

from __future__ import annotations

import base64
import codecs
import os
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public tokenizer files, and the vocabulary of problem 8.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: How a text is cut before the merges: the published pattern of the vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: States and words that a worker remembers before it starts afresh; a limit of memory only.
STATES, WORDS = 150_000, 300_000
NEVER = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """Encoder of single words, the pieces that the pattern cuts."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError("the vocabulary lacks single bytes")
        self.ranks = ranks
        self.text = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.child: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for t, i in ranks.items():
            n = 0
            for b in t:
                if (m := self.child[n].get(b)) is None:
                    m = len(self.child)
                    self.child[n][b] = m
                    self.child.append({})
                    self.token.append(-1)
                n = m
            self.token[n] = i
        self.spines: dict[int, tuple] = {}
        self.follow: dict[tuple[int, int], bool] = {}
        self._restart()

    def _restart(self) -> None:
        self.number = {((0, -1, ()),): 0}
        self.hypotheses = [((0, -1, ()),)]
        self.next: list[dict[int, tuple[int, tuple]]] = [{}]
        self.last: list[tuple] = [()]

    def halves(self, t: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes t; None for a byte."""
        parts = [bytes([b]) for b in self.text[t]]
        if len(parts) < 2:
            return None
        while len(parts) > 2:
            rank, k = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if rank == NEVER:
                return None
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def spine(self, t: int) -> tuple[tuple, tuple]:
        """(token, rank of the merge that takes it up) along the left and along the right edge of t's merges."""
        if (s := self.spines.get(t)) is None:
            h = self.halves(t)
            if h is None:
                s = (((self.text[t], NEVER),), ((self.text[t], NEVER),))
            else:
                left, right = self.spine(h[0])[0], self.spine(h[1])[1]
                s = (((self.text[t], NEVER), (left[0][0], t), *left[1:]), ((self.text[t], NEVER), (right[0][0], t), *right[1:]))
            self.spines[t] = s
        return s

    def may_follow(self, a: int, b: int) -> bool:
        """No merge across the border of a and b comes before both are made."""
        if (known := self.follow.get((a, b))) is None:
            known = True
            for x, x_taken in self.spine(a)[1]:
                for y, y_taken in self.spine(b)[0]:
                    m = self.ranks.get(x + y, NEVER)
                    # Of merges of one rank the left one comes first.
                    if m < x_taken and m <= y_taken and m != NEVER:
                        known = False
                        break
                if not known:
                    break
            self.follow[a, b] = known
        return known

    def step(self, state: int, byte: int) -> tuple[int, tuple]:
        """The next state and the tokens that have become certain."""
        moved = []
        for node, before, pending in self.hypotheses[state]:
            n = self.child[node].get(byte)
            if n is None:
                continue
            t = self.token[n]
            if t >= 0 and (before < 0 or self.may_follow(before, t)):
                moved.append((0, t, (*pending, t)))
            if self.child[n]:
                moved.append((n, before, pending))
        first = moved[0][2]
        agreed = min(len(p) for _, _, p in moved)
        for _, _, p in moved[1:]:
            k = 0
            while k < agreed and p[k] == first[k]:
                k += 1
            agreed = k
        key = tuple(sorted((n, b, p[agreed:]) for n, b, p in moved))
        if (to := self.number.get(key)) is None:
            to = len(self.hypotheses)
            self.number[key] = to
            self.hypotheses.append(key)
            self.next.append({})
            self.last.append(next(p for n, _, p in key if n == 0))
        out = (to, first[:agreed])
        self.next[state][byte] = out
        return out

    def encode(self, word: bytes) -> tuple[int, ...]:
        if len(self.hypotheses) > STATES:
            self._restart()
            self.follow.clear()
        state, out, steps = 0, [], self.next
        for b in word:
            state, sure = steps[state].get(b) or self.step(state, b)
            if sure:
                out += sure
        out += self.last[state]
        return tuple(out)


class Words(dict):
    """Words with their ids, made when first asked for."""

    def __init__(self, transducer: Transducer):
        self.transducer = transducer

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.transducer.encode(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            if len(self) >= WORDS:
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    def __init__(self, path: str):
        self.words = Words(Transducer(read_ranks(path)))
        self.cut = regex.compile(PATTERN).findall

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.words.__getitem__, self.cut(text)))) if text else []

    def size(self, text: str | None) -> int:
        return sum(map(len, map(self.words.__getitem__, self.cut(text)))) if text else 0

    def decode(self, ids: Iterable[int], chunk: int = 4096) -> str:
        """Characters of a stream of ids; bytes that are no UTF-8 become U+FFFD."""
        machine, out, held = codecs.getincrementaldecoder("utf-8")("replace"), [], bytearray()
        for i in ids:
            held += self.words.transducer.text[i]
            if len(held) >= chunk:
                out.append(machine.decode(bytes(held)))
                held.clear()
        return "".join([*out, machine.decode(bytes(held), True)])


_made: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's own encoder of a vocabulary; workers are reused, so it is compiled once in each."""
    if path not in _made:
        _made[path] = Encoder(path)
    return _made[path]


def vocabulary(name: str = VOCABULARY) -> str:
    return f"{TOKENIZERS}/{name}"


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids array<int>) of every row."""
    at = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(at)
        for b in batches:
            ids = [enc.encode(t) for t in b.column(1).to_pylist()]
            ends = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=ends[1:])
            flat = np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[key, "ids"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, ids array<int>")


def sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, n_tokens bigint) of every row."""
    at = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(at)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([enc.size(t) for t in b.column(1).to_pylist()], pa.int64())], names=[key, "n_tokens"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens bigint")


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """(key, text) of every row; null ids give the empty text."""
    at = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(at)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([enc.decode(i or []) for i in b.column(1).to_pylist()], pa.string())], names=[key, "text"])

    return encoded.select(F.col(key), F.col(ids)).mapInArrow(run, f"`{key}` {encoded.schema[key].dataType.simpleString()}, text string")
