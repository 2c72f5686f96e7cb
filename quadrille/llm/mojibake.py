"""Text that was decoded with a wrong encoding: found and restored by a hidden Markov model.

States: one clean state and one for each pair of encodings (written in one,
read in the other). A state writes characters by the corpus' own character
model, a pair's state then spoils them by its pair. The Viterbi path over the
words of a document with characters beyond ASCII labels every character; a span
labelled with a pair is given back by the inverse of that pair. Pure ASCII words
look the same under every pair and carry no evidence.

The character model is learned from the corpus itself: the words with
characters beyond ASCII are counted over all documents, and in a few rounds of
hard expectation-maximisation every word counts as what it most likely was. The
model is a table over pairs of characters, so it is bounded by the alphabet and
not by the corpus.

Characters that were lost (U+FFFD stands where bytes could not be read) mark a
document too, but cannot be restored.

Defined cases: null, empty and ASCII texts are clean; a restored text keeps all
other characters; rows of one id with several texts are judged each for itself;
texts are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.session import cut, forget

LOST = "�"
#: The encodings (fixed values): what text was written in, and what it was read as.
UTF8_READ_AS = ("western", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "iso8859_2", "iso8859_15", "cp1254")
READ_AS_WESTERN = ("koi8_r", "cp1251", "cp1253", "cp1250", "iso8859_2", "mac_roman", "cp437", "cp850")
WESTERN_READ_AS = ("mac_roman", "cp437", "cp850", "cp1251", "cp1250", "cp1253", "koi8_r")
OTHER_PAIRS = (("koi8_r", "cp1251"), ("cp1251", "koi8_r"))
#: Log probabilities of the chain: to enter the state of a pair with UTF-8 from the clean one, that of a pair of
#: one-byte encodings (whose words show no form of their own, so a single misread letter must not do), to leave, to change.
ENTER, ENTER_PLAIN, LEAVE, CHANGE = -7.5, -16.0, -2.5, -8.0
#: Rounds of learning; log odds at which a word counts as restored there; weight of the single-character model in the smoothing; words that a worker remembers.
ROUNDS, MARGIN, SMOOTH, WORDS = 2, 2.0, 2.0, 200_000
_SPACES = re.compile("[ \t\r\n]+")
_UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf4][\x80-\xbf]{3}")


def _chars(encoding: str) -> list[str]:
    """The character of each byte; bytes without one read as control characters, as lenient readers do."""
    name = "cp1252" if encoding == "western" else encoding
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


def _bytes_of(encoding: str) -> dict[str, int]:
    """Byte of each character beyond ASCII; the western readers differ only where one of them has control characters."""
    back = {c: b for b, c in enumerate(_chars(encoding)) if b >= 128}
    if encoding == "western":
        back |= {chr(b): b for b in range(128, 256) if chr(b) not in back}
    return back


class Pair:
    """A pair of encodings and its inverse."""

    def __init__(self, written: str, read: str, times: int = 1):
        self.name, self.written, self.times = f"{written}>{read}" + f"x{times}" * (times > 1), written, times
        self.back = _bytes_of(read)
        group = lambda low, high: "[" + "".join(re.escape(c) for c, b in self.back.items() if low <= b <= high) + "]"
        self.form = re.compile(group(0xC2, 0xF4) + group(0x80, 0xBF))
        if written != "utf_8":
            chars = _chars(written)
            self.table = {ord(c): chars[b] for c, b in self.back.items() if chars[b] != c}

    def _utf8_once(self, s: str) -> str:
        """Runs of characters that are the bytes of one UTF-8 character become it; all else stays."""
        if self.form.search(s) is None:
            return s
        out, run = [], bytearray()
        held: list[str] = []

        def flush() -> None:
            at = 0
            for m in _UTF8.finditer(run):
                out.extend(held[at : m.start()])
                out.append(m.group().decode("utf-8", "replace"))
                at = m.end()
            out.extend(held[at:])
            run.clear(), held.clear()

        for c in s:
            b = self.back.get(c)
            if b is None:
                flush()
                out.append(c)
            else:
                run.append(b)
                held.append(c)
        flush()
        return "".join(out)

    def restore(self, s: str) -> str | None:
        """The text that the pair turned into s, or None where it cannot have."""
        if self.written == "utf_8":
            for _ in range(self.times):
                r = self._utf8_once(s)
                if r == s:
                    return None
                s = r
            return s
        r = s.translate(self.table)
        return None if r == s else r


PAIRS = [
    *(Pair("utf_8", x) for x in UTF8_READ_AS),
    Pair("utf_8", "western", 2),
    *(Pair(x, "western") for x in READ_AS_WESTERN),
    *(Pair("western", x) for x in WESTERN_READ_AS),
    *(Pair(a, b) for a, b in OTHER_PAIRS),
]
N_UTF8 = len(UTF8_READ_AS) + 1
_START = np.array([0.0, *[ENTER] * N_UTF8, *[ENTER_PLAIN] * (len(PAIRS) - N_UTF8)])
_MOVE = np.full((len(_START), len(_START)), CHANGE)
_MOVE[0], _MOVE[:, 0] = _START, LEAVE
np.fill_diagonal(_MOVE, 0.0)


class CharModel:
    """Log probability of a word by pairs of characters, smoothed by the single characters."""

    def __init__(self, pairs: dict[str, float]):
        self.first, single = Counter(), Counter()
        for p, n in pairs.items():
            self.first[p[0]] += n
            single[p[1]] += n
        total = sum(single.values())
        floor = 0.01
        self.single = {c: (n + floor) / (total + floor * 2 * len(single) + 1) for c, n in single.items()}
        self.unseen = floor / (total + floor * 2 * len(single) + 1)
        self.pairs, self.known = pairs, {}

    def log(self, pair: str) -> float:
        if (v := self.known.get(pair)) is None:
            q = self.single.get(pair[1], self.unseen)
            v = self.known[pair] = math.log((self.pairs.get(pair, 0.0) + SMOOTH * q) / (self.first[pair[0]] + SMOOTH))
        return v

    def word(self, w: str) -> float:
        s = f" {w} "
        return sum(self.log(s[i : i + 2]) for i in range(len(s) - 1))


class Words(dict):
    """For each word with characters beyond ASCII: log odds of each pair against the clean state, None where no pair is likelier than clean."""

    def __init__(self, model: CharModel):
        self.model, self.against = model, {}

    def gains(self, words: list[str]) -> np.ndarray | None:
        """Rows of log odds, or None where no word speaks for any pair."""
        got = [self[w] for w in words]
        if all(g is None for g in got):
            return None
        none = np.zeros(1 + len(PAIRS))
        return np.stack([self.against.get(w, none) if g is None else g for w, g in zip(words, got)])

    def __missing__(self, w: str) -> np.ndarray | None:
        clean, out = self.model.word(w), None
        for k, p in enumerate(PAIRS, 1):
            if (r := p.restore(w)) is not None:
                # A word that a pair would have left alone is as likely under it as it is clean: log odds of 0.
                if (gain := self.model.word(r) - clean) != 0:
                    if out is None:
                        out = np.zeros(1 + len(PAIRS))
                    out[k] = gain
        if out is not None and out.max() <= 0:
            # Only pairs that the word speaks against; they matter beside words that speak for them.
            self.against[w] = out
            out = None
        if len(self) >= WORDS:
            self.clear()
            self.against.clear()
        self[w] = out
        return out


def path(gain: np.ndarray) -> np.ndarray:
    """The most likely state of each word."""
    n, k = gain.shape
    if (np.maximum(gain, 0).sum(0) + _START <= 0).all():
        return np.zeros(n, np.int64)
    best, back = _START + gain[0], np.empty((n, k), np.int64)
    for i in range(1, n):
        via = best[:, None] + _MOVE
        back[i] = via.argmax(0)
        best = via[back[i], np.arange(k)] + gain[i]
    out = np.empty(n, np.int64)
    out[-1] = best.argmax()
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def wide_words(text: str) -> list[str]:
    return [w for w in _SPACES.split(text) if not w.isascii()]


def repair(text: str, words: Words) -> tuple[str, list[str]]:
    """The restored text and the pairs of encodings that were undone, in order."""
    found = wide_words(text)
    if not found:
        return text, []
    gain = words.gains(found)
    if gain is None or not (states := path(gain)).any():
        return text, []
    out, at, undone = [], 0, []
    for w, s in zip(found, states):
        i = text.index(w, at)
        out.append(text[at:i])
        at = i + len(w)
        r = PAIRS[s - 1].restore(w) if s else None
        if r is not None and PAIRS[s - 1].name not in undone:
            undone.append(PAIRS[s - 1].name)
        out.append(w if r is None else r)
    return "".join([*out, text[at:]]), undone


def _vocabulary(docs: DataFrame, text: str) -> DataFrame:
    """word, n: the words with characters beyond ASCII of all documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()
        for b in batches:
            for t in b["text"]:
                seen.update(wide_words(t))
            if len(seen) > 100_000:
                yield pd.DataFrame({"word": pd.Series(list(seen), dtype=object), "n": pd.Series(list(seen.values()), dtype="int64")})
                seen.clear()
        yield pd.DataFrame({"word": pd.Series(list(seen), dtype=object), "n": pd.Series(list(seen.values()), dtype="int64")})

    wide = docs.where(F.col(text).rlike(r"[^\x00-\x7f]")).select(F.col(text).alias("text"))
    return wide.mapInPandas(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def likeliest(w: str, turn: int, words: Words | None, plain: frozenset[str]) -> str | None:
    """What a word counts as in a round of learning, None for nothing.

    Round -1 takes only words that no reader of UTF-8 can have made; their
    characters are the plain ones. Round 0 leaves out the words that such a
    reader can have made out of plain characters. Later rounds take the state
    that the model of the round before finds likeliest.
    """
    if LOST in w:
        return None
    if turn <= 0:
        restored = [r for p in PAIRS[:N_UTF8] if (r := p.restore(w)) is not None]
        return None if restored and (turn < 0 or any(plain.issuperset(r) for r in restored)) else w
    if (gain := words[w]) is None or gain.max() <= MARGIN:
        return w
    return PAIRS[int(gain.argmax()) - 1].restore(w) or w


def learn(docs: DataFrame, text: str = "text", rounds: int = ROUNDS) -> dict[str, float]:
    """Counts of character pairs as the words most likely were before any garbling."""
    vocabulary = cut(_vocabulary(docs, text))
    plain: frozenset[str] = frozenset()
    counts: dict[str, float] = {}
    for turn in range(-1, rounds):

        def meant(batches: Iterator[pd.DataFrame], turn: int = turn, before: dict[str, float] = counts, plain: frozenset[str] = plain) -> Iterator[pd.DataFrame]:
            words = Words(CharModel(before)) if turn > 0 else None
            seen: dict[str, float] = {}
            for b in batches:
                for w, n in zip(b["word"], b["n"]):
                    w = likeliest(w, turn, words, plain)
                    if w is not None:
                        s = f" {w} "
                        for i in range(len(s) - 1):
                            seen[s[i : i + 2]] = seen.get(s[i : i + 2], 0) + n
            yield pd.DataFrame({"pair": pd.Series(list(seen), dtype=object), "n": pd.Series(list(seen.values()), dtype=float)})

        got = vocabulary.mapInPandas(meant, "pair string, n double").groupBy("pair").agg(F.sum("n").alias("n"))
        counts = {r["pair"]: r["n"] for r in got.collect()}
        if turn < 0:
            plain = frozenset(c for p in counts for c in p)
    forget(vocabulary)
    return counts


def judge(docs: DataFrame, counts: dict[str, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, restored, pairs array<string>, lost boolean) of the documents with at least one changed character."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words(CharModel(shared.value))
        for b in batches:
            rows = []
            for k, t in zip(b["key"], b["text"]):
                lost = LOST in t
                fixed, undone = repair(t, words)
                if lost or undone:
                    rows.append((k, fixed, undone, lost))
            yield pd.DataFrame(rows, columns=["key", "restored", "pairs", "lost"])

    wide = docs.where(F.col(text).rlike(r"[^\x00-\x7f]")).select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = wide.mapInPandas(run, f"key {kind}, restored string, pairs array<string>, lost boolean")
    return out.withColumnRenamed("key", key)
