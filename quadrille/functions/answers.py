"""Values read out of free-text answers: a class label, a number with its unit, or neither."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame

#: Cues (fixed values) that an answer declines or reports no value.
DECLINES = ("cannot answer", "can not answer", "decline", "not able to", "unable to", "cannot be determined", "can not help", "cannot help")
ABSENT = ("not available", "no valid value", "no valid output", "no value exists")
NEGATIONS = frozenset("not no never without isnt doesnt dont cannot neither nor".split())
CONTRACTIONS = {"n't": " not", "'re": " are", "'ve": " have", "'ll": " will", "'s": "", "'m": " am"}
_NUMBER = re.compile(r"(?<![\w.])[-−+]?\d+(?:\.\d+)?(?:e[-+]?\d+)?(?![\w.]*\d)", re.I)
#: Numbers that describe a layout or a count of things, not a value.
_STRUCTURE = re.compile(r"^\s*(?:by\b|x\s*\d|[-–]by[-–]|points?\b|observations?\b|epochs?\b|bins?\b|cells?\b|tiles?\b|rows?\b|columns?\b)", re.I)
_LOOKBACK = 3
#: Number words (fixed values), in the order of their values.
_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
_WORDS = {w: i for i, w in enumerate(_ONES)} | {w: 10 * (i + 2) for i, w in enumerate(_TENS)}
_ONE_WORD = "(?:" + "|".join([*_WORDS, "hundred"]) + ")"
_SPOKEN = re.compile(rf"\b(?:(minus|negative)\s+)?({_ONE_WORD}(?:[\s-]+(?:and\s+)?{_ONE_WORD})*)(?:\s+point((?:\s+(?:{'|'.join(_ONES[:10])}))+))?\b(?=(\s*(?:%|percent\b|mm\b|millimet|days?\b|years?\b))?)", re.I)


def normalise(text: str) -> str:
    s = text.lower().replace("’", "'").replace("‘", "'")
    for a, b in CONTRACTIONS.items():
        s = s.replace(a, b)
    return " ".join(re.sub(r"[^a-z0-9+. ]+", " ", s).split())


def _cue(text: str, cues: Sequence[str]) -> bool:
    text = " ".join(text.replace(".", " ").split())
    return any(f" {c} " in f" {text} " or text.startswith(c) for c in cues)


def label(text: str, names: Sequence[str]) -> tuple[str, str | None]:
    """(status, label): the longest name that stands in the text and is not denied; two unrelated ones are ambiguous."""
    words, found = normalise(text).replace(".", " ").split(), {}
    for name in names:
        want = normalise(name.replace("_", " ")).split()
        for i in range(len(words) - len(want) + 1):
            if want and words[i : i + len(want)] == want and not NEGATIONS & set(words[max(0, i - _LOOKBACK) : i]):
                found[name] = max(found.get(name, 0), len(" ".join(want)))
    # A name inside a longer found one says nothing of its own, unless it also stands apart.
    free = {n: k for n, k in found.items() if not any(n != o and normalise(n.replace("_", " ")) in normalise(o.replace("_", " ")).split(" ") and _alone(words, n, o) is False for o in found)}
    best = [n for n, k in free.items() if k == max(free.values())]
    if not free:
        return "unparsed", None
    if len(free) > 1 or len(best) > 1:
        return "ambiguous", None
    return "parsed", best[0]


def _alone(words: list[str], name: str, other: str) -> bool:
    """name stands somewhere outside the places of other."""
    a, b = normalise(name.replace("_", " ")).split(), normalise(other.replace("_", " ")).split()
    covered = {j for i in range(len(words) - len(b) + 1) if words[i : i + len(b)] == b for j in range(i, i + len(b))}
    return any(words[i : i + len(a)] == a and not covered & set(range(i, i + len(a))) for i in range(len(words) - len(a) + 1))


def in_digits(text: str) -> str:
    """Spoken numbers written in digits where they can be values: with a sign, with decimals, or before a unit."""

    def written(m: re.Match) -> str:
        sign, whole, decimals, unit = m.groups()
        if not (sign or decimals or unit):
            return m.group()
        total = 0
        for w in re.findall(r"[a-z]+", whole.lower()):
            total = max(total, 1) * 100 if w == "hundred" else total + _WORDS.get(w, 0)
        tail = "." + "".join(str(_WORDS[w]) for w in decimals.lower().split()) if decimals else ""
        return ("-" if sign else "") + str(total) + tail

    return _SPOKEN.sub(written, text)


def number(text: str, unit: str | None = None, low: float | None = None, high: float | None = None) -> tuple[str, float | None]:
    """(status, value): the one number that can be the answer. A percentage counts as its hundredth where the value must lie in [0, 1]."""
    got, text = [], in_digits(text)
    for m in _NUMBER.finditer(text):
        rest = text[m.end() : m.end() + 32]
        before = text[max(0, m.start() - 12) : m.start()]
        if _STRUCTURE.match(rest) or re.search(r"\b(?:row|column|cell|bin|by)\s*$", before, re.I):
            continue
        v, share = float(m.group().replace("−", "-")), bool(re.match(r"\s*(?:%|percent)", rest, re.I))
        if share and low == 0 and high == 1:
            v /= 100
        named = re.match(r"\s*(mm/yr²|mm/yr2|mm/yr|mm|days?|years?)\b", re.sub(r"^(\s*)millimet(?:re|er)s?(?: per year)?", lambda x: x.group(1) + ("mm/yr" if "year" in x.group() else "mm"), rest, flags=re.I), re.I)
        if unit and named and named.group(1).lower().rstrip("s") != unit.lower().rstrip("s"):
            continue
        if unit is None and named:
            continue
        if (low is None or v >= low) and (high is None or v <= high):
            got.append((v, bool(named)))
    if unit and any(n for _, n in got):
        got = [g for g in got if g[1]]
    values = sorted({v for v, _ in got})
    if not values:
        return "unparsed", None
    return ("parsed", values[0]) if len(values) == 1 else ("ambiguous", None)


def extract(rows: DataFrame, labels: Mapping[str, Sequence[str]], units: Mapping[str, tuple[str | None, float | None, float | None]]) -> DataFrame:
    """record_id, status, label, value. rows: record_id, task, text. labels and units by task: a class task's names, a number task's (unit, low, high)."""
    labels, units = dict(labels), dict(units)

    def one(task: str | None, text: str | None) -> tuple[str, str | None, float | None]:
        if not text or not text.strip():
            return "unparsed", None, None
        s = normalise(text)
        if _cue(s, DECLINES):
            return "refusal", None, None
        if _cue(s, ABSENT):
            return "missing", None, None
        if task in labels:
            return *label(text, labels[task]), None
        if task in units:
            status, v = number(text, *units[task])
            return status, None, v
        return "unparsed", None, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(r, *one(task, text)) for r, task, text in b[["record_id", "task", "text"]].itertuples(index=False)]
            yield pd.DataFrame(out, columns=["record_id", "status", "label", "value"])

    return rows.select("record_id", "task", "text").mapInPandas(run, f"record_id {rows.schema['record_id'].dataType.simpleString()}, status string, label string, value double")
