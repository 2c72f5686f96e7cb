"""Defective answers in question and answer pairs, each with the kind of its defect.

empty            nothing, blanks, or only a placeholder or marker.
copies_question  the question again, perhaps altered in small ways, and no value.
other_language   a sentence in another script or language than the question's, told by Unicode's scripts and, among
                 languages in Latin letters, by function words.
truncated        the text breaks off where, over the whole corpus, sentences with this beginning go on:
                 termination is learned from how often each sentence beginning was closed by a full stop
                 and how often it went on, with the last three words as a fallback for beginnings
                 seen nowhere else. A missing full stop alone is no defect.
refusal          the sentences of answers without any value are clustered by their first eight words and by
                 verified MinHash of the whole (shingles of five words, similarity 0.8); a template that recurs across unrelated prompts, or that
                 also answers prompts meant to be declined, is a refusal, unless it is how a
                 missing value is properly reported. Prompts whose right answer is a refusal or a
                 missing value have none.

A field has at most one defect, the first in this order. Wrong values are none.
All counts are taken over the whole table.

Defined cases: of rows with one record_id the latest counts (null dates first),
rows with a null id are left out; a null question has no language and no copy;
a null answer type counts as one that expects a value; texts are read whole; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.components import components
from quadrille.session import cut

FIELDS = ("correct_answer", "llm_output")
#: Words of an opening; words of a shingle; similarity of two sentences of one template; prompts' tasks across which a refusal recurs.
OPENING, SHINGLE, ALIKE, RECURS = 8, 5, 0.8, 3
#: Hashes of a signature and rows of a band: sentences 0.8 alike share one of 16 bands of 4 in all but 1 of 5,000 cases.
HASHES, BAND = 64, 4
#: A sentence beginning is a whole sentence if it was closed at least so often for each time that it went on.
CLOSED = 0.1
#: Part of the letters of a question and its copy that stand in the same order where single words were misspelt.
LETTERS = 0.92
#: Class names that the workers are sent at most, and sentences (of some ten words) that a worker remembers.
CLASSES, REMEMBERED = 50_000, 50_000

#: Function words by language (fixed values) for those written in Latin letters; all others are told by script.
FUNCTION_WORDS = {
    "en": "the of and is to in this that for it with what which please how i a an as on you can",
    "de": "der die das und ist für nicht den von mit in es ich sich diesem wie bitte hat bei",
    "fr": "le la les des et est pour une dans que cette du ne pas sur quelle ici ont",
    "es": "el los las y es para una en que esta del no según su qué la tiene han",
    "it": "il lo gli e è per una di che questa non sono si della la loro in con",
    "pt": "o os as e é para uma em que este não da do sua com um foram dos",
    "nl": "de het een en is voor van deze dit niet zonder we in geven blijft op",
    "sv": "och är för att det den en inte av på som vid med några enligt ger",
    "pl": "i w na jest dla to ich się nie tego tym z około kilka bez do",
    "cs": "a je pro na jejich se tuto podle bylo v této přibližně bez několik není z",
    "tr": "ve için bu bir ile olarak değil göre yaklaşık birkaç kadar çok da daha gibi her",
}
_LANGUAGES = list(FUNCTION_WORDS)
_SHARED: dict[str, list[int]] = {}
for _k, _words in enumerate(FUNCTION_WORDS.values()):
    for _w in _words.split():
        _SHARED.setdefault(_w, []).append(_k)

#: What stands for no answer (fixed values), compared without case and surrounding signs.
PLACEHOLDERS = frozenset("null none nan n/a na nil undefined empty blank tbd todo eos bos pad unk s /s a q answer output response assistant no output no answer no response".split()) | {
    "no output", "no answer", "no response", "end of text", "endoftext", "|endoftext|", "not applicable", "to be filled in", "insert answer here", "the answer",
}
#: Names of units that may follow a bare value (fixed values).
UNITS = frozenset("mm cm m km day days d yr year years a / per % tage jours días jour tag".split())

_INVISIBLE = re.compile("[\\s​‌‍⁠﻿­]+")
_EDGES = re.compile(r"^[^\w%]+|[^\w%]+$")
_NUMBER = re.compile(r"(?<![\w#])[-−+]?\d+(?:[.,]\d+)*")
_WORD = re.compile(r"#|<t>|<l>|\w+(?:[-'’]\w+)*|[^\w\s]")
_QUOTED = re.compile(r"[„“”\"«»‹›]\s*([^„“”\"«»‹›]{2,80}?)\s*[„“”\"«»‹›]")
_ENDS = re.compile(r"[.!?。！？]+[\"'”’»)\]]*\s+|[.!?。！？]+[\"'”’»)\]]*$")
_LABEL = re.compile(r"^\W*(?:[\w ]{1,24}):\s*")


_LONGEST = max(map(len, PLACEHOLDERS))


def is_empty(text: str | None) -> bool:
    if text is None:
        return True
    # More letters than the longest placeholder has.
    if sum(map(str.isalnum, text[:64])) > _LONGEST:
        return False
    s = _INVISIBLE.sub(" ", text).strip().lower()
    s = _EDGES.sub("", s)
    return not s or s in PLACEHOLDERS or _INVISIBLE.sub(" ", s.replace("_", " ")) in PLACEHOLDERS


def script(letters: str) -> str:
    """The script of most letters, by the names that Unicode gives them."""
    if letters.isascii():
        return "LATIN"
    return Counter(unicodedata.name(c, "?").split(" ", 1)[0] for c in letters).most_common(1)[0][0]


def language(words: Sequence[str]) -> tuple[str, np.ndarray]:
    """The script, and a score for each language; a word that several share is worth a part of one for each."""
    out = np.zeros(len(_LANGUAGES))
    for w in words:
        for k in (at := _SHARED.get(w, ())):
            out[k] += 1 / len(at)
    return script("".join(words)) if words else "", out


class Tongues(dict):
    """language() of word tuples, remembered."""

    def __missing__(self, words: tuple[str, ...]) -> tuple[str, np.ndarray, int]:
        if len(self) >= REMEMBERED:
            self.clear()
        kind, scores = language(words)
        self[words] = out = (kind, scores, int(scores.argmax()))
        return out

    def __init__(self) -> None:
        self.known: dict[tuple, bool] = {}

    def differ(self, question: tuple[str, ...], words: tuple[str, ...]) -> bool:
        """Whether the words are told to be in another language than the question."""
        if (known := self.known.get((question, words))) is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            known = self.known[question, words] = self._differ(question, tuple(w for w in words if w[0].isalpha()))
        return known

    def _differ(self, question: tuple[str, ...], words: tuple[str, ...]) -> bool:
        asked_in, asked, tongue = self[question]
        told_in, told, best = self[words]
        if not asked_in or len("".join(words)) < 3:
            return False
        if told_in != asked_in:
            return True
        return len(words) >= 3 and asked[tongue] >= 0.5 and best != tongue and told[best] >= 1 and told[best] >= told[tongue] + 0.75


class Reader:
    """Normalises the texts of one record: topics become <t>, class labels <l>, numbers #."""

    def __init__(self, topics: dict[str, str], labels: dict[str, list[str]]):
        self.topics = {k: v.lower() for k, v in topics.items()}
        self.labels = {}
        for task, names in labels.items():
            forms = sorted({f for n in names for f in (n.lower(), n.lower().replace("_", " "))}, key=len, reverse=True)
            if forms:
                self.labels[task] = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, forms)) + r")(?!\w)")

    def mask(self, task: str | None, question: str, text: str) -> str:
        s = text.lower().replace("’", "'")
        known = [self.topics[task]] if task in self.topics else []
        for topic in known + [q.lower() for q in _QUOTED.findall(question)]:
            s = s.replace(topic.replace("’", "'"), " <t> ")
        if task in self.labels:
            s = self.labels[task].sub(" <l> ", s)
        return _NUMBER.sub("#", s)


def sentences(masked: str) -> list[tuple[list[str], bool]]:
    """(words, closed) of each sentence."""
    out, at = [], 0
    for m in _ENDS.finditer(masked):
        if words := _WORD.findall(masked[at : m.start()]):
            out.append((words, "..." not in m.group() and "…" not in m.group()))
        at = m.end()
    if words := [w for w in _WORD.findall(masked[at:])]:
        while words and words[-1] == "…":
            words.pop()
        if words:
            out.append((words, False))
    return out


def openings(words: list[str]) -> list[tuple[str, str]]:
    """(first words, all words) of a sentence, with and without a lead-in of at most four words before a comma or dash."""
    out = [words]
    for k, w in enumerate(words[:5]):
        if w in ",–—:;-" and k:
            out.append(words[k + 1 :])
            break
    flat = [[w for w in s if w[0].isalnum() or w[0] == "<"] for s in out]
    return [(" ".join(s[:OPENING]), " ".join(s)) for s in flat if len(s) >= 3]


def in_order(a: Sequence[str], b: Sequence[str]) -> int:
    """Length of the longest common subsequence, by whole rows of bits, so that long texts take no other way than short ones."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & at.get(y, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def copies(question: str, text: str) -> bool:
    """The question's words again, in order, with little else."""
    q = re.findall(r"\w+", question.lower())
    bag = set(q)
    for form in (text, _LABEL.sub("", text)):
        a = [w for w in re.findall(r"\w+", form.lower()) if w in bag or w not in PLACEHOLDERS]
        if not q or not a:
            continue
        if a == q:
            return True
        # Nothing but the question's words, and nearly all of them, however often.
        if len(a) >= 0.7 * len(q) and len(bag & set(a)) >= 0.85 * len(bag) and sum(w in bag for w in a) >= 0.85 * len(a):
            return True
        if len(a) > 1.4 * len(q) + 2 or len(a) < 0.7 * len(q):
            continue
        # Either nearly all words in order, or nearly all letters where single words were misspelt.
        same = in_order(q, a)
        if same >= 0.8 * len(q) and same >= 0.75 * len(a):
            return True
        x, y = " ".join(q), " ".join(a)
        if min(len(x), len(y)) >= LETTERS / (2 - LETTERS) * max(len(x), len(y)) and 2 * in_order(x, y) >= LETTERS * (len(x) + len(y)):
            return True
    return False


def rolling(words: Sequence[str]) -> list[int]:
    """A hash of each beginning of the sentence, from that of the one before."""
    out, h = [], 0
    for w in words:
        h = xxhash.xxh64_intdigest(w, seed=h)
        out.append(h - (1 << 64) if h >> 63 else h)
    return out


_FEATURES = (
    "record_id {id}, field string, task string, answer_type string, defect string, sents array<struct<s:string,closed:boolean>>, "
    "last bigint, tail string, open boolean, bare boolean, value boolean, openings array<struct<opening:string,sentence:string>>"
)


def features(rows: DataFrame, topics: dict[str, str], labels: dict[str, list[str]]) -> DataFrame:
    """What can be told of each field by itself. rows: record_id, task, question, answer_type, correct_answer, llm_output."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, tongues, questions = Reader(topics, labels), Tongues(), {}
        for b in batches:
            out = []
            for rid, task, question, kind, *texts in b[["record_id", "task", "question", "answer_type", *FIELDS]].itertuples(index=False):
                question = question or ""
                if question not in questions:
                    if len(questions) >= REMEMBERED:
                        questions.clear()
                    questions[question] = tuple(re.findall(r"[^\W\d_]+", _QUOTED.sub(" ", question.lower()))), set(_NUMBER.findall(question))
                asked, numbers = questions[question]
                for field, text in zip(FIELDS, texts):
                    if is_empty(text):
                        out.append((rid, field, task, kind, "empty", [], 0, "", False, False, False, []))
                        continue
                    masked = reader.mask(task, question, text)
                    sents = sentences(masked)
                    value = "<l>" in masked or any(n not in numbers for n in _NUMBER.findall(text))
                    defect = None
                    if not value and copies(question, text):
                        defect = "copies_question"
                    elif any(tongues.differ(asked, tuple(words)) for words, _ in sents):
                        defect = "other_language"
                    words, closed = sents[-1] if sents else ([], True)
                    bare = bool(words) and len(sents) == 1 and words[0] in ("#", "<l>") and all(w in UNITS for w in words[1:])
                    # A full stop behind a number may be its decimal point.
                    opened = not closed or words[-1] == "#"
                    starts = [] if value else sorted({o for s, _ in sents for o in openings(s)})
                    last = (rolling(words) or [0])[-1] if opened else 0
                    out.append((rid, field, task, kind, defect, [(" ".join(s), c) for s, c in sents], last, " ".join(["^", *words][-3:]), opened, bare, value, starts))
            yield pd.DataFrame(out, columns=["record_id", "field", "task", "answer_type", "defect", "sents", "last", "tail", "open", "bare", "value", "openings"])

    return rows.mapInPandas(run, _FEATURES.format(id=rows.schema["record_id"].dataType.simpleString()))


def beginnings(seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For every task: (last, closed, went_on) of every sentence beginning, and the same of every three words in a row, over all texts."""
    one = seen.where("defect is null").select("task", F.inline("sents")).groupBy("task", "s", "closed").agg(F.count("*").alias("n"))

    def cuts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for task, s, closed, n in b[["task", "s", "closed", "n"]].itertuples(index=False):
                words, end = s.split(" "), s.count(" ")
                marked = ["^", *words]
                rows += [(task, h, " ".join(marked[max(0, i - 1) : i + 2]), n if i == end and closed else 0, n if i != end else 0) for i, h in enumerate(rolling(words))]
            yield pd.DataFrame(rows, columns=["task", "last", "tail", "c", "o"])

    at = cut(one.mapInPandas(cuts, "task string, last bigint, tail string, c bigint, o bigint").groupBy("task", "last", "tail").agg(F.sum("c").alias("c"), F.sum("o").alias("o")))
    return at.groupBy("task", "last").agg(F.sum("c").alias("closed"), F.sum("o").alias("went_on")), at.groupBy("task", "tail").agg(F.sum("c").alias("closed3"), F.sum("o").alias("went_on3"))


def _signature(text: str) -> tuple[list[int], list[int]]:
    """(shingles, MinHash) of a sentence; one with fewer words than a shingle is one shingle."""
    w = text.split(" ")
    shingles = {xxhash.xxh64_intdigest(" ".join(w[i : i + SHINGLE])) for i in range(max(1, len(w) - SHINGLE + 1))}
    x = np.array(sorted(shingles), np.uint64)
    rng = np.random.default_rng(5)
    a, b = rng.integers(1, 2**63, HASHES, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**63, HASHES, dtype=np.uint64)
    h = (x[:, None] * a + b) ^ ((x[:, None] * a + b) >> np.uint64(29))
    return x.view(np.int64).tolist(), h.min(axis=0).view(np.int64).tolist()


def _alike(pdf: pd.DataFrame) -> pd.DataFrame:
    """(a, b): links between the alike sentences of a pair of blocks of one band."""
    i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
    names, mine = pdf["sentence"].tolist(), pdf["mine"].tolist()
    sets, holders, out = [set(x) for x in pdf["shingles"]], {}, []
    for at, shingles in enumerate(sets):
        shared: dict[int, int] = {}
        for x in shingles:
            for other in holders.setdefault(x, []):
                shared[other] = shared.get(other, 0) + 1
            holders[x].append(at)
        for other, both in shared.items():
            # Pairs within one block are compared where that block meets itself.
            if (i == j or mine[at] != mine[other]) and both >= ALIKE * (len(shingles) + len(sets[other]) - both):
                out.append((names[other], names[at]))
    return pd.DataFrame(out, columns=["a", "b"])


def templates(openings: DataFrame, block: int = 1024) -> DataFrame:
    """(opening, template): openings whose sentences are alike, by verified MinHash, under the smallest of them.

    openings: opening and the sentence it begins; without a sentence it stands
    for itself. All pairs of sentences that share a band are compared, those of
    a band above `block` in pairs of blocks.
    """
    if "sentence" not in openings.columns:
        openings = openings.withColumn("sentence", F.col("opening"))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for s in b["sentence"]:
                shingles, sig = _signature(s)
                rows += [(s, shingles, f"{k}:{sig[k : k + BAND]}") for k in range(0, HASHES, BAND)]
            yield pd.DataFrame(rows, columns=["sentence", "shingles", "band"])

    one = cut(openings.select("opening", "sentence").distinct())
    banded = cut(one.select("sentence").distinct().mapInPandas(sign, "sentence string, shingles array<bigint>, band string"))
    counted = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    dense = banded.join(counted, "band").withColumns({"blocks": blocks, "mine": F.pmod(F.xxhash64("sentence"), blocks).cast("int")})
    # A row goes to each pair of blocks that its own is part of.
    spread = dense.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("band", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "sentence", "shingles")
    alike = spread.groupBy("band", "i", "j").applyInPandas(_alike, "a string, b string").distinct()
    of = lambda c: one.select(F.col("opening").alias(f"of_{c}"), F.col("sentence").alias(c))
    links = alike.join(of("a"), "a").join(of("b"), "b").where("of_a <> of_b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).distinct()
    label = components(links)
    return one.select("opening").distinct().join(label.withColumnsRenamed({"node": "opening", "component": "template"}), "opening", "left").select("opening", F.coalesce("template", "opening").alias("template"))


def defects(records: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """(record_id, field, defect) of every defective field.

    records: record_id, task, question, correct_answer, llm_output, answer_type,
    rendered_target_value, evaluated_at; catalog: task_id, task_name, the few
    named topics of the questions (a fixed table).
    """
    keep = ["task", "question", "answer_type", *FIELDS]
    latest = records.where("record_id is not null").groupBy("record_id").agg(F.max(F.struct("evaluated_at", *keep)).alias("r")).select("record_id", *[F.col(f"r.{c}") for c in keep])
    labels = records.where("answer_type = 'categorical' and rendered_target_value is not null").groupBy("task").agg(F.collect_set("rendered_target_value").alias("names"))
    named = cut(labels)
    if (found := named.agg(F.sum(F.size("names"))).first()[0] or 0) > CLASSES:
        raise ValueError(f"rendered_target_value has {found} class names, more than {CLASSES}: it holds something else than classes")
    classes = {r["task"]: [n for n in r["names"] if n.strip()] for r in named.collect()}
    topics = {r["task_id"]: r["task_name"] for r in catalog.collect() if r["task_id"] and r["task_name"]} if catalog is not None else {}
    seen = cut(features(latest, topics, classes))

    whole, three = beginnings(seen)
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    doubt = seen.where("defect is null and open and not bare").select("record_id", "field", "task", "last", "tail").join(whole, ["task", "last"], "left").join(three, ["task", "tail"], "left")
    known = (n("closed") + n("went_on")) > 0
    goes_on = F.when(known, n("closed") <= CLOSED * n("went_on")).otherwise(n("closed3") <= CLOSED * (n("went_on3") + 1))
    truncated = doubt.where(goes_on).select("record_id", "field", F.lit("truncated").alias("defect"))

    rest = seen.where("defect is null and not value").join(truncated, ["record_id", "field"], "left_anti")
    rest = cut(rest.select("record_id", "field", "task", "answer_type", F.inline("openings")))
    form = cut(templates(rest))
    voices = rest.join(form, "opening").groupBy("template").agg(
        F.count_distinct(F.when(~F.coalesce("answer_type", F.lit("")).isin("refusal", "missing"), F.col("task"))).alias("tasks"),
        F.count_if(F.col("answer_type") == "refusal").alias("declined"),
        F.count_if((F.col("answer_type") == "missing") & (F.col("field") == "correct_answer")).alias("absent"),
    )
    # A template that only reports missing values is the proper answer to them.
    refusing = voices.where("(tasks >= {} or declined > 0 and tasks > 0) and absent = 0".format(RECURS)).select("template")
    owing = rest.where(~F.coalesce("answer_type", F.lit("")).isin("refusal", "missing"))
    refusal = owing.join(form, "opening").join(refusing, "template").select("record_id", "field", F.lit("refusal").alias("defect"))
    return seen.where("defect is not null").select("record_id", "field", "defect").unionByName(truncated).unionByName(refusal).distinct()
