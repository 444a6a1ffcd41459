"""Subject areas of texts by a multi-pattern automaton over weighted subject terms.

The list of terms is curated by rules, not by hand. Labelled examples give strong terms: runs of up to three words that
stand with one subject. One pass over all texts then counts every word against the subject that the *other* sentences of
its text have by strong terms; words that keep to one to three subjects there join the list, weighted by how far they do
and how rare they are. A second pass with that list does so again. Only counts of words leave a task, and only terms come
to the driver. An automaton over all terms reads every text once, the longest term first; a sentence's score of a subject
is the weight of its terms over the logarithm of its length, and a text has every subject that at least two of its
sentences reach the threshold of. The threshold is calibrated on examples that were held out. Terms that several subjects
share go to the subject that the rest of the text is about.

Defined results: null, blank and very short texts have no subject; markup, entities and text decoded with the wrong
table are put right first; case does not matter; a repeated sentence counts each time.
"""

from __future__ import annotations

import heapq
import html
import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.languages import Profiles, fit_rows, mended
from folioscope.plans.materialize import cut

#: Labelled examples used, at most.
EXAMPLES = 20_000
#: Longest term of examples in words.
RUN = 3
#: Examples and share of a strong term.
STRONG_COUNT, STRONG_SHARE, FEW = 3, 0.9, 6
#: Passes over the corpus, each with the terms of the one before.
ROUNDS = 2
#: Different sentences that a term stands in, at least (counted in 64 cells).
CONTEXTS = 4
#: Share of one subject, or of two or three together, that a term needs, after the shares of the language's sentences are evened out.
TERM_SHARE, GROUP_SHARE = 0.72, 0.88
#: Likelihood ratio of a term's subjects against the language's, at least.
SIGNIFICANT = 22.0
#: A word is judged from LEAST_SHARE of the sentences with a known subject on, so there are at most
#: (words of a sentence) / LEAST_SHARE of them.
LEAST_SHARE = 1e-5
#: Scores tried as threshold of a sentence; the middle one of those that suit the held-out examples best holds.
THRESHOLDS = [k / 20 for k in range(1, 21)]
#: Every so manieth example, by hash, is held out.
HELD_OUT = 4
SENTENCES = 2
#: Runs that a task counts before it passes them on.
HELD = 300_000

_TAG = re.compile(r"<[^<>]{1,200}>")
_END = re.compile(r"(?<=[.!?؟…])[\s\"'»)\]]+|[\r\n]+")
_WORD = re.compile(r"[^\W\d_]+")
_MARKS = re.compile(r"[ـً-ْ​-‏‪-‮⁦-⁩﻿­]")


def sentences(text: str | None) -> list[list[str]]:
    """Words of each sentence, lower case."""
    if not text or text.isspace():
        return []
    plain = _TAG.sub("\n", html.unescape(mended(text)))
    return [w for s in _END.split(_MARKS.sub("", plain)) if (w := _WORD.findall(s.lower()))]


def runs(words: list[str]) -> Iterator[str]:
    for n in range(1, RUN + 1):
        for i in range(len(words) - n + 1):
            yield " ".join(words[i : i + n])


def strong_terms(examples: Iterable[tuple[str, str, str]]) -> dict[str, dict[str, float]]:
    """Terms that keep to one subject in the examples (text, subject, language).

    A language's subject with fewer than FEW of them also takes runs seen twice and only there.
    """
    seen: dict[str, Counter] = defaultdict(Counter)
    languages: dict[str, Counter] = defaultdict(Counter)
    for text, subject, language in examples:
        for run in {r for s in sentences(text) for r in runs(s)}:
            seen[run][subject] += 1
            languages[run][language] += 1
    spread = {w for w, c in seen.items() if " " not in w and len(c) >= 4}
    out, held, spare = {}, Counter(), defaultdict(list)
    for run, counts in sorted(seen.items()):
        words, total = run.split(" "), sum(counts.values())
        subject, n = counts.most_common(1)[0]
        if words[0] in spread or words[-1] in spread or n < STRONG_COUNT - 1 or n / total < STRONG_SHARE:
            continue
        key = (languages[run].most_common(1)[0][0], subject)
        if n >= STRONG_COUNT:
            out[run] = {subject: 0.8}
            held[key] += 1
        elif len(words) <= 2:
            spare[key].append(run)
    for key, more in spare.items():
        if held[key] < FEW:
            out |= {run: {key[1]: 0.8} for run in more}
    return out


@dataclass
class Matcher:
    """An automaton over terms {term: {subject: weight}}."""

    terms: dict[str, dict[str, float]]
    _automaton: ahocorasick.Automaton | None = field(default=None, repr=False)
    _near: dict[str, str] | None = field(default=None, repr=False)
    _known: set[str] | None = field(default=None, repr=False)
    _repairs: dict[str, str] = field(default_factory=dict, repr=False)
    words: frozenset[str] = frozenset()
    threshold: float = 0.35

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None, "_near": None, "_known": None, "_repairs": {}}

    def _build(self) -> None:
        self._automaton = ahocorasick.Automaton()
        for term in self.terms:
            self._automaton.add_word(f" {term}", term)
        self._automaton.make_automaton()
        self._known = {w for t in self.terms for w in t.split(" ")} | self.words
        self._near = {}
        for word in sorted({w for t in self.terms for w in t.split(" ") if len(w) >= 5}):
            for i in range(len(word)):
                self._near.setdefault(word[:i] + word[i + 1 :], word)

    def repaired(self, word: str) -> str:
        """The word of a term that an unknown word is one typing error away from, else the word; each word is looked up once."""
        if word not in self._repairs:
            if len(self._repairs) > HELD:
                self._repairs.clear()
            self._repairs[word] = self._repair(word)
        return self._repairs[word]

    def _repair(self, word: str) -> str:
        if len(word) < 5 or word in self._known:
            return word
        if word in self._near:
            return self._near[word]
        for i in range(len(word)):
            short = word[:i] + word[i + 1 :]
            if short in self._known and len(short) >= 5:
                return short
            if short in self._near and abs(len(self._near[short]) - len(word)) == 0:
                return self._near[short]
        return word

    def scores(self, found: list[list[str]]) -> list[dict[str, float]]:
        """For each sentence the score of its subjects."""
        if self._automaton is None:
            self._build()
        if not self.terms:
            return [{} for _ in found]
        out = []
        for words in found:
            text = " " + " ".join(map(self.repaired, words)) + " "
            score: dict[str, float] = defaultdict(float)
            at = -1
            for end, term in self._longest(text):
                if end - len(term) > at:
                    at = end
                    for subject, weight in self.terms[term].items():
                        score[subject] += weight
            scale = 1 + math.log10(1 + len(words)) / 4
            out.append({s: v / scale for s, v in score.items()})
        return out

    def _longest(self, text: str) -> list[tuple[int, str]]:
        """(end, term) of whole-word matches, those that start first and of these the longest, without overlap."""
        hits = [(end - len(term), -end, term) for end, term in self._automaton.iter(text) if text[end + 1] == " "]
        hits.sort()
        out, at = [], -1
        for start, end, term in hits:
            if start >= at:
                out.append((-end, term))
                at = -end + 1
        return out

    def subjects(self, text: str | None) -> dict[str, int]:
        """Number of sentences about each subject; shared terms go where the text's clear sentences are."""
        clear: Counter = Counter()
        open_: list[list[tuple[str, float]]] = []
        for score in self.scores(sentences(text)):
            ranked = sorted(((s, v) for s, v in score.items() if v >= self.threshold * 0.5), key=lambda x: (-x[1], x[0]))
            if not ranked or ranked[0][1] < self.threshold:
                continue
            if len(ranked) == 1 or ranked[1][1] < ranked[0][1] * 0.6:
                clear[ranked[0][0]] += 1
            else:
                open_.append(ranked)
        base = clear.copy()
        for ranked in open_:
            best = max(ranked, key=lambda x: (base[x[0]], x[1]))
            clear[best[0]] += 1
        return dict(clear)


TERMS = "run STRING, subject STRING, weight DOUBLE"
COUNTS = "lang STRING, run STRING, subject STRING, n BIGINT, cells BIGINT, places BIGINT"


def corpus_counts(texts: DataFrame, matcher: Matcher, profiles: Profiles) -> DataFrame:
    """(lang, run, subject, n, cells, places): sentences of a language holding a word (each holds the empty one), by the
    one subject of the other sentences of the text. cells and places have a bit for every 64th part of the sentences
    and of the texts' other sentences on the subject, so that copies and templates count once."""
    shared = texts.sparkSession.sparkContext.broadcast((matcher, profiles))

    def rows_of(counts: dict[tuple, list]) -> pd.DataFrame:
        rows = [(*k, n, *(b - (1 << 64) if b >> 63 else b for b in bits)) for k, (n, *bits) in counts.items()]
        return pd.DataFrame(rows, columns=["lang", "run", "subject", "n", "cells", "places"]).astype({"n": "int64", "cells": "int64", "places": "int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        match, profile = shared.value
        spoken_of: dict[str, str] = {}
        for batch in batches:
            counts: dict[tuple, list] = {}
            split = [sentences(t) for t in batch["text"]]
            flat = [" ".join(w) for found in split for w in found]
            # a sentence that comes again has its language already
            new = [t for t in dict.fromkeys(flat) if t not in spoken_of]
            if len(spoken_of) > HELD:
                spoken_of.clear()
                new = list(dict.fromkeys(flat))
            if new:
                spoken_of.update(zip(new, np.array(profile.languages)[profile.segments(new)[0].argmax(1)].tolist()))
            spoken = map(spoken_of.__getitem__, flat)
            for found in split:
                about = [max(s, key=s.get) if s else None for s in match.scores(found)]
                total = Counter(a for a in about if a)
                # the least sentence on a subject and the next, for the least other one of each
                least = heapq.nsmallest(2, ((" ".join(w), i) for i, (w, a) in enumerate(zip(found, about)) if a))
                for i, (words, own) in enumerate(zip(found, about)):
                    language, rest = next(spoken), total.copy()
                    if own:
                        rest[own] -= 1
                    rest += Counter()
                    if len(rest) == 1:
                        (subject,) = rest
                        cell = 1 << (zlib.crc32(" ".join(words).encode()) & 63)
                        near = next(x for x, k in least if k != i)
                        place = 1 << (zlib.crc32(near.encode()) & 63)
                        for r in {"", *words}:
                            entry = counts.setdefault((language, r, subject), [0, 0, 0])
                            entry[0] += 1
                            entry[1] |= cell
                            entry[2] |= place
                if len(counts) > HELD:
                    yield rows_of(counts)
                    counts = {}
            yield rows_of(counts)

    return texts.where("text IS NOT NULL").select("text").mapInPandas(run, COUNTS).groupBy("lang", "run", "subject").agg(F.sum("n").alias("n"), F.bit_or("cells").alias("cells"), F.bit_or("places").alias("places"))


def mine(texts: DataFrame, examples: DataFrame) -> Matcher:
    """Terms of all texts, from examples (text, subject, lang) of at most EXAMPLES rows."""
    rows = examples.where("text IS NOT NULL AND subject IS NOT NULL").distinct().orderBy(F.xxhash64("text")).limit(EXAMPLES).toPandas()
    profiles = fit_rows(rows.rename(columns={"lang": "label"}))
    held_out = np.array([zlib.crc32(t.encode()) % HELD_OUT == 0 for t in rows["text"]], bool)
    strong, known = (strong_terms(zip(r["text"], r["subject"], r["lang"])) for r in (rows, rows[~held_out]))
    matcher = Matcher(strong)
    for _ in range(ROUNDS):
        counts = cut(corpus_counts(texts, matcher, profiles))
        base = {(r["lang"], r["subject"]): r["n"] for r in counts.where("run = ''").collect()}
        least = max(4, LEAST_SHARE * sum(base.values()))
        by_word = (
            counts.where("run <> ''").groupBy("lang", "run")
            .agg(F.map_from_entries(F.collect_list(F.struct("subject", "n"))).alias("by"), F.sum("n").alias("n"), F.least(F.bit_count(F.bit_or("cells")), F.bit_count(F.bit_or("places"))).alias("contexts"))
            .where(F.col("n") >= least)
        )
        by_word = cut(by_word)
        words = frozenset(r["run"] for r in by_word.where(F.col("n") >= 5 * least).select("run").distinct().toLocalIterator())
        matcher = Matcher(_terms(by_word, base, strong), words=words)
    # the threshold is set without what the held-out examples say
    without = calibrated(Matcher(_terms(by_word, base, known), words=words), list(zip(rows["text"][held_out], rows["subject"][held_out])))
    matcher.threshold = without.threshold
    return matcher


def _terms(counted: DataFrame, base: dict[tuple[str, str], int], strong: dict[str, dict[str, float]]) -> dict[str, dict[str, float]]:
    """The list of terms: words (lang, run, by, n, contexts) that are terms, weighed in the tasks, and strong terms too rare to judge."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(r, s, w) for language, r, by in zip(batch["lang"], batch["run"], batch["by"]) for s, w in weighed(language, dict(by), base).items()]
            yield pd.DataFrame(rows, columns=["run", "subject", "weight"])

    judged = counted.where((F.col("contexts") >= CONTEXTS) & (F.array_max(F.map_values("by")) >= 0.25 * F.col("n")))
    out: dict[str, dict[str, float]] = {}
    for r in judged.select("lang", "run", "by").mapInPandas(run, TERMS).groupBy("run", "subject").agg(F.max("weight").alias("weight")).toLocalIterator():
        out.setdefault(r["run"], {})[r["subject"]] = r["weight"]
    # what the examples say holds only of terms with a word that the corpus has too few contexts of
    parts = sorted({w for t in strong for w in t.split(" ")})
    seen = {r["run"] for r in counted.where((F.col("contexts") >= CONTEXTS) & F.col("run").isin(parts)).select("run").distinct().collect()}
    out |= {t: by for t, by in strong.items() if t not in out and not seen.issuperset(t.split(" "))}
    kept = {}
    for term, by in out.items():
        words = term.split(" ")
        inner = [" ".join(words[i:j]) for i in range(len(words)) for j in range(i + 1, len(words) + 1) if j - i < len(words)]
        if not any(k in out for k in inner):  # the shorter term says it
            kept[term] = by
    return kept


def calibrated(matcher: Matcher, labelled: list[tuple[str, str]]) -> Matcher:
    """The matcher with the middle one of the thresholds that find the held-out subjects best and the fewest others."""

    def value(threshold: float) -> int:
        matcher.threshold = threshold
        found = [({s for s, n in matcher.subjects(t).items() if n >= SENTENCES}, s) for t, s in labelled]
        return sum((s in f) - 2 * len(f - {s}) for f, s in found)

    values = [value(t) for t in THRESHOLDS]
    best = [t for t, v in zip(THRESHOLDS, values) if v == max(values)]
    matcher.threshold = best[len(best) // 2]
    return matcher


def weighed(language: str, by: dict[str, int], base: dict[tuple[str, str], int]) -> dict[str, float]:
    """Weights from 0 to 1 of a word for its subjects from its counts, against the language's sentences; none if it is no term."""
    of = {s: base.get((language, s), 0) for s in sorted({s for _, s in base})}
    everything, total, all_ = sum(base.values()), sum(by.values()), sum(of.values())
    ratio = 2 * sum(n * math.log(n * all_ / (total * of[s])) for s, n in by.items() if of[s])
    if ratio < SIGNIFICANT:
        return {}
    even = {s: by.get(s, 0) / (n + 5) for s, n in of.items()}
    ranked = sorted(((s, v / sum(even.values())) for s, v in even.items()), key=lambda x: (-x[1], x[0]))
    rarity = min(1.0, 0.5 + math.log(everything / total) / math.log(everything + 2))
    held = dict(ranked[:1]) if ranked[0][1] >= TERM_SHARE else next((dict(ranked[:k]) for k in (2, 3) if sum(v for _, v in ranked[:k]) >= GROUP_SHARE), {})
    return {s: share * rarity for s, share in held.items()}


FOUND = "doc_id BIGINT, subject STRING, n_sentences INT"


def assign(texts: DataFrame, matcher: Matcher, least: int = SENTENCES) -> DataFrame:
    """doc_id, subject and number of sentences of every subject of every text."""
    shared = texts.sparkSession.sparkContext.broadcast(matcher)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, s, n) for d, t in zip(batch["doc_id"], batch["text"]) for s, n in shared.value.subjects(t).items() if n >= least]
            yield pd.DataFrame(rows, columns=["doc_id", "subject", "n_sentences"])

    return texts.where("text IS NOT NULL").select("doc_id", "text").mapInPandas(run, FOUND)


def accuracy(matcher: Matcher, labelled: list[tuple[str, str]]) -> float:
    """Share of labelled texts whose most frequent subject is the label."""
    right = [bool(f := matcher.subjects(t)) and max(f, key=f.get) == s for t, s in labelled]
    return float(np.mean(right)) if right else 0.0
