"""Noise of scanned pages: furniture, words divided at line ends, misrecognised words; and the text without it.

One pass over all pages collects distinct lines and the first and last lines of pages; words are counted over distinct
lines, so that copies of a page count once. Frequent words (a share of all words, so their number is bounded) form the
vocabulary. A second pass lists the other words of every page; each distinct one is looked up once, in inverted joins
with the vocabulary: by character bigrams of words of about its length, counted against what errors can take away, and by
its strokes, in which all confusions of a scanner are alike. All vocabulary words within the allowed scanner cost are
found so. Boosted trees rank them, and the readings go back to the pages that hold the word. A second set of trees looks at pairs of lines
and says whether the first one's last word goes on in the second. Both are trained on the vocabulary itself: words sent
through the confusions and words cut in two, against words that are right although they are not in the rest of the
vocabulary. Furniture is what stands at the edge of pages and comes back on other pages of the document or corpus, and
what numbers the page.

Defined results: null and blank pages have no lines of any kind; lines count from 1 at line feeds, blank ones too;
repeated rows count once; names, addresses, numbers and mail addresses are never misread words.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.boosting import Boosted
from folioscope.plans.materialize import cut, spread

#: Share of all words of distinct lines that makes a word vocabulary (at most 1 / WORD_SHARE words), and its least count.
WORD_SHARE, WORD_COUNT = 2e-5, 4
#: Share of documents (and least number) with which a line at the edge of pages is common furniture or a common title.
EDGE_SHARE, EDGE_COUNT = 0.002, 3
#: A vocabulary word is itself a misreading where a word it is easily confused with is so many times as frequent.
CONFUSED_RATIO = 40
#: Vocabulary words and other words that the trees are trained on, at most.
TRAINING_WORDS = 3000
#: Errors other than confusions that COST_LIMIT has room for, when words have no confusion besides; such an error takes at
#: most three bigrams of a word away and changes its length by one.
ERRORS = 2
#: Bigrams up to which two words may share none with that many errors.
FEW = 3 * ERRORS
#: Tenths of scanner cost up to which a vocabulary word is a candidate.
COST_LIMIT = 20
#: Candidates of a word that the trees are trained on, at most, besides the right one: the nearest.
TRAINING_NEAR = 6
#: Probability from which a replacement or a join counts.
MISREAD, JOINED = 0.5, 0.5
SEED = 11
#: Words or lines that a task holds before it passes them on.
HELD = 300_000
#: Letters of words that are looked up; longer runs of signs are no words.
LEAST_WORD, LONGEST = 2, 40

# Characters that scanners take for each other.
CONFUSED = ["0oOQ", "1lIi|!", "5sS", "9gq", "8B", "ce", "hb", "t†f", "a@", "uv", "nu", "2zZ", "6bG", "oc", "ij", "بتثنيى", "جحخچ", "دذ", "رز", "سش", "صض", "طظ", "عغ", "فق", "هة", "اأإآ", "وؤ", "كگ"]
# Letters that scanners take for two.
SPLIT = {"m": ["rn", "nn", "iii"], "d": ["cl"], "u": ["ii", "li"], "w": ["vv"], "h": ["li", "lı"], "n": ["ri", "ii"], "ü": ["ii"], "k": ["lc"], "q": ["cj"]}
STRAY = "^~·|'`´°*_¦†‡¨\""
HYPHENS = "-‐‑¬­"
_SAME = defaultdict(set)
for _group in CONFUSED:
    for _c in _group:
        _SAME[_c] |= set(_group) - {_c}

_INVISIBLE = re.compile(r"[​-‏‪-‮⁠⁦-⁩﻿]")
_EDGE = "".join(c for c in map(chr, range(0x21, 0x30)) if c not in "'@") + ":;<=>?[]{}«»“”„‘’–—…،؛؟\"|/\\"
_LETTERS = re.compile(r"[^\W\d_]+(?:[-‑][^\W\d_]+)*")
_PAGE = re.compile(r"^[\W_]*(?:(?:page|pages|p|pg|seite|s|pág|página|صفحة|ص)\W{0,3})?(?:\d{1,4}(?:\s*(?:/|of|von|de|sur|من)\s*\d{1,4})?|[ivxlc]{1,7})[\W_]*$", re.I)
_TAIL = re.compile(r"(?:^|\s+[|–—-]?\s*|\s*\|\s*)((?:[\[(—–-]\s*)?(?:(?:page|p|seite|s|pág|página|صفحة)\W{0,3})?\d{1,4}(?:\s*(?:/|of|von|de|sur|من)\s*\d{1,4})?(?:\s*[\])—–-])?|\b[ivxlc]{1,7})\s*$", re.I)
_ROMAN = re.compile(r"^(?=.)c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$", re.I)
_MAIL = re.compile(r"(?:[@＠©]|\(at\)|\[at\])\S{0,200}\.\S")


_OUTER = re.compile(rf"^(?:{_INVISIBLE.pattern})+|(?:{_INVISIBLE.pattern})+$")


def visible(line: str) -> str:
    return " ".join(_INVISIBLE.sub("", line).replace("\xa0", " ").split())


def edge_key(line: str) -> str:
    """A head or foot line without its page number, digits and spelling."""
    text = visible(line).casefold()
    tail = _TAIL.search(text)
    if tail and tail.start() > 0 and not _year(tail[1]):
        text = text[: tail.start()]
    return re.sub(r"\W+", " ", re.sub(r"\d+", "#", text)).strip()


def _year(text: str) -> bool:
    digits = re.sub(r"\D", "", unicodedata.normalize("NFKC", text))
    return len(digits) == 4 and 1900 <= int(digits) < 2100 and not re.search(r"[/\[(—-]|page|p\.", text, re.I)


def page_number(line: str) -> bool:
    text = visible(line)
    if not _PAGE.match(text):
        return False
    core = re.sub(r"[\W\d_]|page|pages|seite|of|von", "", text.casefold())
    return bool(re.search(r"\d", text)) and not text.endswith((".", ",")) or bool(core and _ROMAN.match(re.sub(r"\W", "", text)))


def words_of(line: str) -> list[str]:
    """Tokens between blanks, without punctuation at their edges."""
    return [w for t in _INVISIBLE.sub("", line).split() if (w := t.strip(_EDGE + STRAY))]


def divided(line: str) -> bool:
    text = _INVISIBLE.sub("", line).rstrip()
    return len(text) > 1 and text[-1] in HYPHENS and text[-2].isalpha()


def edges_of(lines: list[str]) -> tuple[list[int], list[int]]:
    """Numbers of the first three and last three lines that are not blank."""
    full = [i for i, x in enumerate(lines) if visible(x)]
    return full[:3], full[-3:][::-1]


def stands_apart(lines: list[str], i: int) -> bool:
    """Whether a line could stand outside the text: no end or middle of a sentence, and no line of full width."""
    text = visible(lines[i])
    if not text or text[-1] in ".,;" + HYPHENS or text[0].islower():
        return False
    widths = sorted(len(visible(x)) for x in lines if visible(x))
    return len(text) <= 0.82 * widths[(9 * len(widths)) // 10] or len(text) > 1.25 * widths[len(widths) // 2] or bool(re.search(r"[|–—]", text))


COUNTS = "kind STRING, doc_id BIGINT, word STRING, skips BOOLEAN"
WORDS = "word STRING, n BIGINT, upper BIGINT"


def corpus_lines(pages: DataFrame) -> DataFrame:
    """Distinct lines of all pages (kind 'line'; ``skips``: the first word is the rest of a divided one) and keys of edge lines.

    Digits are one, so that a page copied under many documents, or a template filled in with numbers, is one set of lines.
    """

    def rows_of(lines: set, rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows + [("line", 0, text, skips) for text, skips in lines], columns=["kind", "doc_id", "word", "skips"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held, rows = set(), []
            for doc, text in zip(batch["doc_id"], batch["raw_text"]):
                lines = text.split("\n")
                top, bottom = edges_of(lines)
                rows += [("top" if i in top else "bottom", doc, k, False) for i in {*top, *bottom} if stands_apart(lines, i) and len(k := edge_key(lines[i])) > 3]
                after = False
                for line in lines:
                    if words_of(line):
                        held.add((re.sub(r"\d", "0", " ".join(line.split())), after))
                        after = divided(line)
                if len(held) + len(rows) > HELD:
                    yield rows_of(held, rows)
                    held, rows = set(), []
            yield rows_of(held, rows)

    found = pages.select("doc_id", "raw_text").mapInPandas(run, COUNTS)
    return found.groupBy("kind", "doc_id", "word", "skips").agg(F.count("*").alias("n"))


def corpus_words(lines: DataFrame) -> DataFrame:
    """Words of distinct lines (word, skips), with how many begin upper case inside a line."""

    def rows_of(words: Counter, upper: Counter) -> pd.DataFrame:
        return pd.DataFrame([(w, n, upper[w]) for w, n in words.items()], columns=["word", "n", "upper"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, upper = Counter(), Counter()
        for batch in batches:
            for line, after in zip(batch["word"], batch["skips"]):
                found, open_ = words_of(line), divided(line)
                for i, w in enumerate(found):
                    if (after and i == 0) or (open_ and i == len(found) - 1):
                        continue
                    for part in re.split(r"['’]", w):
                        if _LETTERS.fullmatch(part):
                            low = part.lower()
                            words[low] += 1
                            upper[low] += i > 0 and part[0].isupper()
            if len(words) > HELD:
                yield rows_of(words, upper)
                words, upper = Counter(), Counter()
        yield rows_of(words, upper)

    return lines.select("word", "skips").mapInPandas(run, WORDS).groupBy("word").agg(F.sum("n").alias("n"), F.sum("upper").alias("upper"))


# Strokes of letters that scanners take for each other; strokes beside each other count once.
STROKES = {"i": "1lIi|!jnuvmhbrw6ıüG", "o": "0ocOQe", "oi": "dgq9", "io": "k", "a": "a@", "t": "t†f", "s": "5sS", "z": "2zZ", "8": "8B", **{g[0]: g for g in CONFUSED if g[0] > "\u0600"}}


def strokes(word: str) -> str:
    """What is left of a word when all confusions are one: words that only confusions and stray marks part have the same."""
    of = {c: k for k, every in STROKES.items() for c in every}
    return re.sub("i+", "i", "".join(of.get(c, c) for c in word if c.isalnum() and c != "ـ" or c in of))


def strokes_of(word: Column) -> Column:
    """``strokes`` without leaving the JVM."""
    many = {k: every for k, every in STROKES.items() if len(k) > 1}
    out = word
    for k, every in many.items():
        out = F.regexp_replace(out, f"[{every}]", k)
    single = "".join(every for k, every in STROKES.items() if len(k) == 1)
    out = F.translate(out, single, "".join(k * len(every) for k, every in STROKES.items() if len(k) == 1))
    return F.regexp_replace(F.regexp_replace(out, r"[^\p{L}\p{N}]|ـ", ""), "i+", "i")


def shorter(word: str, times: int = 1) -> set[str]:
    """The word, and what is left of it without up to so many of its letters."""
    out = {word}
    for _ in range(times):
        out |= {w[:i] + w[i + 1 :] for w in out for i in range(len(w))}
    return out


def shorter_of(word: Column) -> Column:
    """``shorter`` by one letter without leaving the JVM."""
    less = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), F.when(F.length(word) > 0, less).otherwise(F.array().cast("array<string>"))))


def grams(word: str) -> set[str]:
    padded = f"^{word}$"
    return {padded[i : i + 2] for i in range(len(padded) - 1)}


def ocr_cost(a: str, b: str) -> float:
    """Least cost of reading ``b`` as ``a``: 0.3 for confusions and stray marks, 1 for any other edit."""
    n, m = len(a), len(b)
    rows = [[float(j) for j in range(m + 1)]]
    for i in range(1, n + 1):
        row = [rows[i - 1][0] + (0.3 if not a[i - 1].isalnum() else 1.0)]
        for j in range(1, m + 1):
            x, y = a[i - 1], b[j - 1]
            best = rows[i - 1][j - 1] + (0.0 if x == y else 0.3 if y in _SAME[x] else 1.0)
            best = min(best, rows[i - 1][j] + (0.3 if not x.isalnum() or x == "ـ" else 1.0), row[j - 1] + 1.0)
            for two in SPLIT.get(y, ()):
                if i >= len(two) and a[i - len(two) : i] == two:
                    best = min(best, rows[i - len(two)][j - 1] + 0.3)
            if j > 1 and x in SPLIT and b[j - 2 : j] in SPLIT[x]:
                best = min(best, rows[i - 1][j - 2] + 0.3)
            row.append(best)
        rows.append(row)
    return rows[n][m]


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


#: (two or three letters, the letter that a scanner takes for them).
_MERGED = [(two, one) for one, every in SPLIT.items() for two in every]


def misread_once(word: str) -> set[str]:
    """All words that are read as ``word`` by one confusion or with one stray mark."""
    out = {word[:i] + y + word[i + 1 :] for i, x in enumerate(word) for y in _SAME.get(x, ())}
    out |= {word[:i] + word[i + 1 :] for i, x in enumerate(word) if not x.isalnum() or x == "ـ"}
    out |= {word[:i] + one + word[i + len(two) :] for two, one in _MERGED for i in range(len(word)) if word.startswith(two, i)}
    return out | {word[:i] + two + word[i + 1 :] for i, x in enumerate(word) for two in SPLIT.get(x, ()) if len(two) == 2}


def _letter_tables() -> tuple[dict[str, int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code of each letter that can be confused, and of OTHER and MARK; cost of b for a; of leaving a out; number of each
    pair of letters; whether a pair is read for a letter)."""
    known = sorted(set("".join(CONFUSED)) | {c for two, one in _MERGED for c in two + one})
    code = {c: k for k, c in enumerate(known, 1)}
    n = len(known) + 1
    same = np.full((n, n), 10, np.int16)
    for x, near in _SAME.items():
        same[code[x], [code[y] for y in near]] = 3
    pairs = sorted({two for two, _ in _MERGED if len(two) == 2})
    number = np.zeros((n, n), np.int16)
    read = np.zeros((len(pairs) + 1, n), bool)
    for k, two in enumerate(pairs, 1):
        number[code[two[0]], code[two[1]]] = k
        read[k, [code[one] for t, one in _MERGED if t == two]] = True
    return code, same, number, read, np.array([code[c] for c in "im"])


_CODE, _AS, _PAIR, _READ, _IM = _letter_tables()


def _keys(word: str) -> set[tuple[str, str]]:
    """What ``candidates`` looks a word up by."""
    own = grams(word)
    out = {("gram", g) for g in own} | {("strokes", strokes(w)) for w in shorter(word)}
    return out | {("few", w) for w in shorter(word, ERRORS)} if len(own) <= FEW else out


def pair_costs(a: list[str], b: list[str], scanner: bool = True) -> np.ndarray:
    """``ocr_cost``, or not ``scanner`` ``edit_distance``, in tenths, of every pair of words: one table of least costs for all."""
    if not a:
        return np.empty(0, np.int16)
    la, lb = np.array([len(w) for w in a]), np.array([len(w) for w in b])

    def table(words: list[str], width: int) -> np.ndarray:
        out = np.zeros((len(words), width), np.uint32)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(w) for w in words])
        out[np.arange(width) < lengths[:, None]] = points
        return out

    pa, pb = table(a, int(la.max())).T.copy(), table(b, int(lb.max())).T.copy()
    every = np.unique(np.concatenate([pa.ravel(), pb.ravel()]))
    chars = [chr(p) for p in every]
    code = np.array([_CODE.get(c, 0) for c in chars])
    ca, cb = code[np.searchsorted(every, pa)], code[np.searchsorted(every, pb)]
    loose = np.array([3 if scanner and (not c.isalnum() or c == "ـ") else 10 for c in chars], np.int16)
    hard = np.array([3 if scanner and not c.isalnum() else 10 for c in chars], np.int16)
    out_a, hard_a = loose[np.searchsorted(every, pa)], hard[np.searchsorted(every, pa)]
    n, out = len(a), np.zeros(len(a), np.int16)
    rows = [[np.full(n, 10 * j, np.int16) for j in range(len(cb) + 1)]]
    for i in range(1, len(ca) + 1):
        row = [rows[-1][0] + hard_a[i - 1]]
        pair_a = _PAIR[ca[i - 2], ca[i - 1]] if scanner and i > 1 else None
        triple = (ca[i - 3] == _IM[0]) & (ca[i - 2] == _IM[0]) & (ca[i - 1] == _IM[0]) & (pa[i - 1] == pa[i - 2]) if scanner and i > 2 else None
        for j in range(1, len(cb) + 1):
            step = np.where(pa[i - 1] == pb[j - 1], 0, _AS[ca[i - 1], cb[j - 1]] if scanner else 10).astype(np.int16)
            best = np.minimum(rows[-1][j - 1] + step, np.minimum(rows[-1][j] + out_a[i - 1], row[j - 1] + 10))
            if pair_a is not None and pair_a.any():
                best = np.where(_READ[pair_a, cb[j - 1]], np.minimum(best, rows[-2][j - 1] + 3), best)
            if triple is not None and triple.any():
                best = np.where(triple & (cb[j - 1] == _IM[1]), np.minimum(best, rows[-3][j - 1] + 3), best)
            if scanner and j > 1:
                two = _READ[_PAIR[cb[j - 2], cb[j - 1]], ca[i - 1]]
                if two.any():
                    best = np.where(two, np.minimum(best, rows[-1][j - 2] + 3), best)
            row.append(best.astype(np.int16))
        rows = [*rows[-2:], row]
        ends = np.flatnonzero(la == i)
        if len(ends):
            out[ends] = np.stack(row)[lb[ends], ends]
    return out


@dataclass
class Lexicon:
    """The vocabulary with its table of letters and trees; made on the driver, the table built on each worker."""

    counts: dict[str, int]
    ranker: Boosted | None = None
    joiner: Boosted | None = None
    titles: frozenset[str] = frozenset()
    feet: frozenset[str] = frozenset()
    readings: dict[tuple[str, bool], str] = field(default_factory=dict, repr=False)
    _memo: dict | None = field(default=None, repr=False)
    _joins: dict = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        made = ("_words", "_lengths", "_logs", "_grams", "_sizes")
        return {k: v for k, v in self.__dict__.items() if k not in made} | {"_memo": None, "_joins": {}}

    def _build(self) -> None:
        self._words = sorted(self.counts, key=len)
        self._lengths = np.array([len(w) for w in self._words], int)
        self._logs = np.log([self.counts[w] for w in self._words])
        self._memo = {}

    def _retrieve(self, word: str) -> np.ndarray:
        """Places of the candidates of one word: what ``candidates`` gives for many, for training on the driver."""
        if "_grams" not in self.__dict__:
            held: dict[tuple, list[int]] = defaultdict(list)
            for k, w in enumerate(self._words):
                for key in _keys(w):
                    held[key].append(k)
            self._grams = {key: np.array(ks) for key, ks in held.items()}
            self._sizes = np.array([len(grams(w)) for w in self._words])
        own, none = grams(word), np.empty(0, int)
        held = [self._grams.get(("gram", g), none) for g in own]
        places, shared = np.unique(np.concatenate(held), return_counts=True)
        good = (np.abs(self._lengths[places] - len(word)) <= ERRORS) & (shared >= np.maximum(len(own), self._sizes[places]) - FEW)
        return np.unique(np.concatenate([places[good], *(self._grams.get(k, none) for k in _keys(word) if k[0] != "gram")])).astype(int)

    def near(self, words: list[str], hidden: list[str | None] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """(places, costs) of the candidates of each word within COST_LIMIT, the least cost and most frequent first."""
        if self._memo is None:
            self._build()
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, len(words), 500):
            part = words[at : at + 500]
            found = [self._retrieve(w) for w in part]
            owner, places = np.repeat(np.arange(len(part)), [len(f) for f in found]), np.concatenate(found)
            cost = pair_costs([part[k] for k in owner], [self._words[k] for k in places])
            for k, w in enumerate(part):
                left = owner == k
                own, c = places[left], cost[left]
                good = (c <= COST_LIMIT) & np.array([self._words[p] not in (w, hidden[at + k] if hidden else None) for p in own], bool)
                own, c = own[good], c[good]
                order = np.lexsort((own, -self._logs[own], c))
                out.append((own[order], c[order] / 10))
        return out

    def features(self, words: list[str], places: np.ndarray, cost: np.ndarray, upper: list[bool]) -> np.ndarray:
        """A row for each word and the vocabulary word that may be meant."""
        near = [self._words[k] for k in places]
        lengths, memo = self._lengths[places], {w: grams(w) for w in {*words, *near}}
        x = np.empty((len(words), 11))
        x[:, 0], x[:, 1], x[:, 2], x[:, 3], x[:, 4] = cost, pair_costs(words, near, scanner=False) // 10, [len(w) for w in words], lengths, self._logs[places]
        shared = np.array([len(memo[a] & memo[b]) for a, b in zip(words, near)])
        sizes = np.array([len(memo[a]) + len(memo[b]) for a, b in zip(words, near)])
        x[:, 5] = shared / np.maximum(sizes - shared, 1)
        x[:, 6], x[:, 7] = [any(map(str.isdigit, w)) for w in words], [not w.isalnum() for w in words]
        x[:, 8], x[:, 9], x[:, 10] = [a[:1] == b[:1] for a, b in zip(words, near)], upper, cost / lengths
        return x

    def reading(self, word: str, upper: bool) -> str | None:
        """The replacement of a word that is not in the vocabulary, if it has one."""
        return self.readings.get((word, upper))

    def ranked(self, asked: list[tuple[str, bool]], candidates: list[np.ndarray]) -> list[str | None]:
        """The best candidate (by place in the vocabulary) of each word with MISREAD or more, all by one call of the trees."""
        if self._memo is None:
            self._build()
        owner = np.repeat(np.arange(len(asked)), [len(c) for c in candidates])
        places = np.concatenate([*candidates, np.empty(0, int)]).astype(int)
        words = [asked[k][0] for k in owner]
        cost = pair_costs(words, [self._words[k] for k in places])
        good = (cost <= COST_LIMIT) & (cost > 0)
        owner, places, cost = owner[good], places[good], cost[good] / 10
        out: list[str | None] = [None] * len(asked)
        if not len(owner) or not self.ranker:
            return out
        x = self.features([asked[k][0] for k in owner], places, cost, [asked[k][1] for k in owner])
        p = self.ranker.probability(x)
        # the most probable, then the nearest and most frequent
        order = np.lexsort((places, -self._logs[places], cost, -p, owner))
        firsts = order[np.flatnonzero(np.diff(owner[order], prepend=-1))]
        for k in firsts[p[firsts] >= MISREAD]:
            out[owner[k]] = self._words[places[k]]
        return out

    def join_features(self, first: str, second: str, mark: str, upper: bool) -> list[float]:
        n = lambda w: math.log1p(self.counts.get(w, 0))
        return [n(first + second), n(f"{first}-{second}"), n(first), n(second), mark == "-", upper, len(first), len(second)]

    def goes_on(self, first: str, second: str, mark: str, upper: bool) -> bool:
        """Whether a word divided by ``mark`` goes on with ``second`` only because the line ended."""
        if upper and not first.isupper():
            return False
        low, rest = first.lower(), second.lower()
        if low + rest not in self.counts and f"{low}-{rest}" not in self.counts:
            # a word of neither kind: divided if its halves are no words, or if it is a misread one
            whole = self.reading(low + rest, False)
            return mark != "-" or whole is not None or low not in self.counts or rest not in self.counts
        key = (low, rest, mark == "-", upper)
        if key not in self._joins:
            if len(self._joins) > 200_000:
                self._joins.clear()
            self._joins[key] = float(self.joiner.probability(np.array([self.join_features(low, rest, mark, upper)]))[0]) >= JOINED
        return self._joins[key]


def corrupted(word: str, rng: np.random.Generator) -> str:
    """A word as a scanner may read it: one confusion or two, or a stray mark."""
    for _ in range(1 + (rng.random() < 0.15)):
        if len(word) < 2:
            break
        i = int(rng.integers(len(word)))
        c, kind = word[i], rng.random()
        if kind < 0.15:
            i = max(1, i)
            word = word[:i] + STRAY[int(rng.integers(6))] + word[i:]
        elif kind < 0.4 and (spots := [k for k, x in enumerate(word) if x in SPLIT]):
            i = spots[int(rng.integers(len(spots)))]
            word = word[:i] + SPLIT[word[i]][0] + word[i + 1 :]
        elif spots := [k for k, x in enumerate(word) if _SAME.get(x)]:
            i = spots[int(rng.integers(len(spots)))]
            same = sorted(_SAME[word[i]])
            word = word[:i] + same[int(rng.integers(len(same)))] + word[i + 1 :]
        else:
            word = word[:i] + c + word[i + 1 :]
    return word.lower()


def _flat(rows: list[tuple[str, np.ndarray, np.ndarray, bool]]) -> tuple[list[str], np.ndarray, np.ndarray, list[bool]]:
    """A row for each candidate."""
    return [w for w, p, _, _ in rows for _ in p], np.concatenate([p for _, p, _, _ in rows]), np.concatenate([c for _, _, c, _ in rows]), [u for _, p, _, u in rows for _ in p]


def learn(counts: dict[str, int], other: dict[str, bool], titles: frozenset[str], feet: frozenset[str]) -> Lexicon:
    """The lexicon with trees trained on vocabulary words and on ``other`` words (word: upper case inside lines)."""
    rng = np.random.default_rng(SEED)
    plain = sorted(counts, key=lambda w: -counts[w])
    # frequent misreadings of still more frequent words leave the vocabulary
    wrong = set()
    for w in plain:
        if len(w) >= 3:
            if any(c != w and c not in wrong and counts.get(c, 0) >= CONFUSED_RATIO * counts[w] for c in misread_once(w)):
                wrong.add(w)
    lexicon = Lexicon({w: n for w, n in counts.items() if w not in wrong}, titles=titles, feet=feet)
    words = [w for w in plain if w not in wrong]
    chosen = [words[k] for k in rng.permutation(len(words))[:TRAINING_WORDS]]
    rows: list[tuple[str, np.ndarray, np.ndarray, bool]] = []
    y: list[bool] = []
    long = [w for w in chosen if len(w) >= 2]
    read = [(corrupted(w, rng), w) for w in long]
    read = [(r, w) for r, w in read if r != w and r not in lexicon.counts]
    for (r, w), (places, cost) in zip(read, lexicon.near([r for r, _ in read])):
        right = np.array([lexicon._words[k] == w for k in places], bool)
        taken = right | (np.cumsum(~right) <= TRAINING_NEAR)
        rows.append((r, places[taken], cost[taken], False))
        y += right[taken].tolist()
    for w, (places, cost) in zip(long, lexicon.near(long, hidden=long)):
        rows.append((w, places[:3], cost[:3], False))
        y += [False] * len(places[:3])
    rare = [w for w, upper in sorted(other.items())[:TRAINING_WORDS] if upper]
    for w, (places, cost) in zip(rare, lexicon.near(rare)):
        rows.append((w, places[:3], cost[:3], True))
        y += [bool(c <= 0.3 and rng.random() < 0.5) for c in cost[:3]]
    x = lexicon.features(*_flat(rows)) if y else np.empty((0, 11))
    if len(set(y)) == 2:
        lexicon.ranker = Boosted().fit(np.array(x, float), np.array(y, float))
    x, y = [], []
    for w in chosen:
        if "-" in w:
            a, b = w.split("-", 1)
            x += [lexicon.join_features(a, b, "-", False)] * 3
            y += [False] * 3
        elif len(w) >= 4:
            k = int(rng.integers(2, len(w) - 1))
            x.append(lexicon.join_features(w[:k], w[k:], HYPHENS[int(rng.integers(5))], False))
            y.append(True)
    for a, b in zip(chosen, chosen[1:]):
        x.append(lexicon.join_features(a, b, "-", False))
        y.append(False)
    lexicon.joiner = Boosted(rounds=30).fit(np.array(x, float), np.array(y, float)) if len(set(y)) == 2 else None
    return lexicon


def fit(pages: DataFrame) -> tuple[Lexicon, DataFrame]:
    """(lexicon, keys (doc_id, keys) of lines that come back at the edges of a document's pages)."""
    counts = cut(corpus_lines(pages))
    words = cut(corpus_words(counts.where("kind = 'line'")))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(WORD_COUNT, WORD_SHARE * total)
    vocabulary = {r["word"]: r["n"] for r in words.where(F.col("n") >= least).select("word", "n").toLocalIterator()}
    rare = words.where((F.col("n") < least) & (F.length("word") >= 3))
    share = min(1.0, 4 * TRAINING_WORDS / max(rare.count(), 1))
    spot = F.xxhash64("word") / F.lit(2.0**64) + 0.5
    other = {r["word"]: r["upper"] >= 0.8 * r["n"] for r in rare.where(spot <= share).orderBy(F.xxhash64("word")).limit(TRAINING_WORDS).collect()}
    edges = counts.where("kind <> 'line'")
    documents = pages.select("doc_id").distinct().count()
    common = edges.groupBy("kind", "word").agg(F.countDistinct("doc_id").alias("docs")).where(F.col("docs") >= max(EDGE_COUNT, EDGE_SHARE * documents))
    kept = {"top": set(), "bottom": set()}
    for r in common.toLocalIterator():
        kept[r["kind"]].add(r["word"])
    lexicon = learn(vocabulary, other, frozenset(kept["top"]), frozenset(kept["bottom"]))
    back = edges.where("n >= 2").groupBy("doc_id").agg(F.collect_set(F.concat_ws(":", "kind", "word")).alias("keys"))
    return lexicon, back


class Page:
    """One page's lines with their kinds and corrections."""

    def __init__(self, lexicon: Lexicon, number: int, text: str, back: set[str]):
        self.lexicon, self.lines = lexicon, text.split("\n")
        self.kinds: list[set[str]] = [set() for _ in self.lines]
        self.fixed: list[list[str]] = [[] for _ in self.lines]
        self._furniture(number, back)
        self._words()

    def _titled(self, key: str) -> bool:
        memo = self.lexicon._joins
        if key not in memo:
            memo[key] = self._is_title(key)
        return memo[key]

    def _is_title(self, key: str) -> bool:
        base = re.sub(r"( #)+$", "", key)
        if base in self.lexicon.titles or key in self.lexicon.titles:
            return True
        return any(abs(len(t) - len(base)) <= 2 and len(base) > 8 and ocr_cost(base, t) <= 1.2 for t in self.lexicon.titles if t[:2] == base[:2] or t[-3:] == base[-3:])

    def _furniture(self, number: int, back: set[str]) -> None:
        full = [i for i, x in enumerate(self.lines) if visible(x)]
        if not full:
            return
        # from the top: page numbers and heads, until the text or the title begins
        heads = 0
        for at, i in enumerate(full[:3]):
            line = self.lines[i]
            if page_number(line) and at < 2:
                self.kinds[i].add("page_number")
                continue
            text, key = visible(line), edge_key(line)
            tail = _TAIL.search(text)
            numbered = bool(tail) and tail.start() > 0 and not _year(tail[1]) and not text.endswith((".", ","))
            if tail and not re.search(r"\d", tail[1]):
                numbered = numbered and bool(_ROMAN.match(tail[1].strip())) and bool(re.search(r"(?:\||\s{2,})\s*[ivxlc]+\s*$", _INVISIBLE.sub("", line).replace("\xa0", " ").rstrip() + "", re.I))
            known = self._titled(key) or self._titled(re.sub(r"\W+", " ", re.split(r"\s[–—-]\s", text.casefold())[0]).strip())
            dated = bool(re.search(r"(?:^|\s)(?:19|20)\d\d\s*$", unicodedata.normalize("NFKC", text[: tail.start()] if numbered else text)))
            placed = bool(re.search(r"\s[–—]\s+[^\W\d_]+$", text[: tail.start()] if numbered else text))
            if heads or not (known or f"top:{key}" in back) or not stands_apart(self.lines, i):
                break
            following = visible(self.lines[full[at + 1]]) if at + 1 < len(full) else ""
            titled = self._titled(edge_key(following)) and len(following) < 60
            if number > 1 or f"top:{key}" in back or numbered or dated or placed or titled:
                self.kinds[i].add("running_head")
                if numbered:
                    self.kinds[i].add("page_number")
                heads += 1
                continue
            break
        # from the bottom
        for at, i in enumerate(full[::-1][:3]):
            if self.kinds[i]:
                break
            line = self.lines[i]
            text, key = visible(line), edge_key(line)
            if page_number(line):
                self.kinds[i].add("page_number")
                continue
            if (f"bottom:{key}" in back or key in self.lexicon.feet) and stands_apart(self.lines, i):
                self.kinds[i].add("running_head")
                tail = _TAIL.search(text)
                if tail and re.search(r"[|]|[—\[]\s*\d|page", text, re.I) and re.search(r"\d", tail[1]):
                    self.kinds[i].add("page_number")
                continue
            break

    def _fix(self, token: str, first: bool) -> str | None:
        """The right reading of a wrongly recognised token, or None."""
        counts = self.lexicon.counts
        core = token.strip(_EDGE)
        if not core or core.lower() in counts or _MAIL.search(token):
            return None
        out, wrong = [], False
        for part in re.split(r"(['’-])", core) if not any(c in core for c in STRAY.replace("'", "")) else [core]:
            low = part.lower()
            if not part or part in "'’-" or low in counts or not any(c.isalpha() for c in part):
                out.append(part)
                continue
            bare = _INVISIBLE.sub("", low).replace("­", "").replace("ـ", "")
            marked = re.sub(rf"(?<=\w)[{re.escape(STRAY)}](?=\w)", "", bare)
            if bare != low and bare in counts or marked != bare and marked in counts:
                out.append(_cased(marked, part))
                wrong = True
                continue
            digits = sum(c.isdigit() for c in part)
            if digits and (digits > max(2, len(part) // 2) or re.fullmatch(r"\d+(?:st|nd|rd|th|er|e|º|ª)?", low)):
                out.append(part)
                continue
            better = self.lexicon.reading(bare, part[:1].isupper() and not first)
            if better is not None:
                out.append(_cased(better, part))
                wrong = True
            else:
                out.append(part)
        joined = "".join(out)
        if not wrong and "'" in core:
            # an apostrophe inside a word that needs none is a stray mark
            bare = core.replace("'", "").lower()
            if bare in counts and core.lower().split("'")[-1] not in counts:
                return bare
        return joined if wrong else None

    def _words(self) -> None:
        counts, open_ = self.lexicon.counts, None
        for i, line in enumerate(self.lines):
            if self.kinds[i] & {"running_head", "page_number"}:
                continue
            tokens = line.replace("\xa0", " ").split()
            hidden = _INVISIBLE.search(line) is not None
            bare = [_INVISIBLE.sub("", t) for t in tokens] if hidden else tokens
            if not any(bare):
                continue
            fixed, k = list(tokens), 0
            start = 0
            if open_ is not None:
                self._rejoin(*open_, i, tokens)
                start = 1
            open_ = None
            cores = [b.strip(_EDGE) for b in bare]
            ends = divided(line)
            if ends:
                last = bare[-1] if bare[-1] else next(t for t in bare[::-1] if t)
                nxt = next((j for j in range(i + 1, len(self.lines)) if visible(self.lines[j]) and not self.kinds[j] & {"running_head", "page_number"}), None)
                tail = last[:-1].strip(_EDGE + "'")
                following = self.lines[nxt].split()[0] if nxt is not None and self.lines[nxt].split() else ""
                following = _INVISIBLE.sub("", following).strip(_EDGE)
                if re.search(r"[@＠\d]", last):
                    pass
                elif not following:
                    if tail.lower() not in counts:
                        self.kinds[i].add("hyphen")
                else:
                    head = re.split(r"['’]", tail)[-1]
                    self.lexicon.reading(head.lower() + following.lower(), False)
                    rest = re.match(r"[^\s.,;:!?)]+", following)
                    if head and rest and self.lexicon.goes_on(head, rest[0], last[-1], rest[0][0].isupper()):
                        self.kinds[i].add("hyphen")
                        open_ = (i, head)
                    elif head:
                        open_ = None
            end = len(tokens) - ends
            k = start
            while k < end:
                # letters set apart
                run = k
                while run < end and len(cores[run]) == 1 and (cores[run].isalnum() or run > k):
                    run += 1
                    if bare[run - 1][-1:] in ".,;:":
                        break
                if run - k >= 3:
                    stop = run
                    shown = "".join(cores[k:stop])
                    whole = self._closed_up(shown.lower())
                    if whole:
                        self.kinds[i].add("misread")
                        fixed[k] = _cased(whole, shown)
                        fixed[k + 1 : stop] = [""] * (stop - k - 1)
                        k = stop
                        continue
                low = cores[k].lower()
                if not hidden and (not low or low in counts):  # nothing of it to mend
                    k += 1
                    continue
                if k + 1 < end and low.isalpha() and bare[k].isalpha() and low not in counts:
                    both = low + cores[k + 1].lower()
                    if both in counts and cores[k + 1].lower() not in counts:
                        self.kinds[i].add("misread")
                        fixed[k], fixed[k + 1] = _cased(both, bare[k]), ""
                        k += 2
                        continue
                better = self._fix(_strip_edges(tokens[k]) if hidden else tokens[k], k == 0)
                if better is not None:
                    self.kinds[i].add("misread")
                    fixed[k] = re.sub(re.escape(cores[k]), lambda _: better, bare[k], count=1)
                k += 1
            self.fixed[i] = [t for t in fixed if t]

    def _closed_up(self, letters: str) -> str | None:
        """Letters set apart, as one word or two, or None if they are none."""
        counts = self.lexicon.counts
        if letters in counts:
            return letters
        for k in range(2, len(letters) - 1):
            if letters[:k] in counts and letters[k:] in counts:
                return f"{letters[:k]} {letters[k:]}"
        return self.lexicon.reading(letters, False)

    def _rejoin(self, i: int, head: str, j: int, tokens: list[str]) -> None:
        """Marks the lines that hold the wrong letters of a divided word."""
        first = next((t for t in tokens if _INVISIBLE.sub("", t)), "")
        head, rest = head.lower(), _INVISIBLE.sub("", first).strip(_EDGE).lower()
        if head + rest in self.lexicon.counts:
            return
        better = self.lexicon.reading(head + rest, False)
        if better is None:
            return
        costs = [(ocr_cost(head, better[:k]), ocr_cost(rest, better[k:])) for k in range(max(1, len(head) - 1), min(len(better), len(head) + 2))]
        if costs:
            own, following = min(costs, key=sum)
            if own > 0:
                self.kinds[i].add("misread")
            if following > 0:
                self.kinds[j].add("misread")

    def paragraphs(self) -> list[str]:
        """Continuous text: furniture left out, divided words joined, misread words replaced."""
        out, current, glue = [], "", False
        for i, line in enumerate(self.lines):
            if self.kinds[i] & {"running_head", "page_number"}:
                continue
            if not visible(line):
                if current and not glue:
                    out.append(current)
                    current = ""
                continue
            text = visible(" ".join(self.fixed[i]) or line)
            current = current + text if glue else f"{current} {text}".strip()
            glue = "hyphen" in self.kinds[i]
            if glue:
                current = current.rstrip(HYPHENS + " ")
        return [*out, current] if current else out


def _cased(word: str, like: str) -> str:
    """``word`` in the case of the token that it replaces."""
    if like.isupper() and len(like) > 1:
        return word.upper()
    return word[:1].upper() + word[1:] if like[:1].isupper() else word


def _strip_edges(token: str) -> str:
    """A token without invisible characters at its edges; those inside stay, as they are gaps in a word."""
    return _OUTER.sub("", token)


LINES = "doc_id BIGINT, page_number INT, line_no INT, kind STRING"
TEXTS = "doc_id BIGINT, page_number INT, paragraph INT, text STRING"


class Asking(dict):
    """Readings that note what is asked for and know none."""

    def get(self, key, default=None):
        self[key] = None
        return default


def read_page(lexicon: Lexicon, number: int, text: str, back: set[str]) -> Page:
    """One page by itself, its words looked up here."""
    asking = Asking()
    Page(replace(lexicon, readings=asking), number, text, back)
    asked = [key for key in asking if LEAST_WORD <= len(key[0]) <= LONGEST]
    if lexicon._memo is None:
        lexicon._build()
    found = lexicon.ranked(asked, [lexicon._retrieve(w) for w, _ in asked])
    return Page(replace(lexicon, readings={key: b for key, b in zip(asked, found) if b is not None}), number, text, back)


ASKED = "doc_id BIGINT, page_number INT, word STRING, upper BOOLEAN"
READ = "word STRING, upper BOOLEAN, better STRING"
#: Pairs of words and candidates that are judged together.
TOGETHER = 20_000


def _asked(pages: DataFrame, lexicon: Broadcast) -> DataFrame:
    """(doc_id, page_number, word, upper) of every word that a page needs the reading of."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, number, text, keys in zip(batch["doc_id"], batch["page_number"], batch["raw_text"], batch["keys"]):
                asking = Asking()
                Page(replace(lexicon.value, readings=asking), number, text, set(keys) if keys is not None else set())
                rows += [(doc, number, word, upper) for word, upper in asking if LEAST_WORD <= len(word) <= LONGEST]
            yield pd.DataFrame(rows, columns=["doc_id", "page_number", "word", "upper"])

    return pages.mapInPandas(run, ASKED)


def candidates(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, place) of vocabulary words (word, place) within COST_LIMIT of a word, and others, by inverted joins.

    The limit has room for one error that is no confusion beside confusions, or for ERRORS without: words that one letter
    of each and confusions part have the same strokes without these letters; others share all bigrams but three for each
    error, or, where that may be none, what is left without ERRORS letters. So no word within the limit is missed.
    """
    bigrams = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("^"), w, F.lit("$")), i, F.lit(2))))
    word = F.col("word")
    own, known = words.withColumn("grams", bigrams(word)), vocabulary.withColumn("grams", bigrams(word))
    near = known.select("place", F.length(word).alias("length"), F.size("grams").alias("size"), F.explode("grams").alias("gram"))
    each = own.select("word", F.explode(F.sequence(F.length(word) - ERRORS, F.length(word) + ERRORS)).alias("length"), "grams").select("word", "length", F.size("grams").alias("own"), F.explode("grams").alias("gram"))
    met = each.join(near, ["gram", "length"]).groupBy("word", "place").agg(F.count("*").alias("shared"), F.first("own").alias("own"), F.first("size").alias("size"))
    by_grams = met.where(F.col("shared") >= F.greatest("own", "size") - FEW).select("word", "place")
    marked = F.transform(shorter_of(word), lambda w: F.concat(F.lit("strokes "), strokes_of(w)))
    twice = F.transform(F.flatten(F.transform(shorter_of(word), shorter_of)), lambda w: F.concat(F.lit("few "), w))
    keys = F.explode(F.array_distinct(F.when(F.size("grams") <= FEW, F.concat(marked, twice)).otherwise(marked)))
    by_keys = own.select("word", keys.alias("key")).join(known.select("place", keys.alias("key")), "key").select("word", "place")
    return by_grams.union(by_keys).distinct()


def _readings(asked: DataFrame, lexicon: Broadcast) -> DataFrame:
    """(word, upper, better) of the distinct words asked for that have a right reading; every word is judged once."""
    spark = asked.sparkSession
    words = sorted(lexicon.value.counts, key=len)
    vocabulary = spark.createDataFrame(list(zip(words, range(len(words)))) or [], "word STRING, place INT")
    each = asked.groupBy("word").agg(F.collect_set("upper").alias("uppers"))
    near = candidates(each.select("word"), vocabulary).groupBy("word").agg(F.collect_list("place").alias("places"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            wanted, places, held = [], [], 0
            rows = [(w, u, np.sort(p)) for w, us, p in zip(batch["word"], batch["uppers"], batch["places"]) for u in us]
            out = []
            for k, (w, u, p) in enumerate(rows, 1):
                wanted.append((w, bool(u)))
                places.append(p)
                held += len(p)
                if held >= TOGETHER or k == len(rows):
                    out += [(*a, b) for a, b in zip(wanted, lexicon.value.ranked(wanted, places)) if b is not None]
                    wanted, places, held = [], [], 0
            yield pd.DataFrame(out, columns=["word", "upper", "better"])

    return each.join(near, "word").mapInPandas(run, READ)


LINES = "doc_id BIGINT, page_number INT, line_no INT, kind STRING"
TEXTS = "doc_id BIGINT, page_number INT, paragraph INT, text STRING"


def _pages(pages: DataFrame, schema: str, build) -> DataFrame:
    base = pages.where("raw_text IS NOT NULL").select("doc_id", "page_number", "raw_text").distinct()
    lexicon, back = fit(base)
    shared = base.sparkSession.sparkContext.broadcast(lexicon)
    known = cut(spread(base.join(back, "doc_id", "left")))
    asked = cut(_asked(known, shared).distinct())
    read = asked.join(_readings(asked, shared), ["word", "upper"])
    read = read.groupBy("doc_id", "page_number").agg(F.collect_list(F.struct("word", "upper", "better")).alias("readings"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, number, text, keys, found in zip(batch["doc_id"], batch["page_number"], batch["raw_text"], batch["keys"], batch["readings"]):
                own = replace(shared.value, readings={(r["word"], r["upper"]): r["better"] for r in found} if found is not None else {})
                rows += [(doc, number, *r) for r in build(Page(own, number, text, set(keys) if keys is not None else set()))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return known.join(read, ["doc_id", "page_number"], "left").mapInPandas(run, schema)


def noisy_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, line_no, kind) of pages (doc_id, page_number, raw_text)."""
    return _pages(pages, LINES, lambda page: [(i + 1, k) for i, kinds in enumerate(page.kinds) for k in sorted(kinds)]).distinct()


def paragraphs(pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, paragraph, text): the pages' text repaired into continuous paragraphs."""
    return _pages(pages, TEXTS, lambda page: list(enumerate(page.paragraphs(), 1))).distinct()
