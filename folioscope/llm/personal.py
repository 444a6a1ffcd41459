"""Personal information in free text: found, typed and replaced.

Generators of high recall propose overlapping spans: anything written like a mail address, a number of any grouping,
a street line, labelled lines, every run of capitalised words and pairs of Arabic words. Boosted trees judge every
proposal by its format and by the words around it, and calibrated thresholds of each type select. The trees are trained
on a bounded sample of pages, on proposals of which something else than the trees tells what they are: a value extracted
from the same page, a check digit, a printed label, the word before. A part of the pages is held out, and on it the
threshold of each type is set. Of overlapping proposals the most probable stays. Given names are learnt from labelled
lines of passports.

Defined results: null and blank texts have no items; positions count characters of the text as it is, invisible ones
included; items may run over a line end; digits of any script count; titles and labels are no part of an item.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.boosting import Boosted
from folioscope.llm.names import SHORT, TITLES, FORMS, folded
from folioscope.plans.materialize import cut

TYPES = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME")
#: Pages that the trees are trained on, at most.
TRAINING_PAGES = 1500
#: Share and least number with which a word is a known given name (of those labelled so, or of all in labelled names),
#: and a common word; at most 1 / share words each.
LEAST = {"given": (5e-4, 2), "named": (4e-3, 4), "word": (1e-5, 5)}
#: Extracted values of those pages that tell of proposals, at most.
TRAINING_VALUES = 30_000
#: Proposals that something tells to be items, and not to be, that trees need; on fewer what tells decides itself.
LEAST_CASES = 40
#: Every so manieth page is held out for the thresholds; these are tried, the first suits types without held-out cases.
HELD_OUT, THRESHOLDS = 4, (0.5, 0.1, 0.2, 0.3, 0.4, 0.6, 0.7, 0.8, 0.9)
#: Words that a task counts before it passes them on.
HELD = 300_000

_INVISIBLE = re.compile(r"[­​-‏‪-‮⁠⁦-⁩﻿ـ]")
_CAP = r"[A-ZÀ-ÖØ-Þ][^\W\d_]*(?:[-'’]\n?[^\W\d_]+)*"
_S = r"[ \n]{1,3}"

# Words before a number that say what it is.
PHONE_CUES = "tel telefon teléfono telefono téléphone phone fon mobile ring call on unter au al contact noted rückruf llamar rappeler joindre الرقم على هاتف اتصال ☎ e-mail mail"
ID_CUES = "card carte tarjeta ausweis ausweisnummer passport pièce documento document dokument number no nummer numéro número بطاقة البطاقة رقم هوية insurance numero id"
OTHER_CUES = "order lot los lote vorgang commande pedido article artikel artículo meter zähler compteur contador file ticket bon invoice facture factura rechnung article costs read stand indiquait marcaba الطلب الدفعة العداد إيصال فاتورة قراءة سجل date fecha datum datum: geboren birth nacimiento né née الميلاد page seite"
_PHONE, _ID, _OTHER = (frozenset(x.split()) for x in (PHONE_CUES, ID_CUES, OTHER_CUES))

_MAIL = re.compile(
    r"(?<![A-Za-z0-9._+\-])[A-Za-z0-9][A-Za-z0-9._+\-]{0,63}(?:[@＠©]|\((?:at|AT)\)|\[(?:at|AT)\]| [@＠©] | ?\[(?:at|AT)\] ?| ?\((?:at|AT)\) ?)[A-Za-z0-9\-]+(?:(?:\.| ?[\[(](?:dot|DOT)[\])] ?)[A-Za-z0-9\-]+)*(?:\.| ?[\[(](?:dot|DOT)[\])] ?)[A-Za-z]{2,}"
)
# Ways that telephone numbers are written, and identity numbers.
PHONES = [
    r"\+\d{1,3}[ \n]?(?:\(0\))?[\d \n/.()-]{6,16}\d", r"00\d{2}[-. \n]\d{1,4}(?:[-. \n]\d{2,5}){1,4}", r"\(\d{3}\)[ \n]{0,2}\d{3}[-. \n]\d{4}", r"\d{3}\.\d{3}\.\d{4}", r"0\d{2,4}[ \n]{0,2}/[ \n]{0,2}\d{3,6}(?:[- \n]\d{2,4}){0,2}",
    r"0\d{4}[ \n]{1,2}\d{6}", r"0\d{3}[ \n]{1,2}\d{3}[ \n]{1,2}\d{4}", r"0\d{10}", r"0\d(?:[ \n.]{1,2}\d{2}){4}", r"\d{3}[ \n-]{1,2}\d{4}[ \n]{1,2}(?:ext|x|Durchwahl|poste)\.?[ \n]{0,2}\d{1,4}", r"\d{3}-\d{3}-\d{4}",
]
IDS = [
    r"[23]\d{6}[ \n-]{0,2}\d{2}[ \n-]{0,2}\d{5}", r"[23][ \n]{1,2}\d{6}[ \n]{1,2}\d{2}[ \n]{1,2}\d{5}", r"[A-Z]{2}[ \n-]{0,2}\d{2}[ \n-]{0,2}\d{2}[ \n-]{0,2}\d{2}[ \n-]{0,2}[A-D]", r"\d{3}[- \n]{1,2}\d{2}[- \n]{1,2}\d{4}", r"[A-Z]{1,2}\d{7,8}",
]
_NUMBER = re.compile(r"(?<![\w])[+(]?\d[\d \n()./-]{4,22}\d(?![\w])")
_PHONES = [re.compile(rf"(?<![\w+/.-])(?:{p})(?![\w])(?![-/.]\d)") for p in PHONES]
_IDS = [re.compile(rf"(?<![\w/.+-])(?:{p})(?![\w])(?![-/.]\d)") for p in IDS]
_DATE = re.compile(r"^(?:\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}[./-]\d{1,2}[./-]\d{1,2}(?:[ \n].*)?|\d{4}|[\d \n]+\.\d{2}|\d+[.,]\d+)$")

_STREET_LATIN = r"(?:Street|St|Str|Road|Rd|Avenue|Aven|Ave|Av|Lane|Drive)"
STREETS = [
    rf"(?:(?:Apt|Flat|Unit)\.?{_S}\d+,?{_S})?(?:No\.?{_S})?\d{{1,4}},?{_S}{_CAP}{_S}{_STREET_LATIN}\b",
    rf"\d{{1,4}},?{_S}(?:rue|chemin|avenue|boulevard|place|allée|RUE|CHEMIN|AVENUE){_S}{_CAP}",
    rf"{_CAP}(?:-\n)?(?:weg|straße|strasse|platz|gasse|allee|str\.){_S}(?:Nr\.{_S})?\d{{1,4}}",
    rf"\d{{1,4}}{_S}(?:حارة|حاره|شارع|طريق|ش\.?|ط\.?){_S}[^\W\d_]+",
]
_STREETS = [re.compile(rf"(?<![\w])(?:{p})") for p in STREETS]
_STREET_WORD = re.compile(r"street|road|avenue|\b(?:st|str|rd|av|ave|aven|rue|ch|chem|chemin|r)\b|weg\b|stra(?:ß|ss)e|str\.|platz|pl\.|شارع|شـارع|طريق|حار[ةه]|(?:^|\W)[شط]\.? ", re.I)
_CODE = re.compile(r"(?<!\d)\d{5}(?!\d)")
_TO_CODE = re.compile(r"[^.\n]{0,40}?(?:\n[^.\n]{0,40}?)?(?<!\d)\d{5}(?!\d)")
_TO_TOWN = re.compile(_TO_CODE.pattern + r"(?:[ \n][A-ZÀ-Þ][^\W\d_]+)?")
_TO_END = re.compile(r"[^.\n]{0,60}")
_TOKEN = re.compile(rf"{_CAP}|[؀-ۿ]+")
_CUE = re.compile(r"[^\W\d_]+|☎")
_LETTERS = re.compile(r"[^\W\d_]+")

# Labels of names and addresses on papers.
NAME_LABELS = re.compile(r"^\W*(?:full name|name|nom|nombre|nachname|surname(?: ?/ ?nom)?|given names?|vorname|prénoms?|bill to|à|an|para|الاسم|إلى|الى) *(?:[:：]|$) *", re.I)
ADDRESS_LABELS = re.compile(r"^\W*(?:address|adresse|anschrift|domicilio|dirección|العنوان) *(?:[:：]|$) *", re.I)
_GIVEN_LABEL = re.compile(r"^\W*(?:given names?|vornamen?|prénoms?|nombres)\s*:\s*(.+)$", re.I)
_TITLE = re.compile(r"(?:(?:dr|mr|mrs|ms|miss|prof|eng|ing|herrn?|frau|mme|mlle|sra?|don|doña)\.?[ \n]+|(?:ال|لل|بال)?(?:سيد|سيدة|دكتور|دكتورة|مهندس|مهندسة) +)+", re.I)
_TITLED = re.compile(rf"(?:{_TITLE.pattern})$", re.I)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(what each code point is read as, whether it is left out)."""
    read, out = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool)
    for p in range(0x30000):
        c = chr(p)
        if c.isdecimal():
            read[p] = 48 + unicodedata.decimal(c)
        elif c in "\n\r\f":
            read[p] = 10
        elif c.isspace():
            read[p] = 32
        out[p] = bool(_INVISIBLE.match(c))
    return read, out


_READ, _OUT = _tables()


class View:
    """A text without invisible characters, with ASCII digits and single blanks, and where each character stood."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.flatnonzero(~_OUT[points])
        read = _READ[points[at]]
        blank = read == 32
        edge = blank | (read == 10)
        # blanks go after a blank or a line end, and before a line end
        drop = np.zeros(len(read), bool)
        drop[1:] = blank[1:] & edge[:-1]
        at, read = at[~drop], read[~drop]
        drop = np.zeros(len(read), bool)
        drop[:-1] = (read[:-1] == 32) & (read[1:] == 10)
        self.text = read[~drop].tobytes().decode("utf-32-le", "surrogatepass")
        self.at = [*at[~drop].tolist(), len(text)]


_folded = lru_cache(200_000)(folded)


def _lines_of(text: str) -> list[tuple[int, str]]:
    """Lines and where they begin."""
    out, start = [], 0
    for line in text.split("\n"):
        out.append((start, line))
        start += len(line) + 1
    return out


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    form: int
    told: bool | None  #: what a label, a check rule or the words before say; only trees are trained on it, nothing is decided


@dataclass
class Finder:
    """Words and trees, made on the driver and broadcast."""

    given: frozenset[str]
    common: frozenset[str]
    trees: Boosted | None = None
    thresholds: dict[str, float] | None = None

    def spans(self, text: str, paper: str) -> list[Span]:
        """All proposals."""
        mails = any(c in text for c in "@＠©") or "at)" in text.lower() or "at]" in text.lower()
        out = [Span("EMAIL", m.start(), m.end(), 0, True) for m in _MAIL.finditer(text)] if mails else []
        for form, pattern in enumerate(_PHONES, 1):
            for m in pattern.finditer(text):
                found = m[0]
                first = found.split("\n")[0].rstrip(" /.()-")
                if first != found and sum(c.isdigit() for c in first) >= 9:
                    found = first  # the next line begins with a number of its own
                if 7 <= sum(c.isdigit() for c in found) <= 16:
                    out.append(Span("PHONE", m.start(), m.start() + len(found), form, self._decided(text, m.start(), found, form, "PHONE")))
        for form, pattern in enumerate(_IDS, 1):
            for m in pattern.finditer(text):
                out.append(Span("ID_NUMBER", m.start(), m.end(), form, self._decided(text, m.start(), m[0], form, "ID_NUMBER")))
        for m in _NUMBER.finditer(text):
            # a number in no known way of writing is none, unless a word before it says so
            phone, ident, other = self._cues(text, m.start())
            open_ = max(phone, ident) >= 2 and not other and not _DATE.match(m[0])
            out += [Span(k, m.start(), m.end(), 0, None if open_ else False) for k in ("PHONE", "ID_NUMBER")]
        for form, pattern in enumerate(_STREETS, 1):
            for m in pattern.finditer(text):
                out.append(Span("ADDRESS", m.start(), self._address_end(text, m.end(), form in (2, 3)), form, True))
        lines = _lines_of(text)
        out += self._lines(lines, paper, out)
        out += self._names(text)
        return out

    def _cues(self, text: str, at: int) -> tuple[int, int, int]:
        """Nearness (3 for the last word, 0 for none) of a word for telephones, for identity numbers, for other numbers."""
        words = _CUE.findall(text[max(0, at - 48) : at].lower())[-3:][::-1]
        near = lambda cues: next((3 - k for k, w in enumerate(words) if w in cues), 0)
        return near(_PHONE), near(_ID), near(_OTHER)

    def _decided(self, text: str, at: int, found: str, form: int, kind: str) -> bool | None:
        phone, ident, other = self._cues(text, at)
        if _DATE.match(found) or other > max(phone, ident) or (other and other >= max(phone, ident) and found[0] not in "+("):
            return False
        if kind == "PHONE":
            return True if form in (1, 2, 3, 4, 10) or phone >= 2 else None
        if form <= 2:
            digits = re.sub(r"\D", "", found)
            return True if 1 <= int(digits[3:5]) <= 12 and 1 <= int(digits[5:7]) <= 31 else False
        return True if form == 3 or ident >= 2 else None

    def _address_end(self, text: str, at: int, town_last: bool) -> int:
        code = (_TO_TOWN if town_last else _TO_CODE).match(text, at)
        return code.end() if code else _TO_END.match(text, at).end()

    def _trim(self, line: str, start: int) -> int:
        """After blanks, bullets and titles."""
        m = re.match(r"[\W_]*", line[start:])
        start += m.end() if m and m.end() < len(line) - start else 0
        t = _TITLE.match(line, start)
        return t.end() if t and t.end() < len(line) else start

    def _named(self, line: str) -> bool:
        words = re.findall(r"[^\W\d_]+", line)
        if not 2 <= len(words) <= 6 or re.search(r"\d\d|(?<![^\W\d_])\d|@", line):
            return False
        return any(map(self._known, words)) or not all(w.lower() in self.common for w in words)

    def _lines(self, lines: list[tuple[int, str]], paper: str, before: list[Span]) -> list[Span]:
        """Items that the layout of papers tells: labelled lines, lines after labels, first lines, machine-readable lines."""
        out: list[Span] = []
        full = [(i, at, x) for i, (at, x) in enumerate(lines) if x.strip()]
        taken = {at for at, x in lines for s in before if s.kind == "ADDRESS" and s.told and at <= s.start < at + max(1, len(x))}
        for k, (_, at, line) in enumerate(full):
            if m := re.match(r"\s*(P<[A-Z]{3})([A-Z<]{10,})", line):
                out.append(Span("NAME", at + m.start(2), at + len(line.rstrip(" <")), 9, True))
                continue
            if m := re.match(r"\s*(?=[A-Z0-9<]{25,}\s*$)(?=[^<]*\d)([A-Z0-9]+)", line):
                out.append(Span("ID_NUMBER", at + m.start(1), at + len(line.rstrip()), 9, True))
                continue
            for kind, labels in (("NAME", NAME_LABELS), ("ADDRESS", ADDRESS_LABELS)):
                if not (m := labels.match(line)) or (paper not in ("id_card", "passport", "invoice")):
                    continue
                if line[m.end() :].strip():
                    start = self._trim(line, m.end())
                    if kind == "ADDRESS" or paper == "passport" or not re.search(r"\d\d|@", line[start:]):
                        out.append(Span(kind, at + start, at + len(line.rstrip()), 8, True))
                elif ":" not in line and k + 1 < len(full) and kind == "NAME" and paper == "id_card":
                    _, next_at, following = full[k + 1]
                    start = self._trim(following, 0)
                    out.append(Span("NAME", next_at + start, next_at + len(following.rstrip()), 8, True))
        if paper == "cv" and full and self._named(full[0][2]):
            _, at, line = full[0]
            out.append(Span("NAME", at + self._trim(line, 0), at + len(line.rstrip()), 7, True))
        if paper == "id_card" and len(full) > 1:
            named = [s for s in out if s.kind == "NAME"]
            if not named and self._named(full[1][2]):
                _, at, line = full[1]
                out.append(Span("NAME", at + self._trim(line, 0), at + len(line.rstrip()), 7, True))
            if not any(s.kind == "ADDRESS" and s.form == 8 for s in out):
                for _, at, line in full[1:]:
                    plain = re.sub(r"\D", "", line)
                    letters = sum(c.isalpha() for c in line)
                    if letters >= 4 and plain and len(plain) <= 12 and (_STREET_WORD.search(line) or _CODE.search(line)) and not any(at <= s.start < at + len(line) for s in before if s.kind == "ID_NUMBER" and s.told):
                        out.append(Span("ADDRESS", at + self._trim(line, 0) if line[:1] in " \"'-|" else at, at + len(line.rstrip()), 7, True))
                        break
        if paper in ("invoice", "cv", "letter"):
            for _, at, line in full[:9]:
                if at not in taken and _CODE.search(line) and _STREET_WORD.search(line) and re.search(r"(?<!\d)\d{1,4}(?!\d)", line) and not _MAIL.search(line) and len(line) < 90 and not line.rstrip().endswith("."):
                    out.append(Span("ADDRESS", at + self._trim(line, 0), at + len(line.rstrip()), 6, None))
        return out

    def _known(self, word: str) -> bool:
        low = _folded(word)
        return low in self.given or low in SHORT or low in FORMS

    def _names(self, text: str) -> list[Span]:
        out: list[Span] = []
        tokens = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text)]
        lone = np.ones(len(tokens), bool)  # in no proposal by a known name or an initial

        def joined(a: int, b: int) -> str:
            return text[tokens[a][1] : tokens[b][0]]

        rare = lambda w: len(w) >= 4 and w.lower() not in self.common and not self._known(w)
        k, n = 0, len(tokens)
        while k < n:
            start, end, word = tokens[k]
            arabic = "؀" <= word[0] <= "ۿ"
            gap = lambda j, marks=r"\.?[ \n]{1,2}": j < n and re.fullmatch(marks, joined(j - 1, j)) is not None
            if arabic:
                j = k
                first = tokens[k][2] + tokens[k + 1][2] if folded(word) == "عبد" and gap(k + 1, r"[ \n]{1,2}") else word
                if self._known(first):
                    j = k + (2 if first != word else 1)
                    while j < n and gap(j, r"[ \n]{1,2}") and self._known(tokens[j][2]) and "؀" <= tokens[j][2][0] <= "ۿ":
                        j += 1
                    if gap(j, r"[ \n]{1,2}") and (tokens[j][2].startswith("ال") and (len(tokens[j][2]) >= 6 or tokens[j][2] == "ال")) and tokens[j][2] not in self.common:
                        last = j + 1 if tokens[j][2] == "ال" and j + 1 < n else j
                        out.append(Span("NAME", start, tokens[last][1], 1, True))
                        lone[k : last + 1] = False
                        k = last + 1
                        continue
                k += 1
                continue
            single = len(word) == 1
            if (self._known(word) or single) and not (k and text[start - 1 : start] == "'"):
                j = k + 1
                while gap(j) and (self._known(tokens[j][2]) or len(tokens[j][2]) == 1) and j - k < 3:
                    j += 1
                if gap(j) and rare(tokens[j][2]) and not ("؀" <= tokens[j][2][0] <= "ۿ"):
                    whole = self._known(word) or any(self._known(tokens[i][2]) for i in range(k + 1, j))
                    out.append(Span("NAME", start, tokens[j][1], 2 if whole else 3, True if whole else None))
                    lone[k : j + 1] = False
                    k = j + 1
                    continue
            if rare(word) and gap(k + 1, r", ?\n?") and (self._known(tokens[k + 1][2]) or (len(tokens[k + 1][2]) == 1 and text[tokens[k + 1][1] : tokens[k + 1][1] + 1] in (".", " ", "\n"))):
                j = k + 1
                while gap(j + 1) and (self._known(tokens[j + 1][2]) or len(tokens[j + 1][2]) == 1):
                    j += 1
                follows = gap(j + 1, r"\.? {1,2}") and rare(tokens[j + 1][2])
                if not follows:
                    out.append(Span("NAME", start, tokens[j][1], 4 if self._known(tokens[k + 1][2]) else 5, True if self._known(tokens[k + 1][2]) else None))
                    lone[k : j + 1] = False
                    k = j + 1
                    continue
            k += 1
        # every other run of capitalised words, and pairs of uncommon Arabic words of which the second has the article
        k = 0
        while k < n:
            word = tokens[k][2]
            j = k + 1
            if "؀" <= word[0] <= "ۿ":
                if lone[k] and j < n and lone[j] and tokens[j][2].startswith("ال") and len(tokens[j][2]) >= 6 and word not in self.common and tokens[j][2] not in self.common and joined(k, j) in _GAPS:
                    out.append(Span("NAME", tokens[k][0], tokens[j][1], 11, self._untold(text, tokens[k][0])))
                k += 1
                continue
            while j < n and lone[j] and not ("؀" <= tokens[j][2][0] <= "ۿ") and joined(j - 1, j) in _GAPS:
                j += 1
            if lone[k] and 2 <= j - k <= 4 and not all(w.lower() in self.common for _, _, w in tokens[k:j]):
                out.append(Span("NAME", tokens[k][0], tokens[j - 1][1], 10, self._untold(text, tokens[k][0])))
            k = j
        return out

    def _untold(self, text: str, at: int) -> bool | None:
        """A run without a known name is none, unless a title stands before it."""
        return None if _TITLED.search(text[max(0, at - 24) : at]) else False

    def features(self, text: str, span: Span, paper: str) -> list[float]:
        found = text[span.start : span.end]
        phone, ident, other = self._cues(text, span.start)
        after = _LETTERS.findall(text[span.end : span.end + 24].lower())[:1]
        words = _LETTERS.findall(found) if span.kind == "NAME" else []
        known = sum(map(self._known, words))
        return [
            TYPES.index(span.kind), span.form, len(found), sum(map(str.isdigit, found)), sum(map(str.isalpha, found)), found[0] in "+(", found[0] == "0", found[0] in "23", found.count(" ") + found.count("\n"), found.count("-"), found.count("."), found.count("/"),
            phone, ident, other, bool(_DATE.match(found)), text[max(0, span.start - 2) : span.start].strip() in ("·", "|"), _PLACE.get(paper, 8), bool(after and after[0] in self.common), text[span.start - 1 : span.start] in ("\n", ""),
            known, bool(words) and bool(_TITLED.search(text[max(0, span.start - 24) : span.start])), sum(w.lower() in self.common for w in words), span.kind == "ID_NUMBER" and span.form <= 2 and _dated(found),
        ]

    def chosen(self, texts: list[tuple[str, str]]) -> list[list[Span]]:
        """The items of each text (as viewed, paper); the trees judge the proposals of all together."""
        spans = [self.spans(text, paper) for text, paper in texts]
        rows = [self.features(text, s, paper) for (text, paper), own in zip(texts, spans) for s in own]
        judged = iter(self.trees.probability(np.array(rows, float)) if self.trees and rows else [float(s.told or False) for own in spans for s in own])
        out = []
        for own in spans:
            scored = [(p, s) for s in own if (p := next(judged)) >= (self.thresholds or {}).get(s.kind, THRESHOLDS[0])]
            kept: list[Span] = []
            # of equally probable ones those of labelled lines, then by type, then the longer
            for _, s in sorted(scored, key=lambda x: (-round(x[0], 1), not 6 < x[1].form < 10, _RANK[x[1].kind], -(x[1].end - x[1].start), x[1].start)):
                if all(s.end <= k.start or s.start >= k.end for k in kept):
                    kept.append(s)
            out.append(kept)
        return out

    def items(self, values: list[tuple[str | None, str]]) -> list[list[tuple[str, int, int]]]:
        """(type, start, end) of the items of each text (value, paper), in its own characters.

        Texts that differ in blanks and invisible characters only are one text as viewed, and are searched once.
        """
        views = [View(v) if v and not v.isspace() else None for v, _ in values]
        keys = [(view.text, paper) if view else None for view, (_, paper) in zip(views, values)]
        distinct = list(dict.fromkeys(k for k in keys if k))
        found = dict(zip(distinct, self.chosen(distinct)))
        return [sorted((s.kind, view.at[s.start], view.at[min(s.end, len(view.text)) - 1] + 1) for s in found[k]) if k else [] for view, k in zip(views, keys)]


def _dated(number: str) -> bool:
    """Whether an identity number of fourteen digits holds a month and a day."""
    digits = re.sub(r"\D", "", number)
    return len(digits) == 14 and 1 <= int(digits[3:5]) <= 12 and 1 <= int(digits[5:7]) <= 31


_GAPS = frozenset((" ", "\n", " \n", ". ", ".\n"))
_PLACE = {p: i for i, p in enumerate(("id_card", "passport", "cv", "invoice", "receipt", "letter", "report", "contract"))}
_RANK = {"EMAIL": 0, "ADDRESS": 1, "ID_NUMBER": 2, "PHONE": 3, "NAME": 4}


#: (extractor, field) of extracted values by what they are; None for numbers that are no personal item.
VALUES = {
    ("IDCardExtractor", "name"): "NAME", ("CVExtractor", "name"): "NAME", ("PassportExtractor", "surname"): "NAME", ("PassportExtractor", "given_names"): "NAME", ("IDCardExtractor", "address"): "ADDRESS",
    ("IDCardExtractor", "national_id"): "ID_NUMBER", ("PassportExtractor", "passport_number"): "ID_NUMBER", ("CVExtractor", "email"): "EMAIL", ("CVExtractor", "phone"): "PHONE",
    ("InvoiceExtractor", "invoice_number"): None, ("ReceiptExtractor", "receipt_number"): None, ("InvoiceExtractor", "total"): None, ("ReceiptExtractor", "total"): None,
}


def _bare(text: str) -> str:
    return "".join(c for c in folded(text) if c.isalnum())


def train(finder: Finder, pages: list[tuple[str, str, dict[str, str | None]]]) -> Finder:
    """Trees and thresholds from pages (text, paper, what extracted values are)."""
    x, y, out = [], [], []
    for at, (text, paper, values) in enumerate(pages):
        shown = View(text).text
        for s in finder.spans(shown, paper):
            bare = _bare(shown[s.start : s.end]) if values else ""
            told = values[bare] == s.kind if bare in values else s.told
            if told is None or s.end <= s.start:
                continue
            row = finder.features(shown, s, paper)
            if at % HELD_OUT == HELD_OUT - 1:
                out.append((s.kind, row, told))
                continue
            x.append(row)
            y.append(told)
            # the same without its label: the trees shall not need the words before it
            if s.kind in ("PHONE", "ID_NUMBER") and told and 0 < s.form < 6:
                x.append([*row[:12], 0, 0, *row[14:]])
                y.append(True)
            if s.kind == "NAME" and s.form in (2, 4) and told:
                # one known by its given name alone stands for one with an initial
                x.append([row[0], s.form + 1, *row[2:20], 0, *row[21:]])
                y.append(True)
    if min(sum(y), len(y) - sum(y)) >= LEAST_CASES:
        finder.trees = Boosted().fit(np.array(x, float), np.array(y, float))
        finder.thresholds = _calibrated(finder.trees, out)
    return finder


def _calibrated(trees: Boosted, held_out: list[tuple[str, list[float], bool]]) -> dict[str, float]:
    """The threshold of each type with the best F1 on held-out proposals, of equally good ones the first of THRESHOLDS."""
    p = trees.probability(np.array([row for _, row, _ in held_out], float)) if held_out else np.empty(0)
    kinds, truth = np.array([k for k, _, _ in held_out]), np.array([t for _, _, t in held_out], bool)
    out = {}
    for kind in TYPES:
        own = kinds == kind if len(kinds) else np.empty(0, bool)
        right = truth[own]
        if right.any():
            f1 = [2 * (right & (p[own] >= t)).sum() / max(right.sum() + (p[own] >= t).sum(), 1) for t in THRESHOLDS]
            out[kind] = THRESHOLDS[int(np.argmax(np.round(f1, 6)))]
    return out


COUNTS = "kind STRING, word STRING, n BIGINT"


def fit(pages: DataFrame, fields: DataFrame | None = None) -> Finder:
    """The finder for pages (doc_id, page_number, document_type, raw_text), with the values extracted from them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: Counter = Counter()
            for text in batch["raw_text"]:
                for line in View(text).text.split("\n"):
                    if m := _GIVEN_LABEL.match(line):
                        counts.update(("given", w) for w in re.split(r"[\s<]+", folded(m[1])) if len(w) > 2 or (len(w) == 2 and w > "؀"))
                    elif m := NAME_LABELS.match(line):
                        words = re.findall(r"[^\W\d_]+", folded(line[m.end() :]))
                        counts.update(("named", w) for w in words if (len(w) > 2 or (len(w) == 2 and w > "؀")) and not w.startswith("ال"))
                    counts.update(("word", w) for w in re.findall(r"(?<![^\W\d_])[a-zß-ÿ؀-ۿ][^\W\d_A-Z]+", line))
                if len(counts) > HELD:
                    yield pd.DataFrame([(k, w, n) for (k, w), n in counts.items()], columns=["kind", "word", "n"])
                    counts = Counter()
            yield pd.DataFrame([(k, w, n) for (k, w), n in counts.items()], columns=["kind", "word", "n"])

    base = pages.where("raw_text IS NOT NULL").select("doc_id", "page_number", "document_type", "raw_text")
    counts = cut(base.mapInPandas(run, COUNTS).groupBy("kind", "word").agg(F.sum("n").alias("n")))
    total = {r["kind"]: r["n"] for r in counts.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    least = {k: max(LEAST[k][1], LEAST[k][0] * total.get(k, 0)) for k in LEAST}
    enough = F.coalesce(*(F.when(F.col("kind") == k, F.lit(float(n))) for k, n in least.items()))
    kept: dict[str, set] = {k: set() for k in LEAST}
    for r in counts.where(F.col("n") >= enough).toLocalIterator():
        kept[r["kind"]].add(r["word"])
    kept["given"] |= kept["named"]
    given = {re.sub(r"(.)\1+", r"\1", w) if "؀" <= w[0] <= "ۿ" else w for w in kept["given"]} | kept["given"]
    share = min(1.0, 4 * TRAINING_PAGES / max(base.count(), 1))
    spot = F.xxhash64("raw_text") / F.lit(2.0**64) + 0.5
    sample = cut(base.where(spot <= share).orderBy(F.xxhash64("raw_text"), "doc_id", "page_number").limit(TRAINING_PAGES))
    values: dict[tuple, dict[str, str | None]] = {}
    if fields is not None:
        kind = F.coalesce(*(F.when((F.col("extractor") == e) & (F.col("field_name") == f), F.lit(k or "")) for (e, f), k in VALUES.items()))
        own = fields.select("doc_id", "page_number", kind.alias("kind"), "value").where("kind IS NOT NULL AND value IS NOT NULL").join(sample.select("doc_id", "page_number").distinct(), ["doc_id", "page_number"], "left_semi")
        for r in own.distinct().orderBy(F.xxhash64("value"), "doc_id", "page_number").limit(TRAINING_VALUES).collect():
            if len(bare := _bare(r["value"])) >= 4:
                values.setdefault((r["doc_id"], r["page_number"]), {})[bare] = r["kind"] or None
    rows = [(r["raw_text"], r["document_type"] or "", values.get((r["doc_id"], r["page_number"]), {})) for r in sample.toLocalIterator()]
    return train(Finder(frozenset(given - TITLES), frozenset(kept["word"])), rows)


FIELDS = ("text", "raw_text", "normalized_text")
ITEMS = "doc_id BIGINT, page_number INT, field STRING, pii_type STRING, start_pos INT, end_pos INT"
REDACTED = "doc_id BIGINT, page_number INT, text STRING, raw_text STRING, normalized_text STRING"


def _over(pages: DataFrame, fields: DataFrame | None, schema: str, build: Callable) -> DataFrame:
    shared = pages.sparkSession.sparkContext.broadcast(fit(pages, fields))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            papers = batch["document_type"].fillna("").tolist()
            texts = [[v if isinstance(v, str) else None for v in batch[f]] for f in FIELDS]
            for at in range(0, len(batch), PAGES):
                some = range(at, min(at + PAGES, len(batch)))
                found = iter(shared.value.items([(own[i], papers[i]) for i in some for own in texts]))
                rows = []
                for i in some:
                    rows += build(batch["doc_id"].iloc[i], batch["page_number"].iloc[i], [own[i] for own in texts], [next(found) for _ in FIELDS])
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return pages.select("doc_id", "page_number", "document_type", *FIELDS).mapInPandas(run, schema)


#: Pages that are judged together.
PAGES = 200


def find(pages: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """(doc_id, page_number, field, pii_type, start_pos, end_pos) of every item of the three texts of pages."""

    def build(doc, number, values, found):
        return [(doc, number, f, *item) for f, items in zip(FIELDS, found) for item in items]

    return _over(pages, fields, ITEMS, build).distinct()


def redact(pages: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """The three texts with every item replaced by its type in square brackets, and otherwise unchanged."""

    def build(doc, number, values, found):
        out = []
        for v, items in zip(values, found):
            for kind, start, end in sorted(items, key=lambda x: -x[1]):
                v = f"{v[:start]}[{kind}]{v[end:]}"
            out.append(v)
        return [(doc, number, *out)]

    return _over(pages, fields, REDACTED, build).distinct()
