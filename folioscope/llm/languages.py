"""Language of texts and of the segments of mixed texts, by hyperdimensional profiles.

Every symbol has a random bipolar vector. A trigram is the product of its symbols' vectors, each rolled by its place;
a language's prototype bundles the vectors of its training trigrams, weighted by how much more frequent each is there
than in the other languages. A text is the
bundle of its trigrams, compared with the prototypes by cosine. Bundling is linear, so the product of a text with a
prototype is the sum over its trigrams of their products with it: each distinct trigram is compared once per worker
and remembered, and texts are sums of table rows. The length of a text's vector is the root of the sum of its trigrams'
squared counts, as vectors of different trigrams are orthogonal but for noise of the order of 1 / sqrt(DIMENSIONS).

Defined results: null and blank texts, and texts without letters of a known script, have language null and confidence
0; a text is mixed when two languages each hold whole sentences of it; script is the one of most letters.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 8192
#: Retraining: words of a sample, passes, first step, sharpness of the scores.
WINDOW, EPOCHS, RATE, SHARPNESS = 7, 6, 0.002, 40.0
SEED = 7
#: Share of trigrams under which a trigram says little of a language.
RARE = 2e-5
#: Runs of WINDOW words of labelled texts that prototypes are fitted on, at most, from each table.
TRAINING_RUNS = 24_000
#: Characters of a run, at most; longer ones are no words.
LONGEST = 400
#: Letters a text needs to count for p1_found.
LEAST_LETTERS = 30
#: Letters of whole sentences a second language needs, and their least share, for a text to be mixed.
MIXED_LETTERS, MIXED_SHARE = 18, 0.06
#: Mean margin of cosines (see ``Profiles.segments``) that a segment needs to count as evidence of its own.
SURE = 0.06
#: Softness of confidences.
HEAT = 40.0

# Symbols by place in the table; 0 is a word boundary, 1 any other letter.
LATIN = "abcdefghijklmnopqrstuvwxyzäöüßáàâéèêëíîïóôúùûñçœæ"
ARABIC = "ءآأؤإئابةتثجحخدذرزسشصضطظعغفقكلمنهوىيپچژگکی"
SYMBOLS = LATIN + ARABIC
SIDE = len(SYMBOLS) + 2
# Names and three-letter codes of languages.
NAMES = {
    "en": "en eng english", "de": "de deu ger german deutsch", "fr": "fr fra fre french français francais", "es": "es spa spanish español espanol", "ar": "ar ara arabic العربية عربي",
    "it": "it ita italian", "pt": "pt por portuguese", "nl": "nl nld dut dutch", "fa": "fa fas per persian farsi", "tr": "tr tur turkish", "ru": "ru rus russian",
}
CODES = {name: code for code, names in NAMES.items() for name in names.split()}
UNKNOWN = frozenset({"", "und", "unknown", "unk", "none", "null", "n/a", "na", "?", "-", "--", "xx", "zxx", "other", "auto"})
# Frequent words that carry each language where no labelled text holds them.
COMMON = {
    "en": "the of and to in is that for it was on with as be at by this from are were or have has not which been their more than would could about into can only other when there we you your please",
    "de": "der die das und ist in zu den mit von für auf im nicht ein eine einer eines dem des sich auch als an es werden wurde wird sind aus bei oder nach wie über noch nur einem einen durch wir sie bitte",
    "fr": "le la les de des du et est en un une dans que qui pour pas sur au aux avec ce cette il elle nous vous sont par plus ont été être leur ou mais son ses afin donc",
    "es": "el la los las de del y es en un una que por con para no se su al lo como más fue son ha han entre sobre cuando también pero ser está hasta desde nos esta este",
    "ar": "في من على إلى عن أن التي الذي هذا هذه ما لا كان كانت قد مع بعد قبل ثم أو كل حتى لم لن بين عند غير ذلك هو هي كما حيث",
}

_TAGS = re.compile(r"<[^<>]{1,80}>|&#?\w{2,8};|https?://\S+|(?<!\S)[^\s@＠©(\[]{1,100}(?:[@＠©]|[(\[]at[)\]])\S{1,200}")
_SENTENCE = re.compile(r"(?<=[.!?؟…])[\s\"'»)\]]+|\n\s*\n|(?:\s*<br\s*/?>\s*)+|\s+[/|–—•]\s+")


def _symbol_table() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x3000):
        if unicodedata.category(chr(c))[0] == "L":
            table[c] = 1
    table[0x3000:0x20000] = 1
    for c in range(0x250):
        base = chr(c).lower()
        if len(base) == 1:
            base = base if base in LATIN else unicodedata.normalize("NFKD", base)[:1]
            if base in LATIN and base:
                table[c] = 2 + SYMBOLS.index(base)
    for i, c in enumerate(ARABIC):
        table[ord(c)] = 2 + len(LATIN) + i
    return table


SYMBOL = _symbol_table()
#: Code points inside words that are no letters: marks, tatweel, joiners, soft hyphens.
_INSIDE = np.zeros(0x110000, bool)
_INSIDE[[0xAD, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0xFEFF, 0x640, *range(0x202A, 0x202F), *range(0x2066, 0x206A), *range(0x64B, 0x653), 0x670, *range(0x300, 0x370)]] = True


_WRONG = re.compile("[\u00c2-\u00f4][\u0080-\u00bf\u2018-\u201e\u2020-\u2022\u2013\u2014\u2026\u2030\u2039\u203a\u20ac\u2122\u0160\u0161\u0152\u0153\u017d\u017e\u0178\u0192\u02c6\u02dc]{1,3}")


def _bytes_of(run: str) -> bytes:
    """Bytes that CP1252 shows as ``run``; the five bytes it leaves out, as Latin-1."""
    return b"".join(bytes([ord(c)]) if ord(c) < 256 else c.encode("cp1252") for c in run)


def _mend(match: re.Match) -> str:
    try:
        return _bytes_of(match[0]).decode("utf-8")
    except (UnicodeEncodeError, UnicodeDecodeError):
        return match[0]


def mended(text: str) -> str:
    """Runs of UTF-8 read as CP1252 or Latin-1 by mistake, put right wherever they decode."""
    return _WRONG.sub(_mend, text)


def split(text: str) -> list[str]:
    """Sentences, without markup and addresses."""
    return [s for s in _SENTENCE.split(_TAGS.sub(lambda m: " <br> " if m[0][:3].lower() in ("<br", "<p>", "</p", "<li") else " ", mended(text))) if s and not s.isspace()]


@dataclass
class Profiles:
    """Prototypes, fitted once on the driver; the trigram table fills up on each worker."""

    languages: list[str]
    prototypes: np.ndarray
    letters: np.ndarray
    _table: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return {"languages": self.languages, "prototypes": self.prototypes, "letters": self.letters, "_table": None}

    @classmethod
    def fit(cls, texts: dict[str, Sequence[str]]) -> Profiles:
        rng = np.random.default_rng(SEED)
        letters = rng.choice(np.array([-1, 1], np.int8), (SIDE, DIMENSIONS))
        languages, found = sorted(texts), []
        for language in languages:
            codes, _ = trigrams(list(texts[language]))
            found.append(np.bincount(codes, minlength=SIDE**3) / max(len(codes), 1))
        shares = np.array(found)
        every = shares.mean(0)
        codes = np.flatnonzero(every)
        weights = np.clip(np.log((shares[:, codes] + RARE) / (every[codes] + RARE)), -3, 3) * np.sqrt(every[codes])
        weights = retrained(weights / np.linalg.norm(weights, axis=1).mean(), codes, [windows(texts[language]) for language in languages])
        prototypes = np.zeros((len(languages), DIMENSIONS))
        for at in range(0, len(codes), 2048):
            prototypes += weights[:, at : at + 2048] @ vectors(letters, codes[at : at + 2048])
        return cls(languages, prototypes / np.linalg.norm(prototypes, axis=1, keepdims=True), letters)

    def products(self, codes: np.ndarray) -> np.ndarray:
        """Trigrams times prototypes, in units of a trigram vector's length."""
        if self._table is None:
            self._table = np.full((SIDE**3, len(self.languages)), np.nan, np.float32)
        distinct = np.unique(codes)
        missing = distinct[np.isnan(self._table[distinct, 0])]
        for at in range(0, len(missing), 2048):
            part = missing[at : at + 2048]
            self._table[part] = vectors(self.letters, part) @ self.prototypes.T / np.sqrt(DIMENSIONS)
        return self._table[codes]

    def segments(self, sentences: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(cosine of each sentence with each prototype; its number of letters)."""
        codes, owner, letters = _grams(sentences)
        sums = np.zeros((len(sentences), len(self.languages)))
        if len(codes):
            values = self.products(codes)
            firsts = np.flatnonzero(np.diff(owner, prepend=-1))
            sums[owner[firsts]] = np.add.reduceat(values, firsts, axis=0)
        # the length of the bundle: a trigram that comes n times counts n squared
        each, often = np.unique(owner.astype(np.int64) * SIDE**3 + codes, return_counts=True)
        squares = np.bincount(each // SIDE**3, weights=often.astype(float) ** 2, minlength=len(sentences))
        return sums / np.sqrt(np.maximum(squares, 1))[:, None], letters


def windows(texts: Sequence[str]) -> list[str]:
    """Texts cut into runs of WINDOW words."""
    return [" ".join(words[i : i + WINDOW]) for t in texts for words in [t.split()] for i in range(0, len(words), WINDOW)]


def retrained(weights: np.ndarray, codes: np.ndarray, samples: list[list[str]]) -> np.ndarray:
    """Prototypes corrected: short samples are added to their own and taken from the others, as far as each is misread.

    Done on the weights with which trigrams are bundled, as bundling is linear.
    """
    place = np.full(SIDE**3, -1)
    place[codes] = np.arange(len(codes))
    grams, owner = trigrams([s for own in samples for s in own])
    truth = np.repeat(np.arange(len(samples)), [len(own) for own in samples])
    grams = place[grams]
    firsts = np.flatnonzero(np.diff(owner, prepend=-1))
    sizes, labels = np.diff(np.append(firsts, len(owner))), truth[owner[firsts]]
    rng, weights = np.random.default_rng(SEED), weights.T.copy()
    share = len(labels) / (len(samples) * np.bincount(labels, minlength=len(samples)))
    bounds = np.append(firsts, len(owner))
    for step in range(EPOCHS):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), 512):
            part = order[at : at + 512]
            ids = np.concatenate([grams[bounds[k] : bounds[k + 1]] for k in part])
            scale = np.repeat(1 / np.sqrt(sizes[part]), sizes[part])
            cuts = np.concatenate([[0], np.cumsum(sizes[part])[:-1]])
            score = np.add.reduceat(weights[ids] * scale[:, None], cuts, axis=0) * SHARPNESS
            power = np.exp(score - score.max(1, keepdims=True))
            power /= power.sum(1, keepdims=True)
            power[np.arange(len(part)), labels[part]] -= 1
            step_size = RATE / (1 + step) * share[labels[part]]
            change = np.repeat(power * step_size[:, None], sizes[part], axis=0) * scale[:, None]
            np.add.at(weights, ids, -change)
    return weights.T - weights.T.mean(0)


def vectors(letters: np.ndarray, codes: np.ndarray) -> np.ndarray:
    a, b, c = codes // (SIDE * SIDE), codes // SIDE % SIDE, codes % SIDE
    return (np.roll(letters, 2, 1)[a] * np.roll(letters, 1, 1)[b] * letters[c]).astype(np.float32)


def trigrams(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all trigrams with at least two letters, the text of each)."""
    return _grams(texts)[:2]


def _grams(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``trigrams`` and the number of letters of each text."""
    joined = "\n\n".join(texts) + "\n\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    owner = np.repeat(np.arange(len(texts)), lengths)
    keep = ~_INSIDE[points]
    symbols, owner = SYMBOL[points[keep]].astype(np.int64), owner[keep]
    letters = np.bincount(owner, weights=symbols > 0, minlength=len(texts)).astype(np.int64)
    repeat = np.zeros(len(symbols), bool)
    repeat[1:] = (symbols[1:] == 0) & (symbols[:-1] == 0)
    symbols, owner = symbols[~repeat], owner[~repeat]
    if len(symbols) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64), letters
    a, b, c = symbols[:-2], symbols[1:-1], symbols[2:]
    good = (b > 0) & ((a > 0) | (c > 0)) & (owner[:-2] == owner[1:-1])
    return (a * SIDE * SIDE + b * SIDE + c)[good], owner[1:-1][good], letters


#: Words of addresses and titles that carry no language of a text.
# Fixed values.
STREETS = frozenset("street road avenue rue chemin weg platz straße strasse allee apt flat wohnung whg appt no nr n de la von van dr mr ms mrs e-mail mail tel fax ext".split())
_ARABIC_ADDRESS = re.compile(r"^\W*\d+ [^\d.]+ - [^\d.]+( - \d+)?\W*$")


def bears_language(text: str) -> bool:
    """False for lines of only names, addresses, mail addresses or numbers."""
    plain = _TAGS.sub(" ", text)
    words = [w for w in re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*", plain)]
    if any(0x600 <= ord(w[0]) < 0x700 for w in words):
        return not _ARABIC_ADDRESS.match(plain)
    low = [w for w in words if w[0].islower() and len(w) > 1 and w not in STREETS]
    return bool(low) or (len(words) >= 4 and all(w.isupper() for w in words) and not any(c.isdigit() for c in plain))


def label_set(label: str | None) -> frozenset[str] | None:
    """Languages that a label names; None where it names none."""
    if label is None:
        return None
    text = label.strip().lower().replace("_", "-")
    if text in UNKNOWN:
        return None
    if text in CODES:
        return frozenset({CODES[text]})
    parts = [p for p in re.split(r"[-+/,&; ]+", text) if p]
    named = frozenset(CODES[p] for p in parts if p in CODES)
    return named or frozenset({text})


def decide(profiles: Profiles, texts: Sequence[str | None]) -> list[tuple[str | None, float, int, float]]:
    """(language or two joined by '-', confidence, letters, margin) of each text."""
    sentences, owner = [], []
    for i, text in enumerate(texts):
        for s in split(text) if text else ():
            sentences.append(s)
            owner.append(i)
    out: list[tuple[str | None, float, int, float]] = [(None, 0.0, 0, 0.0)] * len(texts)
    if not sentences:
        return out
    scores, letters = profiles.segments(sentences)
    order = np.argsort(scores, axis=1)
    best = order[:, -1]
    margin = scores[np.arange(len(best)), best] - scores[np.arange(len(best)), order[:, -2]]
    cuts = np.flatnonzero(np.diff(owner, prepend=-1)).tolist() + [len(owner)]
    n = len(profiles.languages)
    for a, b in zip(cuts, cuts[1:]):
        total = int(letters[a:b].sum())
        if not total:
            continue
        weight = np.sqrt(letters[a:b])[:, None]
        joint = (scores[a:b] * weight).sum(0) / np.sqrt(max(total, 1))
        sure = margin[a:b] >= SURE
        held = np.bincount(best[a:b][sure], weights=letters[a:b][sure], minlength=n)
        top = np.argsort(held)
        first, second = top[-1], top[-2]
        if held[second] >= max(MIXED_LETTERS, MIXED_SHARE * held.sum()):
            pair = "-".join(sorted((profiles.languages[first], profiles.languages[second])))
            far = float(margin[a:b][sure & (best[a:b] == second)].max())
            out[owner[a]] = (pair, float(1 / (1 + np.exp(-HEAT * (far - SURE)))), total, far)
            continue
        rank = np.argsort(joint)
        gap = float(joint[rank[-1]] - joint[rank[-2]])
        power = np.exp(HEAT * (joint - joint.max()))
        out[owner[a]] = (profiles.languages[rank[-1]], float(power.max() / power.sum()), total, gap)
    return out


def fit_rows(rows: pd.DataFrame) -> Profiles:
    """Prototypes of rows (text, label): fitted once, then again without the rows that the first fit reads otherwise."""
    rows = rows[rows["text"].notna()].copy()
    rows["label"] = [next(iter(s)) if (s := label_set(v)) and len(s) == 1 and s <= COMMON.keys() else None for v in rows["label"]]
    rows = rows[rows["label"].notna()]

    def fit(part: pd.DataFrame) -> Profiles:
        texts = {code: [words] * 3 for code, words in COMMON.items()}
        for code, own in part.groupby("label"):
            texts[code] = [*texts[code], *own["text"].map(mended)]
        return Profiles.fit(texts)

    first = fit(rows)
    return fit(rows[[found[0] == label for found, label in zip(decide(first, rows["text"].tolist()), rows["label"])]])


def fit_profiles(*labelled: DataFrame) -> Profiles:
    """Prototypes from labelled texts (text, label), TRAINING_RUNS runs of words of each frame at most, taken by hash, and COMMON."""
    return fit_rows(pd.concat([_sample(f.where("text IS NOT NULL AND label IS NOT NULL")) for f in labelled], ignore_index=True))


def _sample(frame: DataFrame) -> pd.DataFrame:
    """The TRAINING_RUNS runs of the least hashes, put together again by text; every task drops at once those surely beyond.

    Texts are cut in the tasks, so what comes to the driver is bounded however long they are.
    """
    letters = frame.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    share = min(1.0, 4 * TRAINING_RUNS / max(letters / (8 * WINDOW), 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, label in zip(batch["text"], batch["label"]):
                own = zlib.crc32(text.encode("utf-8", "surrogatepass"))
                for at, part in enumerate(windows([text])):
                    spot = zlib.crc32(f"{own} {at}".encode())
                    if spot < share * 2**32 and len(part) <= LONGEST:
                        rows.append((own, at, spot, label, part))
            yield pd.DataFrame(rows, columns=["id", "at", "spot", "label", "run"])

    each = frame.select("text", "label").mapInPandas(run, "id BIGINT, at INT, spot BIGINT, label STRING, run STRING").distinct()
    rows = each.orderBy("spot", "id", "at", "label").limit(TRAINING_RUNS).toPandas().sort_values(["id", "label", "at"])
    return rows.groupby(["id", "label"], sort=False).agg(text=("run", " ".join)).reset_index()


FOUND = "tbl STRING, doc_id BIGINT, page_number INT, detection_order INT, lang STRING, confidence DOUBLE, letters INT, margin DOUBLE, labelled STRING"


@lru_cache(100_000)
def _script_of(letter: str) -> str:
    return unicodedata.name(letter, "unknown").split()[0].lower()


def script_of(text: str | None) -> str | None:
    """The script of most letters (of two as frequent, the first by name), None without letters."""
    found = Counter(_script_of(c) for c in text or "" if c.isalpha())
    return min(found, key=lambda s: (-found[s], s)) if found else None


def label_texts(frame: DataFrame, profiles: Profiles, script: bool = False) -> DataFrame:
    """Language, confidence, letters and margin of rows (tbl, doc_id, page_number, detection_order, label, text), with their script if asked for.

    Lines of only names, addresses or numbers have no language.
    """
    shared = frame.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            found = decide(shared.value, batch["text"].tolist())
            found = [f if f[2] < LEAST_LETTERS or bears_language(t) else (None, 0.0, 0, 0.0) for f, t in zip(found, batch["text"])]
            out = batch[["tbl", "doc_id", "page_number", "detection_order"]].copy()
            out["lang"], out["confidence"], out["letters"], out["margin"] = zip(*found) if found else ((), (), (), ())
            out["labelled"] = ["-".join(sorted(s)) if (s := label_set(v)) else None for v in batch["label"]]
            if script:
                out["script"] = [script_of(t) for t in batch["text"]]
            yield out

    return frame.mapInPandas(run, f"{FOUND}, script STRING" if script else FOUND)


#: Margin over which a language overrules a label that names another.
OVERRULE = 0.05


def wrong_labels(labelled: DataFrame) -> DataFrame:
    """Rows of ``label_texts`` whose label is missing or names other languages than the text's."""
    return labelled.where(
        (F.col("letters") >= LEAST_LETTERS) & F.col("lang").isNotNull() & (F.col("labelled").isNull() | ((F.col("labelled") != F.col("lang")) & (F.col("margin") >= OVERRULE)))
    )


SEGMENTS = "segment INT, text STRING, lang STRING, confidence DOUBLE, script STRING"


def segment_texts(frame: DataFrame, profiles: Profiles, keys: str = "doc_id BIGINT") -> DataFrame:
    """Every segment (sentence) of (``keys``, text) with its language and confidence."""
    names = [k.split()[0] for k in keys.split(", ")]
    shared = frame.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*k, i, s) for *k, t in zip(*(batch[n] for n in names), batch["text"]) if t for i, s in enumerate(split(t))]
            if not rows:
                continue
            found = pd.DataFrame(rows, columns=[*names, "segment", "text"])
            scores, letters = shared.value.segments(found["text"].tolist())
            power = np.exp(HEAT * (scores - scores.max(1, keepdims=True)))
            known = letters > 0
            found["lang"] = [shared.value.languages[k] if ok else None for k, ok in zip(scores.argmax(1), known)]
            found["confidence"] = np.where(known, power.max(1) / power.sum(1), 0.0)
            found["script"] = [script_of(t) for t in found["text"]]
            yield found

    return frame.select(*names, "text").mapInPandas(run, f"{keys}, {SEGMENTS}")
