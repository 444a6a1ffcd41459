"""Variant spellings of persons' names that denote one person.

Names are read into surname, given name and middle name. Which words are given names is learnt from the names whose
order is known (passports, commas). Surnames within two edits are found by a pigeonhole segment join; names of one
surname are linked when their given names agree (also as nickname, initial, abbreviation or typing error) and their
middle names do not contradict. Linked names form persons.

Defined results: null and blank names, and names of titles or initials only, belong to no person; repeated rows count
once; an initial that fits several persons of a surname links to none of them; copies of a name are one node of the
graph and are expanded only where pairs of uploads are asked for.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.llm.strings import components, segment_join
from folioscope.plans.materialize import cut

# Usual short and foreign forms of given names.
SHORT = {
    "alexander": "alex aleksander alexandre alejandro sasha sascha xander", "elizabeth": "elisabeth liz beth betty lizzie eliza", "william": "will bill wm billy willy",
    "robert": "rob bob bobby robbie", "katherine": "catherine kate kathy katie katharina kathryn katharine cathy", "margaret": "maggie peggy meg margarete margareta",
    "patricia": "pat patrizia trish patty tricia", "victoria": "vicky tori viktoria vicki", "theodore": "ted theo teddy theodor", "samuel": "sam sammy",
    "leonardo": "leo leonard lennart", "francisco": "paco fran pancho", "johannes": "hannes jo johann", "youssef": "yousef yusuf joseph yousuf josef", "mohamed": "mohammed muhammad mohd mohammad muhammed",
    "ibrahim": "ebrahim ibraheem", "hussein": "hossein hussain husain", "fatima": "fatma fatimah", "abdelrahman": "abdulrahman abdurrahman abderrahman", "dmitri": "dmitry dima dimitri", "dolores": "lola dolly",
    "gabriela": "gabi gaby gabriella gabriele", "nathaniel": "nat nate nathan", "ottilie": "otti tilly", "quentin": "quinten quin", "rosalind": "ros roz", "ursula": "uschi ulla",
    "wilhelmina": "willa mina", "zachary": "zach zak zack zac", "guillaume": "guy guilhem", "عبدالرحمن": "عبدالرحمان",
}
# Titles and forms of address.
TITLES = frozenset("dr mr mrs ms miss prof eng ing sir herr frau mme mlle m.lle sr sra srta don doña dott السيد السيده الدكتور الدكتوره المهندس المهندسه الاستاذ الاستاذه".split())
#: Share of all known given words that makes a word a common given name: at most 1 / GIVEN_SHARE words.
GIVEN_SHARE = 5e-4
#: A misspelling holds this share of the uploads of both spellings at most (with this many standard errors to spare).
TYPED_SHARE, ERRORS = 0.2, 2.33
#: Chance under which given names that two spellings share are no coincidence.
COINCIDENCE = 0.05

_DROP = re.compile(r"[ـً-ْٰ​-‏‪-‮⁦-⁩﻿­'’`]")
_ARABIC = str.maketrans({"أ": "ا", "إ": "ا", "آ": "ا", "ٱ": "ا", "ى": "ي", "ی": "ي", "ة": "ه", "ؤ": "و", "ئ": "ي", "چ": "ج", "گ": "ك", "ک": "ك", "پ": "ب", "ء": None})


def folded(value: str) -> str:
    """Lower case without accents, marks, tatweel and invisible characters; Arabic letters in one spelling."""
    text = _DROP.sub("", unicodedata.normalize("NFKC", value))
    text = "".join(c for c in unicodedata.normalize("NFKD", text.replace("ß", "ss").translate(_ARABIC)) if not unicodedata.combining(c))
    return text.lower()


def _words(text: str) -> list[str]:
    words = [w for w in re.split(r"[\s<.،,;/_]+|-+", text) if w and w not in TITLES]
    out: list[str] = []
    for w in words:
        if out and out[-1] in ("abd", "abdel", "abdul", "abdal") and len(w) > 2:
            out[-1] = "abdel" + w
        elif out and out[-1] == "abd" and w in ("el", "al", "ul", "er"):
            out[-1] = "abdel"
        elif out and out[-1] == "عبد":
            out[-1] = "عبد" + w
        elif out and out[-1] == "ال":
            out[-1] = w
        else:
            out.append(w)
    plain = []
    for w in out:
        if "؀" <= w[0] <= "ۿ":
            w = re.sub(r"(.)\1+", r"\1", w[2:] if w.startswith("ال") and len(w) > 4 else w)
        plain.append(w)
    return [w for w in plain if w and any(c.isalpha() for c in w)]


FORMS = {v: k for k, vs in SHORT.items() for v in vs.split()}


def parts(name: str | None, surname: str | None = None) -> list[tuple[str, str]]:
    """(word, role) of a name: role s or g where the order tells, else empty; ``surname`` is printed apart in passports."""
    if surname is not None:
        return [(w, "s") for w in _words(folded(surname))] + [(w, "g") for w in _words(folded(name or ""))]
    if not name:
        return []
    text = folded(name)
    comma = re.search(r"[,،]", text)
    if comma and (a := _words(text[: comma.start()])) and (b := _words(text[comma.end() :])):
        return [(w, "s") for w in a] + [(w, "g") for w in b]
    return [(w, "") for w in _words(text)]


def _near(a: str, b: str) -> bool:
    """Whether one letter was typed wrong, left out, doubled or swapped with its neighbour."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return a == b
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


@lru_cache(100_000)
def given_form(word: str, known: frozenset[str]) -> str:
    """The full form of a given name: of a short form, a unique beginning of three letters or more, a typing error."""
    if word in FORMS:
        return FORMS[word]
    if word in known or word in SHORT or len(word) < 3:
        return word
    every = known | SHORT.keys() | FORMS.keys()
    for fits in (lambda k: k.startswith(word), lambda k: min(len(k), len(word)) >= 4 and _near(k, word)):
        full = {FORMS.get(k, k) for k in every if fits(k)}
        if full:
            return full.pop() if len(full) == 1 else word
    return word


def read(words: list[tuple[str, str]], known: frozenset[str]) -> tuple[str, str, str] | None:
    """(surname, given name or initial, middle name) of a name's parts."""
    sure = lambda w: w in known or w in FORMS or w in SHORT or len(w) == 1
    given = lambda w: sure(w) or given_form(w, known) != w
    last = [w for w, r in words if r == "s"]
    if last:
        first = [w for w, r in words if r == "g"]
        if all(map(sure, last)) and first and not any(map(sure, first)):
            last, first = first, last
    else:
        plain = [w for w, _ in words]
        others = [i for i, w in enumerate(plain) if not given(w)]
        if not others:
            others = [len(plain) - 1] if plain and len(plain[-1]) > 1 else []
        if not others:
            return None
        if len(others) > 1:
            # words beside each other at one end may be one surname typed in two; else the far one from the given names
            start = others[0] == 0
            run = [others[0]] if start else [others[-1]]
            if not start:
                while run[0] - 1 in others and (run[0] - 1 > 0) and len(plain[run[0] - 1]) + len(plain[run[0]]) <= 12 and any(given(plain[i]) for i in range(run[0] - 1)):
                    run.insert(0, run[0] - 1)
            elif any(given(plain[i]) for i in range(2, len(plain))) and 1 in others and len(plain[0]) + len(plain[1]) <= 12:
                run.append(1)
            elif not any(map(given, plain)):
                run = [len(plain) - 1]
        else:
            run = others
        last, first = [plain[i] for i in run], [w for i, w in enumerate(plain) if i not in run]
    if not first:
        return None
    name = "".join(last)
    if len(name) < 2:
        return None
    return name, given_form(first[0], known), given_form(first[1], known) if len(first) > 1 and len(first[1]) > 2 else (first[1] if len(first) > 1 else "")


_PARTS = "ARRAY<STRUCT<word STRING, role STRING>>"


def _parsed(names: DataFrame) -> DataFrame:
    def run(value: pd.Series, surname: pd.Series) -> pd.Series:
        return pd.Series([[{"word": w, "role": r} for w, r in parts(v, s)] for v, s in zip(value, surname)])

    return names.withColumn("parts", F.pandas_udf(run, _PARTS)("value", "surname"))


def _merged(frame: DataFrame) -> DataFrame:
    """A side that grows with the corpus: joined by merging, as a broadcast would be built in the driver."""
    return frame.hint("merge")


def holders(fields: DataFrame) -> DataFrame:
    """(doc_id, value, surname) of identity cards, CVs and passports; passports need both parts."""
    card, passport = "extractor IN ('IDCardExtractor', 'CVExtractor') AND field_name = 'name'", "extractor = 'PassportExtractor' AND field_name IN ('given_names', 'surname')"
    # the table is read once, for cards and both fields of passports
    rows = cut(fields.where(f"value IS NOT NULL AND ({card} OR {passport})").select("doc_id", "extractor", "field_name", "value").distinct())
    cards = rows.where(card).select("doc_id", "value", F.lit(None).cast("string").alias("surname"))
    given, last = rows.where("field_name = 'given_names'").select("doc_id", "value"), rows.where("field_name = 'surname'").select("doc_id", F.col("value").alias("surname"))
    return cards.unionByName(given.join(_merged(last), "doc_id"))


def given_words(parsed: DataFrame) -> frozenset[str]:
    """Common given names, from names of known order, less those cut short; bounded by GIVEN_SHARE."""
    words = parsed.select(F.explode("parts").alias("p")).where("p.role <> ''").groupBy("p.word").agg(F.count_if(F.col("p.role") == "g").alias("g"), F.count_if(F.col("p.role") == "s").alias("s"))
    words = cut(words)
    total = words.agg(F.coalesce(F.sum("g"), F.lit(0))).first()[0]
    least = max(4, GIVEN_SHARE * total)
    common = {r["word"]: r["g"] for r in words.where((F.col("g") >= least) & (F.col("g") >= 4 * F.col("s")) & (F.length("word") > 1)).select("word", "g").collect()}
    cut_short = {w for w in common if w not in SHORT and w not in FORMS and any(k != w and k.startswith(w) and n >= 3 * common[w] for k, n in common.items())}
    return frozenset(common.keys() - cut_short)


FORM = "STRUCT<s STRING, g STRING, m STRING, sure BOOLEAN>"


def persons(fields: DataFrame) -> DataFrame:
    """(doc_id, person): the person that each upload's holder is, as the least node of linked names; null if it cannot be read."""
    parsed = cut(_parsed(holders(fields)))
    known = given_words(parsed)
    shared = parsed.sparkSession.sparkContext.broadcast(known)

    def run(values: pd.Series) -> pd.DataFrame:
        found = [read([(p["word"], p["role"]) for p in v], shared.value) for v in values]
        sure = shared.value | SHORT.keys()
        rows = [(*f, f[1] in sure) if f else (None, None, None, None) for f in found]
        return pd.DataFrame(rows, columns=["s", "g", "m", "sure"])

    first = F.substring("m", 1, 1)
    # uploads whose name cannot be read stay, with nulls
    names = cut(parsed.select("doc_id", F.pandas_udf(run, FORM)("parts").alias("f")).select("doc_id", "f.*").withColumn("first", first).distinct())
    forms = cut(names.where("s IS NOT NULL").groupBy("s", "g", "first").agg(F.max("sure").alias("sure"), F.count("*").alias("n")))
    # one middle initial at most: one person; else a person for each, and one for the names without
    initial, name = F.when(F.col("first") != "", F.col("first")), W.partitionBy("s", "g")
    several = F.coalesce(F.min(initial).over(name) != F.max(initial).over(name), F.lit(False))
    forms = forms.withColumn("mark", F.when(several, F.col("first")).otherwise("*")).withColumn("node", F.concat_ws("|", "s", "g", "mark"))
    nodes = cut(forms.groupBy("s", "g", "mark", "node").agg(F.max("first").alias("m1"), F.max("sure").alias("sure"), F.sum("n").alias("n")))
    roots = components(_links(nodes))
    denoted = forms.join(_merged(roots), forms["node"] == roots["id"], "left").select("s", "g", "first", F.coalesce("root", "node").alias("person"))
    found = names.join(_merged(denoted), ["s", "g", "first"], "left").groupBy("doc_id").agg(F.collect_set(F.when(F.col("doc_id").isNotNull(), F.col("person"))).alias("persons"))
    return cut(found.select("doc_id", F.explode_outer("persons").alias("person")))


def _spellings(nodes: DataFrame, near: DataFrame) -> DataFrame:
    """Pairs (a, b) of near surnames that may be spellings of one.

    Either the rarer is no more frequent than misspellings are, or most of its given names stand under the other too, and
    that is no coincidence: by the share that the other's given names have of everyone else's. All are shares, so more
    copies of the same uploads change nothing that is clear. Surnames with initials only give no evidence against.
    """
    names = nodes.groupBy("s", "g").agg(F.sum("n").alias("n"))
    held = names.where(F.length("g") > 1)
    every = held.groupBy("g").agg(F.sum("n").alias("every"))
    of_full = lambda x: F.coalesce(F.sum(F.when(F.length("g") > 1, x)), F.lit(0))
    sizes = cut(names.join(_merged(every), "g", "left").groupBy("s").agg(F.sum("n").alias("n"), of_full(F.col("n")).alias("full"), of_full(F.lit(1)).alias("givens"), of_full(F.col("every") - F.col("n")).alias("others")))
    total = sizes.agg(F.coalesce(F.sum("full"), F.lit(0))).first()[0]
    x = sizes.select(F.col("s").alias("a"), *(F.col(c).alias(f"{c}_a") for c in ("n", "full", "givens", "others")))
    y = sizes.select(F.col("s").alias("b"), *(F.col(c).alias(f"{c}_b") for c in ("n", "full", "givens", "others")))
    both = near.join(_merged(x), "a").join(_merged(y), "b")
    rare, swap = F.least("n_a", "n_b"), F.col("n_a") < F.col("n_b")
    share = TYPED_SHARE * (F.col("n_a") + F.col("n_b"))
    both = cut(both.withColumn("typed", (rare <= share + ERRORS * F.sqrt(share * (1 - TYPED_SHARE))) | (F.when(swap, F.col("givens_a")).otherwise(F.col("givens_b")) == 0)))
    # given names of the rarer (r) that stand under the other (o)
    open_ = both.where(~F.col("typed"))
    first = lambda c, o, r: F.when(swap, F.col(f"{c}_a" if r else f"{c}_b")).otherwise(F.col(f"{c}_b" if r else f"{c}_a")).alias(o)
    turned = open_.select(
        "a", "b", F.when(swap, F.col("a")).otherwise(F.col("b")).alias("r"), F.when(swap, F.col("b")).otherwise(F.col("a")).alias("o"),
        first("givens", "givens", True), first("others", "others", False), (total - F.col("full_a") - F.col("full_b")).alias("rest"),
    )
    own, theirs = held.select(F.col("s").alias("r"), "g", F.col("n").alias("shared")), held.select(F.col("s").alias("o"), "g")
    met = turned.join(_merged(own), "r").join(_merged(theirs), ["o", "g"]).groupBy("a", "b").agg(F.count("*").alias("same"), F.sum("shared").alias("shared"), F.first("givens").alias("givens"), F.first("others").alias("others"), F.first("rest").alias("rest"))
    chance = (F.col("others") - F.col("shared")) / F.greatest(F.col("rest"), F.lit(1))
    agreed = met.where((F.col("same") >= F.col("givens") * (1 + chance) / 2) & (F.pow(chance, F.col("same")) <= COINCIDENCE))
    return both.where("typed").select("a", "b").unionByName(agreed.select("a", "b"))


def _links(nodes: DataFrame) -> DataFrame:
    """(a, b): nodes of names that denote one person.

    One join by surname (the same or a near one) and a key of the given name: the given name itself or one that an
    uncommon given name is near to, and the first letter, by which an initial finds the one person of its surname, else
    of the near ones, that it fits.
    """
    # surnames and given names meet once each, in one join
    words = nodes.select(F.explode(F.array(F.struct(F.lit("s").alias("part"), F.col("s").alias("word")), F.struct(F.lit("g").alias("part"), F.when(F.length("g") > 1, F.col("g")).alias("word")))).alias("w")).select("w.*")
    alike = cut(segment_join(words, "word", "part"))
    both = lambda p, x, y: p.select(F.explode(F.array(F.struct(F.col("a").alias(x), F.col("b").alias(y)), F.struct(F.col("b").alias(x), F.col("a").alias(y)))).alias("p")).select("p.*")
    spread = both(_spellings(nodes, alike.where("scope = 's'").select("a", "b")), "s", "t").union(nodes.select("s", F.col("s").alias("t")).distinct())
    # how a node looks for others: by its given name under near surnames, by a near given name, by its initial
    own = nodes.select("s", "node", "m1", F.col("g").alias("key"), F.explode(F.when(F.length("g") == 1, F.array(F.lit("same"), F.lit("initial"))).otherwise(F.array(F.lit("same")))).alias("by"))
    rare = nodes.where(~F.col("sure")).join(_merged(both(alike.where("scope = 'g'"), "g", "key")), "g").select("s", "node", "m1", "key", F.lit("near").alias("by"))
    x = own.unionByName(rare).join(_merged(spread), "s").where("by <> 'same' OR s <> t").withColumn("initial", F.col("by") == "initial")
    keys = F.array(F.struct(F.lit(False).alias("initial"), F.col("g").alias("key")), F.struct(F.lit(True).alias("initial"), F.when(F.length("g") > 1, F.substring("g", 1, 1)).alias("key")))
    y = nodes.select(F.col("s").alias("t"), F.col("node").alias("b"), F.col("m1").alias("m_b"), F.explode(keys).alias("k")).select("t", "b", "m_b", "k.*").where("key IS NOT NULL")
    agree = (F.col("m1") == "") | (F.col("m_b") == "") | (F.col("m1") == F.col("m_b"))
    met = cut(x.join(_merged(y), ["t", "key", "initial"]).where(agree).select("initial", F.col("node").alias("a"), "b", (F.col("s") == F.col("t")).alias("own")))
    fits = F.when(F.col("own"), F.col("b"))
    one = met.where("initial").groupBy("a").agg(F.min(fits).alias("own"), F.max(fits).alias("own_too"), F.min("b").alias("near"), F.max("b").alias("near_too"))
    found = F.when(F.col("own") == F.col("own_too"), F.col("own")).when(F.col("own").isNull() & (F.col("near") == F.col("near_too")), F.col("near"))
    return met.where("NOT initial").select("a", "b").unionByName(one.select("a", found.alias("b"))).where("a <> b").distinct()
