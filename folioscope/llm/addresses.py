"""Differently written postal addresses that denote one building.

An address is read into house number, postcode, locality and the words of its street; flats are left out. Which words
are localities, and their postcodes, is learnt from where words stand beside postcodes. Rewrites are mined from
addresses that agree in all but one word of the street: word pairs that are near in spelling or abbreviate each other
and that stand for each other significantly often are rewritten to the longer or more frequent word, along chains to
their end, and the addresses are matched again, until no new rewrite appears. Addresses with equal number, place and
street then denote one building. Localities and rewrites are tables and meet the words in joins.

Defined results: null and blank addresses, and those without house number, street or place, match nothing; repeated
rows count once; digits of any script, case, accents, order of parts and lost separators do not matter.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.llm.names import folded
from folioscope.llm.strings import segment_join
from folioscope.plans.materialize import cut

# Words before the number of a flat, and before that of a house.
FLAT = "apartment apt flat unit suite appartement appt app wohnung whg شقه"
HOUSE = "number no nr num numero n hausnr رقم عماره ع"
# Words before a locality that belong to no name.
AREA = frozenset("مركز قسم".split())
# Ends of compound street names.
ENDS = ("strasse", "str", "weg", "platz", "pl", "gasse", "allee")
#: A locality stands beside its postcode in this share of the addresses that have both, and with this share of the house
#: numbers that the postcode has, two at least (a street has few of them).
BESIDE, SPREAD = 0.5, 0.3
#: Likelihood ratio (one per cent) and share of a word's places that a rewrite needs, for typing errors and abbreviations.
SIGNIFICANT, TYPED_SHARE, SHORT_SHARE = 6.63, 0.3, 0.08
#: Letters of an abbreviation, at most.
SHORT = 5

_CAMEL = re.compile(r"(?<=[a-zäöüß])(?=[A-ZÄÖÜ])")
_EDGE = re.compile(r"(?<=[^\W\d_])(?=\d)|(?<=\d)(?=[^\W\d_])")
_FLAT = re.compile(rf"(?:(?<![^\W\d_])(?:{'|'.join(FLAT.split())})\W*(?:(?:{'|'.join(HOUSE.split())})(?![^\W\d_])\W*)?|#\s*|(?<![^\W\d_])ش )(\d{{1,4}})(?!\d)")
_HOUSE = re.compile(rf"(?<![^\W\d_])(?:{'|'.join(HOUSE.split())})(?![^\W\d_])[\s.°º:]*(\d{{1,4}})(?!\d)")
_CODE = re.compile(r"(?<!\d)\d{5}(?!\d)")


def parse(value: str | None) -> tuple[str | None, str | None, list[str], list[str]] | None:
    """(house number, postcode, words, words beside the postcode) of an address."""
    if value is None or not value.strip():
        return None
    text = folded(_CAMEL.sub(" ", unicodedata.normalize("NFKC", value)))
    text = "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in text)
    text = _EDGE.sub(" ", text)
    code = _CODE.search(text)
    text = _CODE.sub(" ¤ ", text, count=1)
    text = _FLAT.sub(" ", text)
    house = _HOUSE.search(text) or re.search(r"(?<!\d)(\d{1,4})(?!\d)", text)
    if house:
        text = text[: house.start()] + " § " + text[house.end() :]
    words: list[str] = []
    for w in re.findall(r"[^\W\d_]+|¤|§", text):
        if w in AREA:
            continue
        end = next((e for e in ENDS if w.endswith(e) and len(w) >= len(e) + 3), None)
        words += [w[: -len(end)], end] if end else [w]
    beside = {words[j] for i, w in enumerate(words) if w == "¤" for j in (i - 1, i + 1) if 0 <= j < len(words)} - {"¤", "§"}
    return house[1].lstrip("0") if house else None, code[0] if code else None, [w for w in words if w not in "¤§"], sorted(beside)


PARSED = "STRUCT<number STRING, code STRING, words ARRAY<STRING>, beside ARRAY<STRING>>"


def _parsed(cards: DataFrame) -> DataFrame:
    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(v) or (None, None, None, None) for v in values], columns=["number", "code", "words", "beside"])

    read = cards.where("value IS NOT NULL").select("doc_id", F.pandas_udf(run, PARSED)("value").alias("p")).select("doc_id", "p.*").where("number IS NOT NULL AND size(words) > 0")
    return read.withColumn("address", F.concat_ws("|", "number", F.coalesce("code", F.lit("")), F.array_join("words", " ")))


def localities(parsed: DataFrame) -> DataFrame:
    """(word, code): every word that is a locality, with the postcode that it stands beside."""
    words = parsed.where("code IS NOT NULL").select("number", "code", "beside", F.explode(F.array_distinct("words")).alias("word"))
    each = words.groupBy("word", "code").agg(F.count("*").alias("n"), F.count_if(F.array_contains("beside", F.col("word"))).alias("near"), F.countDistinct("number").alias("numbers"))
    codes = words.groupBy("code").agg(F.countDistinct("number").alias("all"))
    each = each.join(codes, "code")
    best = each.groupBy("word").agg(F.sum("n").alias("n"), F.sum("near").alias("near"), F.max_by(F.struct("code", "n", "numbers", "all"), "n").alias("top"))
    found = best.where((F.col("near") >= BESIDE * F.col("n")) & (F.col("top.n") >= 0.8 * F.col("n")) & (F.col("top.numbers") >= F.greatest(F.lit(2), SPREAD * F.col("top.all"))) & (F.length("word") > 3))
    return found.select("word", F.col("top.code").alias("code"))


def _placed(parsed: DataFrame) -> DataFrame:
    """Rows (address, number, place, street) of readable addresses, with the street's words in order of the alphabet.

    Words are localities as they are or, last or first in the address and none else being one, within a typing error.
    """
    known = cut(localities(parsed))
    each = parsed.select("address", "number", "code", "words").distinct()
    ends = F.array_distinct(F.array(F.element_at("words", 1), F.element_at("words", -1)))
    edge = each.select(F.explode(ends).alias("word")).where(F.length("word") > 5)
    far = F.levenshtein("a", "b", 2)
    swapped = (far == 2) & (F.array_sort(F.split("a", "")) == F.array_sort(F.split("b", "")))
    near = segment_join(edge.union(known.select("word"))).where((far == 1) | swapped)
    typed = near.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("name")), F.struct(F.col("b").alias("word"), F.col("a").alias("name")))).alias("w")).select("w.*")
    typed = typed.join(known.select(F.col("word").alias("name"), F.col("code").alias("of")), "name").select("word", "of", F.lit(False).alias("exact"))
    spelt = known.select("word", F.col("code").alias("of"), F.lit(True).alias("exact")).union(typed)
    words = each.select("address", "code", ends.alias("ends"), F.posexplode("words").alias("at", "word")).join(spelt, "word")
    words = words.where((F.col("code").isNull() | (F.col("code") == F.col("of"))) & (F.col("exact") | (F.array_contains("ends", F.col("word")) & (F.length("word") > 5))))
    exact = F.col("exact")
    held = words.groupBy("address").agg(
        F.collect_set(F.when(exact, F.col("word"))).alias("held"), F.min_by("of", F.when(exact, F.col("at"))).alias("of"),
        F.collect_set(F.when(~exact, F.col("word"))).alias("edges"), F.min(F.when(~exact, F.col("of"))).alias("least"), F.max(F.when(~exact, F.col("of"))).alias("most"),
    )
    all_ = each.join(held, "address", "left")
    own = F.coalesce(F.size("held") > 0, F.lit(False))
    place = F.coalesce("code", F.when(own, F.col("of")).when(F.col("least") == F.col("most"), F.col("least")))
    street = F.array_sort(F.array_except("words", F.when(own, F.col("held")).otherwise(F.coalesce("edges", F.array().cast("array<string>")))))
    return all_.select("address", "number", place.alias("place"), street.alias("street")).where("place IS NOT NULL AND size(street) > 0")


def _rewrites(streets: DataFrame) -> DataFrame:
    """(word, better) of words that stand for each other significantly among streets (number, place, street) that agree in
    all else. The word of more than SHORT letters, then the more frequent, is the better. Slots that one word stands in
    take no part in the joins."""
    slot = F.transform("street", lambda w: F.struct(w.alias("word"), F.concat_ws("|", "number", "place", F.array_join(F.array_remove("street", w), " ")).alias("slot")))
    slots = streets.select(F.explode(slot).alias("s")).select("s.slot", "s.word").distinct()
    slots = cut(slots.withColumn("k", F.count("*").over(W.partitionBy("slot"))))
    total = slots.agg(F.coalesce(F.sum(1 / F.col("k")), F.lit(1.0))).first()[0]
    held = slots.groupBy("word").agg(F.count("*").alias("n"))
    several = slots.where("k > 1").select("slot", "word")
    typed = segment_join(several, "word", "slot", once=False).select("scope", "a", "b", F.lit(None).cast("string").alias("short"))
    first, length = F.substring("word", 1, 1).alias("first"), F.length("word")
    short = several.where(length <= SHORT).select("slot", first, F.substring("word", 2, 1).alias("second"), F.col("word").alias("a"))
    letters = F.array_distinct(F.concat(F.array(F.lit("")), F.split(F.substring(F.col("word"), F.lit(2), length), "")))
    long = several.where(length > 1).select("slot", first, F.explode(letters).alias("second"), F.col("word").alias("b"))
    inside = F.expr("b RLIKE concat('^', array_join(split(a, ''), '.*'))")
    brief = short.join(long, ["slot", "first", "second"]).where((F.length("a") < F.length("b")) & inside).select(F.col("slot").alias("scope"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("a").alias("short"))
    # a pair found both ways is an abbreviation
    both = typed.unionByName(brief).groupBy("scope", "a", "b").agg(F.max("short").alias("short"))
    met = both.groupBy("a", "b").agg(F.count("*").alias("n_ab"), F.max("short").alias("short"))
    met = met.join(held.select(F.col("word").alias("a"), F.col("n").alias("n_a")), "a").join(held.select(F.col("word").alias("b"), F.col("n").alias("n_b")), "b")
    ratio = 2 * F.col("n_ab") * F.log(F.col("n_ab") * total / (F.col("n_a") * F.col("n_b")))
    least = F.when(F.col("short") == F.col("a"), SHORT_SHARE * F.col("n_a")).when(F.col("short") == F.col("b"), SHORT_SHARE * F.col("n_b")).otherwise(TYPED_SHARE * F.least("n_a", "n_b"))
    kept = met.where((ratio >= SIGNIFICANT) & (F.col("n_ab") >= least))
    rank = lambda w: F.struct((F.length(w) > SHORT).alias("long"), F.col(f"n_{w}").alias("n"), F.col(w).alias("word"))
    lower, upper = F.least(rank("a"), rank("b")), F.greatest(rank("a"), rank("b"))
    ranked = kept.select(lower.alias("lower"), upper.alias("upper"), F.col("short").isNotNull().alias("brief"))
    ranked = ranked.withColumn("best", F.max("upper").over(W.partitionBy("lower.word")))
    # words with one abbreviation are one word: Street and Strasse are both Str.
    same = F.when(F.col("brief") & (F.col("upper") < F.col("best")), F.struct("upper.word", "best"))
    turned = ranked.select(F.explode(F.array_compact(F.array(F.struct("lower.word", "best"), same))).alias("r")).select("r.word", "r.best")
    return turned.groupBy("word").agg(F.max("best")["word"].alias("better"))


def _led_on(rewrites: DataFrame) -> DataFrame:
    """Rewrites to the last word of their chain. A better word always ranks higher, so chains end."""
    while True:
        step = rewrites.select(F.col("word").alias("better"), F.col("better").alias("next"))
        led = cut(rewrites.join(step, "better", "left").select("word", F.coalesce("next", "better").alias("better"), F.col("next").isNotNull().alias("more")))
        rewrites = led.select("word", "better")
        if led.where("more").isEmpty():
            return rewrites


def buildings(cards: DataFrame) -> DataFrame:
    """(doc_id, building) of cards (doc_id, value); a card without a readable address has building null.

    Rewrites are mined and applied until no new one appears. Every round takes words out of the streets and brings none
    in, so the rounds end.
    """
    parsed = cut(_parsed(cards.distinct()))
    placed = cut(_placed(parsed))
    while True:
        found = cut(_rewrites(placed.select("number", "place", "street").distinct()))
        if found.isEmpty():
            break
        words = placed.select("address", "number", "place", F.explode("street").alias("word")).join(_led_on(found), "word", "left")
        placed = cut(words.groupBy("address", "number", "place").agg(F.array_sort(F.collect_set(F.coalesce("better", "word"))).alias("street")))
    building = F.concat_ws("|", "place", "number", F.array_join("street", " ")).alias("building")
    found = parsed.join(placed.select("address", building), "address").select("doc_id", "building")
    return cards.select("doc_id").distinct().join(found, "doc_id", "left").distinct()
