"""Field extraction from classified pages into an entity-attribute-value table.

Each extractor is a chain of projections that name what is found, and a list of fields over these names, every one with
its confidence, validity and note; a page's fields are one array that is exploded, so an extractor never shuffles. Generic fields are extracted from every page,
specialised ones from the pages of their category, and where both give a field the specialised one holds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions import constants as C
from folioscope.functions import text as T
from folioscope.functions import validation as V

S, D, L, R = r"[\s\p{Z}]", r"\p{Nd}", rf"(?<![{C.WORD}])", rf"(?![{C.WORD}])"
_DATE = rf"(?:{D}{{4}}[-/]{D}{{1,2}}[-/]{D}{{1,2}}|{D}{{1,2}}[-/]{D}{{1,2}}[-/]{D}{{2,4}})"
_AMOUNT = rf"([{D},]+(?:\.{D}{{1,2}})?)"
_EQ = rf"{S}*[:=]?{S}*"
_NAME = r"([A-Za-z\x{0600}-\x{06FF}\s\p{Z}]+)"


@dataclass(frozen=True)
class Field:
    """A field of an extractor: one value or an array of values; null and empty ones give no row."""

    name: str
    value: Column
    confidence: Column | float | None = None
    valid: Column | bool = True
    note: Column | str | None = None
    many: bool = False
    seen: Column | None = None  #: what is looked up in the page's lines: the line's confidence then replaces the field's


Found = dict[str, Column]


@dataclass(frozen=True)
class Extractor:
    """``stages`` add named columns to a page's text, each over those before; ``fields`` read them."""

    stages: tuple[Callable[[Column, Column], Found], ...]
    fields: Callable[[Column], list[Field]]


#: Marks the columns of the extractor that is being built, so that several fit into one projection.
_OWN: list[str] = [""]


def x(name: str) -> Column:
    """A column that an earlier stage of the extractor has named."""
    return F.col(f"x{_OWN[-1]}_{name}")


#: What the layout of a page tells an extractor, where it is known: lines in order, the rows of its table, signatures.
LAYOUT = {"page_lines": "array<struct<text:string,confidence:double>>", "page_table": "array<array<string>>", "page_signed": "boolean"}


def _lit(value: object, kind: str) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast(kind)


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null if there is none; case does not matter."""
    return F.nullif(F.regexp_extract(text, f"(?iu){pattern}", group), F.lit(""))


def every(text: Column, pattern: str, group: int = 0) -> Column:
    """The groups of all matches, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))


def first_line(value: Column) -> Column:
    """The first line of a captured run, null under two characters."""
    line = T.stripped(F.split(value, C.LINE_ENDS)[0])
    return F.when(F.length(line) >= 2, line)


def first_where(lines: Column, test: Callable[[Column], Column]) -> Column:
    return F.try_element_at(F.filter(lines, test), F.lit(1))


def _generic(text: Column, as_of: Column) -> Found:
    plain = T.plain_digits(text)
    return {
        "emails": every(text, L + C.EMAIL + R), "urls": every(text, rf"(?iu){L}{C.URL}"),
        "phones": F.transform(every(text, C.PHONE_MOBILE + R + "|" + C.PHONE_INTERNATIONAL), T.stripped), "dates": every(plain, L + _DATE + R),
        "amounts": F.transform(every(plain, rf"(?iu)(?:{C.CURRENCY}{S}*[:=]?{S}*[{D},]+(?:\.{D}{{1,2}})?|[{D},]+(?:\.{D}{{1,2}})?{S}*{C.CURRENCY}){R}"), T.stripped),
        "pairs": key_values(text),
    }


def _generic_fields(as_of: Column) -> list[Field]:
    mail, phone, day = F.forall(x("emails"), V.email), F.forall(x("phones"), V.phone), F.exists(x("dates"), lambda d: V.parse_date(d).isNotNull())
    return [
        Field("emails", x("emails"), F.when(mail, 0.98).otherwise(0.70), mail, many=True), Field("urls", x("urls"), 0.96, many=True),
        Field("phones", x("phones"), F.when(phone, 0.95).otherwise(0.65), phone, many=True), Field("dates", x("dates"), F.when(day, 0.95).otherwise(0.60), day, many=True),
        Field("amounts", x("amounts"), 0.94, many=True), Field("key_values", F.transform(F.map_entries(x("pairs")), lambda e: F.concat_ws("=", e["key"], e["value"])), 0.90, many=True),
    ]


def key_values(text: Column) -> Column:
    """map of "key: value" and "key = value" lines; of a key that comes again the last value holds."""
    every_line = F.transform(F.split(F.coalesce(text, F.lit("")), C.LINE_ENDS), T.stripped)

    def pair(line: Column) -> Column:
        mark = F.when(line.contains(":") & ~line.startswith("http"), ":").when(line.contains("="), "=")
        at = F.position(mark, line)
        key, value = T.stripped(F.substring(line, F.lit(1), at - 1)), T.stripped(F.substring(line, at + 1, F.length(line)))
        good = mark.isNotNull() & F.size(T.words_of(key)).between(1, 4) & (value != "") & (F.length(key) < 35)
        return F.when(good, F.struct(key.alias("key"), value.alias("value")))

    pairs = F.filter(F.transform(every_line, pair), lambda p: p.isNotNull())
    none = F.array().cast("array<struct<key:string,value:string>>")
    last = F.aggregate(pairs, none, lambda kept, p: F.concat(F.filter(kept, lambda k: k["key"] != p["key"]), F.array(p)))
    return F.map_from_entries(last)


def id_lines(text: Column) -> Column:
    """Lines of a card: digits of a number printed in groups put in order, joined, noise signs left out."""
    plain = F.transform(F.split(F.coalesce(T.plain_digits(text), F.lit("")), C.LINE_ENDS), lambda v: v)

    def repair(line: Column) -> Column:
        groups = F.regexp_extract_all(line, F.lit(r"\d+"), F.lit(0))
        turned = F.array_join(F.reverse(groups), "")
        digits, letters = F.regexp_count(line, F.lit(r"\d")), F.regexp_count(line, F.lit(r"\p{L}"))
        return F.when((digits > letters) & (digits >= 10) & (F.size(groups) > 1) & turned.rlike(r"^[23]\d{13}$"), turned).otherwise(line)

    joined = F.transform(F.transform(plain, repair), lambda v: F.translate(F.regexp_replace(v, r"(?<=\d)[ \t]+(?=\d)", ""), "|_-؛;:.,»«", "          "))
    return F.filter(F.transform(joined, T.stripped), lambda v: v != "")


def id_number(lines: Column, as_of: Column) -> Column:
    """The first valid identity number: as printed, then inside longer runs of digits, then from two lines side by side."""
    valid = lambda c: V.national_id(c, as_of)["valid"]
    direct = F.flatten(F.transform(lines, lambda v: F.regexp_extract_all(v, F.lit(rf"{L}[23]\d{{13}}{R}"), F.lit(0))))
    digits = F.transform(lines, lambda v: F.regexp_replace(v, r"\D", ""))
    windows = F.flatten(F.transform(F.filter(digits, lambda d: F.length(d) >= 14), lambda d: F.transform(F.sequence(F.lit(1), F.length(d) - 13), lambda i: F.substring(d, i, F.lit(14)))))
    some = F.transform(F.filter(lines, lambda v: F.regexp_count(v, F.lit(r"\d")) >= 2), lambda v: F.regexp_replace(v, r"\D", ""))
    pairs = F.flatten(F.transform(F.when(F.size(some) >= 2, F.sequence(F.lit(1), F.size(some) - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.array(
        F.concat(F.element_at(some, i), F.element_at(some, i + 1)), F.concat(F.element_at(some, i + 1), F.element_at(some, i)))))
    right = lambda c: c.rlike(r"^[23]\d{13}$") & valid(c)
    return F.coalesce(*(first_where(c, right) for c in (direct, windows, pairs)))


def _labelled(lines: Column, label: str, strip: str, good: Callable[[Column], Column], nxt: Callable[[Column], Column]) -> Column:
    """The value beside a label, or on the next line, of the first labelled line that has one."""

    def one(line: Column, i: Column) -> Column:
        value = T.stripped(F.regexp_replace(line, strip, ""))
        following = F.try_element_at(lines, i + 2)
        return F.when(F.lower(line).rlike(label), F.when((F.length(value) > 2) & good(value), value).otherwise(F.when(nxt(following), following)))

    return F.try_element_at(F.filter(F.transform(lines, one), lambda v: v.isNotNull()), F.lit(1))


def id_name(lines: Column) -> Column:
    labelled = _labelled(
        lines, "الاسم|name", rf"(?iu)^(?:الاسم|name){S}*(?::| )*{S}*", lambda v: ~T.any_of(v, C.ADDRESS_WORDS), lambda n: n.isNotNull() & (F.length(n) > 2) & ~n.rlike(D)
    )
    anchors = ["بطاقة", "تحقيق", "الشخصية"]
    last = F.aggregate(F.transform(lines, lambda x, i: F.when(T.any_of(x, anchors), i + 1)), F.lit(0), lambda a, i: F.coalesce(i, a))
    state = F.struct(F.lit(False).alias("stop"), F.array().cast("array<string>").alias("parts"))

    def step(s: Column, line: Column) -> Column:
        skip = T.any_of(line, [*anchors, "جمهورية", "مصر"]) | F.translate(line, " ", "").rlike(r"^[23]\d{13}$")
        stop = s["stop"] | (~skip & (T.address_line(line) | T.any_of(line, ["الاسم", "العنوان"])))
        take = ~skip & ~stop & (F.length(line) >= 2)
        return F.struct(stop.alias("stop"), F.when(take, F.concat(s["parts"], F.array(line))).otherwise(s["parts"]).alias("parts"))

    below = F.when(last > 0, F.aggregate(F.slice(lines, last + 1, F.lit(5)), state, step, lambda s: F.nullif(F.array_join(s["parts"], " "), F.lit(""))))
    latin = first_where(F.slice(lines, 1, 4), lambda v: v.rlike(rf"^[A-Z][a-z]+({S}+[A-Z][a-z]+)+$"))
    return F.coalesce(labelled, below, latin)


def id_address(lines: Column) -> Column:
    labelled = _labelled(lines, "العنوان|address", rf"(?iu)^(?:العنوان|address){S}*(?::| )*{S}*", lambda v: F.lit(True), lambda n: n.isNotNull())
    state = F.struct(F.lit(False).alias("on"), F.lit(False).alias("stop"), F.array().cast("array<string>").alias("parts"))

    def step(s: Column, line: Column) -> Column:
        begins = ~s["on"] & T.address_line(line) & ~T.any_of(line, ["تحقيق", "الشخصية", "جمهورية", "الاسم"])
        ends = s["on"] & (line.rlike(rf"{L}\d{{14}}{R}") | (F.regexp_count(line, F.lit(r"\d")) >= 4) | line.rlike("^[A-Za-z0-9/$-]{5,}$"))
        stop = s["stop"] | ends
        take = ~stop & (begins | s["on"])
        return F.struct((s["on"] | begins).alias("on"), stop.alias("stop"), F.when(take, F.concat(s["parts"], F.array(line))).otherwise(s["parts"]).alias("parts"))

    return F.coalesce(labelled, F.aggregate(lines, state, step, lambda s: F.nullif(F.array_join(s["parts"], " "), F.lit(""))))


def id_birth(lines: Column) -> Column:
    """The date beside a label of the birth date or on the line after it."""
    day = lambda v: F.nullif(F.regexp_extract(v, rf"{L}({D}{{1,2}}[-/]{D}{{1,2}}[-/]{D}{{2,4}}|{D}{{4}}[-/]{D}{{1,2}}[-/]{D}{{1,2}}){R}", 1), F.lit(""))
    at = F.transform(lines, lambda v, i: F.when(T.any_of(F.lower(v), C.BIRTH_LABELS), F.coalesce(day(v), day(F.try_element_at(lines, i + 2)))))
    return F.try_element_at(F.array_compact(at), F.lit(1))


ID_CARD_STAGES = (
    lambda text, as_of: {"lines": id_lines(text)},
    lambda text, as_of: {"number": id_number(x("lines"), as_of), "name_raw": id_name(x("lines")), "address_raw": id_address(x("lines")), "born": id_birth(x("lines"))},
    lambda text, as_of: {"info": V.national_id(x("number"), as_of), "name": T.corrected_line(x("name_raw")), "address": T.corrected_line(x("address_raw")), "born_c": V.date_check(x("born"), as_of, past=True)},
)


def _id_card_fields(as_of: Column) -> list[Field]:
    info, many, born = x("info"), F.size(T.words_of(x("name"))) >= 2, x("born_c")
    derived = info["birth_date"].isNotNull()
    return [
        Field("national_id", x("number"), 0.98, True, info["reason"], seen=x("number")), Field("birth_date", F.coalesce(info["birth_date"], x("born")), F.when(derived, 0.99).when(born["valid"], 0.95).otherwise(0.50), derived | born["valid"], F.when(derived, "From the identity number").otherwise(born["reason"])),
        Field("gender", info["gender"], 0.99, True, "From the identity number"),
        Field("governorate", info["governorate"], 0.98, True, "From the identity number"), Field("governorate_code", info["governorate_code"], 0.98),
        Field("name", F.nullif(x("name"), F.lit("")), F.when(many, 0.92).otherwise(0.65), many, F.when(many, "Name of several words").otherwise("Name of one word"), seen=F.when(many, x("name"))),
        Field("address", F.nullif(x("address"), F.lit("")), 0.90, seen=x("address")),
    ]


def _some(c: Column) -> Column:
    return F.nullif(T.stripped(F.translate(c, "<", " ")), F.lit(""))


def _passport_zone(text: Column, as_of: Column) -> Found:
    lines = F.filter(T.lines_of(text), lambda v: v.contains("P<") | (v.contains("<") & (F.length(v) >= 28)))
    return {"zone": F.transform(lines, lambda v: F.translate(v, " ", ""))}


def _passport_lines(text: Column, as_of: Column) -> Found:
    first = F.when(F.size(x("zone")) >= 2, F.try_element_at(x("zone"), F.lit(-2)))
    return {"l1": F.when(first.contains("<"), first), "l2": F.when(first.contains("<"), F.try_element_at(x("zone"), F.lit(-1)))}


def _passport_read(text: Column, as_of: Column) -> Found:
    l1, l2 = x("l1"), F.when(F.length(x("l2")) >= 28, x("l2"))
    names = F.substring(l1, F.lit(6), F.length(l1))
    cut = F.position(F.lit("<<"), names)

    def day(at: int, century: Column) -> Column:
        c = F.substring(l2, at, 6)
        return F.when(c.rlike("^[0-9]{6}$"), F.concat(century, F.substring(c, 1, 2), F.lit("-"), F.substring(c, 3, 2), F.lit("-"), F.substring(c, 5, 2)))

    sex = F.substring(l2, 21, 1)
    return {
        "country": F.nullif(F.translate(F.substring(l1, 3, 3), "<", ""), F.lit("")), "surname": _some(F.when(cut > 0, F.substring(names, F.lit(1), cut - 1)).otherwise(names)),
        "given": _some(F.when(cut > 0, F.substring(names, cut + 2, F.length(names)))), "number": F.nullif(F.translate(F.substring(l2, 1, 9), "<", ""), F.lit("")),
        "checked": F.coalesce(V.mrz_check_digit(F.substring(l2, 1, 9)) == F.substring(l2, 10, 1).try_cast("int"), F.lit(False)),
        "born": day(14, F.when(F.substring(l2, 14, 2).try_cast("int") > 30, "19").otherwise("20")), "ends": day(22, F.lit("20")), "sex": F.when(sex == "M", "Male").when(sex == "F", "Female"),
    }


def _passport_seen(text: Column, as_of: Column) -> Found:
    see = lambda label: first_line(found(text, rf"(?:{label}){_EQ}{_NAME}"))
    day = lambda label: found(text, rf"(?:{label}){_EQ}({_DATE})")
    return {
        "seen_number": found(text, rf"(?:passport{S}*(?:no|number)|رقم الجواز){_EQ}([A-Z0-9]{{7,10}})"), "seen_surname": see("surname|nom|اللقب|اسم العائلة"), "seen_given": see(rf"given{S}*names?|prénoms|الاسم"),
        "seen_nation": see("nationality|nationalité|الجنسية"), "seen_country": see(rf"issuing{S}*country|country|دولة الإصدار"), "seen_sex": F.upper(found(text, rf"(?:sex|gender|sexe|النوع|الجنس){_EQ}(M|F|Male|Female|ذكر|أنثى){R}")),
        "seen_born": day(rf"date{S}*of{S}*birth|dob|né le|تاريخ الميلاد"), "issued": day(rf"date{S}*of{S}*issue|issue{S}*date|délivré le|تاريخ الإصدار"), "seen_ends": day(rf"date{S}*of{S}*expiry|expiry{S}*date|expire le|تاريخ الانتهاء"),
    }


def _passport_merged(text: Column, as_of: Column) -> Found:
    return {
        "last": F.coalesce(x("surname"), x("seen_surname")), "first": F.coalesce(x("given"), x("seen_given")), "passport": F.coalesce(x("number"), x("seen_number")), "dob": F.coalesce(x("born"), x("seen_born")), "expiry": F.coalesce(x("ends"), x("seen_ends")),
        "gender": F.coalesce(x("sex"), F.when(x("seen_sex").isin("M", "MALE", "ذكر"), "Male").when(x("seen_sex").isNotNull(), "Female")),
    }


def _passport_checked(text: Column, as_of: Column) -> Found:
    return {"dob_c": V.date_check(x("dob"), as_of, past=True), "issued_c": V.date_check(x("issued"), as_of, past=True), "expiry_c": V.date_check(x("expiry"), as_of), "number_ok": V.passport_number(x("passport"))}


def _passport_fields(as_of: Column) -> list[Field]:
    """Machine-readable lines first, labels in the visual zone for what they lack; years of two digits keep both."""
    by = lambda mine, sure, other: F.when(x(mine).isNotNull(), sure).otherwise(other)
    name = F.when(x("surname").isNotNull(), F.concat_ws(" ", x("given"), x("surname"))).otherwise(F.when(x("first").isNotNull(), F.concat_ws(" ", x("first"), x("last"))))
    ok = x("number_ok")
    sure = F.when(x("number").isNotNull(), F.when(x("checked"), 0.99).when(ok, 0.95).otherwise(0.50)).otherwise(F.when(ok, 0.95).otherwise(0.45))
    note = F.when(x("number").isNotNull() & x("checked"), "Check digit is right").when(ok, "Letters and digits of a passport number").otherwise("Unusual form")
    born = F.when(x("dob_c")["valid"], by("born", 0.99, 0.95)).otherwise(0.50)
    return [
        Field("mrz_detected", F.when(x("l1").isNotNull(), "true"), 0.99), Field("issuing_country", F.coalesce(x("country"), x("seen_country")), by("country", 0.99, 0.92)),
        Field("nationality", F.coalesce(x("country"), x("seen_nation")), by("country", 0.99, 0.92)), Field("surname", x("last"), by("surname", 0.98, 0.92)), Field("given_names", x("first"), by("given", 0.98, 0.92)),
        Field("name", name, by("surname", 0.98, F.when(x("last").isNotNull(), 0.92).otherwise(0.90))), Field("passport_number", x("passport"), sure, ok, note, seen=F.when(x("number").isNull(), x("passport"))),
        Field("date_of_birth", x("dob"), born, x("dob_c")["valid"], x("dob_c")["reason"]), Field("birth_date", x("dob"), born, x("dob_c")["valid"]), Field("sex", x("gender"), by("sex", 0.99, 0.95)), Field("gender", x("gender"), by("sex", 0.99, 0.95)),
        Field("issue_date", x("issued"), F.when(x("issued_c")["valid"], 0.95).otherwise(0.50), x("issued_c")["valid"], x("issued_c")["reason"]),
        Field("expiry_date", x("expiry"), F.when(x("expiry_c")["valid"], by("ends", 0.99, 0.95)).otherwise(0.50), x("expiry_c")["valid"], x("expiry_c")["reason"]),
    ]


def _dated(as_of: Column, past: tuple[str, ...] = (), plain: tuple[str, ...] = ()) -> Found:
    """Checks of dates that earlier stages have named."""
    return {f"{n}_c": V.date_check(x(n), as_of, past=n in past) for n in (*past, *plain)}


def _date_field(name: str, of: str, sure: float, seen: bool = False) -> Field:
    c = x(f"{of}_c")
    return Field(name, x(of), F.when(c["valid"], sure).otherwise(0.50), c["valid"], c["reason"], seen=x(of) if seen else None)


def _license(text: Column, as_of: Column) -> Found:
    return {
        "days": F.regexp_extract_all(text, F.lit(L + f"({_DATE})" + R), F.lit(1)),
        "number": F.coalesce(found(text, rf"(?:license{S}*(?:no|number)|رقم{S}*الرخصة){_EQ}([A-Za-z0-9-_]+)"), found(F.translate(text, " ", ""), rf"{L}([23]{D}{{13}}){R}")),
        "holder": first_line(found(text, rf"(?:الاسم|name){_EQ}{_NAME}")),
        "class": T.stripped(found(text, rf"(?:درجة{S}*(?:أولى|ثانية|ثالثة)|خاصة|مهنية|درجة{S}*خاصة|private|commercial|class{S}*[a-z0-9]+)", 0)),
        "blood": F.coalesce(found(text, rf"{L}(A|B|AB|O)[+-](?=[{C.WORD}])"), found(text, rf"فصيلة{S}*الدم{_EQ}([A-Za-z+-]+)")),
    }


def _license_days(text: Column, as_of: Column) -> Found:
    two = F.size(x("days")) >= 2
    return {"issued": F.when(two, F.try_element_at(x("days"), F.lit(1))), "expiry": F.when(two, F.try_element_at(x("days"), F.lit(2))).otherwise(F.try_element_at(x("days"), F.lit(1)))}


def _license_fields(as_of: Column) -> list[Field]:
    return [
        Field("license_number", x("number"), 0.95), Field("holder_name", x("holder"), 0.92, seen=x("holder")), Field("license_class", x("class"), 0.94), Field("blood_type", x("blood"), 0.95), _date_field("issue_date", "issued", 0.95), _date_field("expiry_date", "expiry", 0.95),
    ]


def _money(text: Column, pattern: str) -> Column:
    return F.translate(found(text, pattern + _AMOUNT), ",", "")


def _sums(text: Column, as_of: Column) -> Found:
    """Whether totals can be checked, and whether they are right."""
    s, t, a = (x(n).try_cast("double") for n in ("subtotal", "tax", "total"))
    return {"sums": s.isNotNull() & a.isNotNull(), "right": V.invoice_math(s, t, x("discount").try_cast("double"), a)}


def _total_field() -> Field:
    sure = F.when(x("sums"), F.when(x("right"), 0.99).otherwise(0.55)).otherwise(0.95)
    return Field("total", x("total"), sure, ~x("sums") | x("right"), F.when(x("sums"), F.when(x("right"), "Consistent totals").otherwise("Inconsistent totals")))


def _column(kind: str) -> Column:
    """Place of the table's column whose header names ``kind`` (the last of several), null if none does."""
    heads = F.try_element_at(F.col("page_table"), F.lit(1))
    kinds = F.transform(heads, lambda h: F.coalesce(*(F.when(T.any_of(F.lower(h), words), k) for k, words in C.ITEM_HEADERS.items()), F.lit("")))
    return F.aggregate(F.transform(kinds, lambda k, i: F.when(k == kind, i + 1)), F.lit(None).cast("int"), lambda a, i: F.coalesce(i, a))


def _table_rows(text: Column, as_of: Column) -> Found:
    """Rows of two cells or more below the header of the page's table, and the places of its columns."""
    rows = F.filter(F.slice("page_table", 2, F.greatest(F.size("page_table") - 1, F.lit(0))), lambda r: F.size(r) >= 2)
    return {"cells": F.coalesce(rows, F.array().cast("array<array<string>>")), **{f"at_{k}": _column(k) for k in C.ITEM_HEADERS}}


def _table_items(text: Column, as_of: Column) -> Found:
    """(description, quantity, unit price, amount) of the table's rows; description and amount fall back to the ends of the row."""
    cell = lambda r, k: F.when(x(f"at_{k}") <= F.size(r), F.try_element_at(r, x(f"at_{k}")))
    number = lambda r, k: F.regexp_replace(cell(r, k), rf"[^{D}.]", "").try_cast("double")
    item = lambda r: F.struct(
        F.coalesce(cell(r, "description"), F.try_element_at(r, F.lit(1))).alias("description"), number(r, "quantity").alias("quantity"), number(r, "unit_price").alias("unit_price"),
        F.coalesce(cell(r, "amount"), F.try_element_at(r, F.lit(-1))).alias("amount"),
    )
    return {"table": F.transform(x("cells"), item)}


_ITEM = rf"^([A-Za-z\x{{0600}}-\x{{06FF}}\s\p{{Z}}0-9]+){S}+({D}+(?:\.{D}+)?){S}*[@xX]{S}*([{D},]+(?:\.{D}{{2}})?){S}+([{D},]+(?:\.{D}{{2}})?)$"


def _invoice(text: Column, as_of: Column) -> Found:
    who = r"([A-Za-z\x{0600}-\x{06FF}0-9\s\p{Z}.&'\"-]+)"
    return {
        "number": found(text, rf"(?:invoice{S}*(?:no|number|#)|inv{S}*#|فاتورة{S}*رقم|رقم{S}*الفاتورة|(?:invoice|فاتورة)[^\n]*?(?:رقم|no|number|#)){_EQ}([A-Za-z0-9-_/]+)"),
        "made": found(text, rf"(?:invoice{S}*date|date|تاريخ{S}*الفاتورة|التاريخ){_EQ}({_DATE})"), "due": found(text, rf"(?:due{S}*date|payment{S}*due|تاريخ{S}*الاستحقاق|ميعاد{S}*السداد){_EQ}({_DATE})"),
        "seller": first_line(found(text, rf"(?:seller|vendor|from|المورد|البائع|شركة){_EQ}{who}")), "buyer": first_line(found(text, rf"(?:bill{S}*to|buyer|customer|client|العميل|المشتري|إلى|السيد){_EQ}{who}")),
        "currency": F.upper(found(text, rf"{L}(EGP|USD|EUR|GBP|SAR|AED|ج\.م|جنيه|دولار|ريال){R}")),
        "subtotal": _money(text, rf"(?:subtotal|net{S}*amount|المجموع{S}*الفرعي|الإجمالي{S}*قبل{S}*الضريبة){_EQ}"), "tax": _money(text, rf"(?:tax|vat|sales{S}*tax|ضريبة{S}*القيمة{S}*المضافة|الضريبة){_EQ}"),
        "discount": _money(text, rf"(?:discount|خصم|تخفيض){_EQ}"), "total": _money(text, rf"{L}(?:total{S}*amount|grand{S}*total|total|إجمالي|المجموع|صافي)(?:[^\n\p{{Nd}}:]*?)[:=]?{S}*"),
        "rows": F.filter(T.lines_of(text), lambda v: v.rlike(_ITEM)),
    }


def _invoice_fields(as_of: Column) -> list[Field]:
    usual = F.coalesce(x("number").rlike("^[A-Za-z0-9-_/]{3,}$"), F.lit(False))
    sure = F.when(x("sums") & x("right"), 0.98).otherwise(0.95)
    tabled = F.size(x("table")) > 0
    line = lambda g: F.transform(x("rows"), lambda v: F.translate(F.regexp_extract(v, _ITEM, g), ",", ""))
    part = lambda k, g: F.when(tabled, F.array_compact(F.transform(x("table"), lambda v: v[k].cast("string")))).otherwise(line(g))
    of_lines = F.transform(x("rows"), lambda v: F.concat_ws(" | ", *(T.stripped(F.translate(F.regexp_extract(v, _ITEM, g), ",", "")) for g in (1, 2, 3, 4))))
    items = F.when(tabled, F.transform(x("table"), lambda v: F.concat_ws(" | ", *(v[k].cast("string") for k in ("description", "quantity", "unit_price", "amount"))))).otherwise(of_lines)
    return [
        Field("invoice_number", x("number"), F.when(usual, 0.96).otherwise(0.60), usual, F.when(usual, "Letters and digits").otherwise("Unusual form"), seen=x("number")),
        _date_field("invoice_date", "made", 0.95, True), _date_field("date", "made", 0.95, True), _date_field("due_date", "due", 0.95, True),
        Field("seller", F.when(~T.any_of(F.lower(x("seller")), ["invoice", "date", "bill to", "tax"]), x("seller")), 0.92, seen=x("seller")), Field("buyer", F.when(~T.any_of(F.lower(x("buyer")), ["subtotal", "vat", "tax", "total"]), x("buyer")), 0.92, seen=x("buyer")),
        Field("currency", x("currency"), 0.98, seen=x("currency")), Field("subtotal", x("subtotal"), sure), Field("tax", x("tax"), sure), Field("discount", x("discount"), 0.95), _total_field(),
        Field("items", items, 0.92, many=True), Field("quantities", part("quantity", 2), 0.92, many=True), Field("unit_prices", part("unit_price", 3), 0.92, many=True),
    ]


_PRICED = rf"^([A-Za-z\x{{0600}}-\x{{06FF}}\s\p{{Z}}]+){S}+([{D},]+(?:\.{D}{{2}})?)$"


def _receipt(text: Column, as_of: Column) -> Found:
    stops = ["receipt", "invoice", "فاتورة", "إيصال", "order", "date", "cashier", "كاشير"]
    not_items = ["total", "subtotal", "tax", "vat", "cash", "إجمالي", "مجموع"]
    has = lambda p: F.coalesce(text.rlike(rf"(?iu){L}(?:{p}){R}"), F.lit(False))
    return {
        "merchant": first_where(F.slice(T.lines_of(text), 1, 3), lambda v: (F.size(T.words_of(v)) <= 6) & ~T.any_of(F.lower(v), stops)),
        "number": found(text, rf"(?:receipt{S}*#|ticket{S}*#|order{S}*#|طلب{S}*رقم|إيصال{S}*رقم){_EQ}([A-Za-z0-9-_]+)"), "made": found(text, rf"{L}({_DATE}){R}"),
        "time": T.stripped(found(text, rf"{L}(?:[01]?{D}|2[0-3]):[0-5]{D}(?::[0-5]{D})?{S}*(?:AM|PM|ص|م)?{R}", 0)),
        "subtotal": _money(text, rf"(?:subtotal|المجموع{S}*الفرعي){_EQ}"), "tax": _money(text, rf"(?:tax|vat|الضريبة){_EQ}"), "discount": F.lit(None).cast("string"),
        "total": _money(text, rf"{L}(?:total{S}*amount|grand{S}*total|total|amount{S}*due|المجموع{S}*الكلي|الإجمالي|المبلغ|الحساب){_EQ}"),
        "paid": F.when(has("cash|نقد|كاش|نقدى"), "Cash").when(has("visa|mastercard|mada|card|بطاقة|فيزا|ماستركارد|credit|debit"), "Card").when(has(rf"apple{S}*pay|samsung{S}*pay|mada{S}*pay|محفظة"), "Mobile Pay"),
        "currency": F.upper(found(text, rf"{L}(EGP|USD|EUR|SAR|AED|ج\.م|جنيه|ريال|درهم){R}")),
        "rows": F.filter(T.lines_of(text), lambda v: v.rlike(_PRICED) & ~T.any_of(F.lower(F.regexp_extract(v, _PRICED, 1)), not_items)),
    }


def _receipt_fields(as_of: Column) -> list[Field]:
    of_lines = F.transform(x("rows"), lambda v: F.concat_ws(" | ", T.stripped(F.regexp_extract(v, _PRICED, 1)), F.translate(F.regexp_extract(v, _PRICED, 2), ",", "")))
    of_table = F.transform(x("cells"), lambda r: F.concat_ws(" | ", F.try_element_at(r, F.lit(1)), F.try_element_at(r, F.lit(-1))))
    items = F.when(F.size(x("cells")) > 0, of_table).otherwise(of_lines)
    return [
        Field("merchant", x("merchant"), 0.92, seen=x("merchant")), Field("receipt_number", x("number"), 0.95), _date_field("date", "made", 0.96, True), Field("time", x("time"), 0.95, seen=x("time")), Field("subtotal", x("subtotal"), 0.95), Field("tax", x("tax"), 0.95),
        _total_field(), Field("payment_method", x("paid"), 0.96), Field("currency", x("currency"), 0.98), Field("items", items, 0.90, many=True),
    ]


def _contract(text: Column, as_of: Column) -> Found:
    who = r"([A-Za-z\x{0600}-\x{06FF}0-9\s\p{Z}.,]+)"
    clauses = F.regexp_extract_all(text, F.lit(rf"(?iu)(?:(?:البند|المادة|الفصل){S}*[\x{{0600}}-\x{{06FF}}0-9]+|Article{S}*{D}+|Clause{S}*{D}+)[^\n]*"), F.lit(0))
    return {
        "title": first_where(F.slice(T.lines_of(text), 1, 4), lambda v: T.any_of(v, ["عقد", "اتفاقية", "Agreement", "Contract", "Memorandum"])),
        "one": first_line(found(text, rf"(?:الطرف{S}*الأول|First{S}*Party){_EQ}{who}")), "two": first_line(found(text, rf"(?:الطرف{S}*(?:الثاني|الثانى)|Second{S}*Party){_EQ}{who}")),
        "days": F.regexp_extract_all(text, F.lit(rf"(?iu)(?:تاريخ{S}*التحرير|حرر{S}*في|الموافق|Date|dated){_EQ}({_DATE})"), F.lit(1)),
        "clauses": F.filter(F.transform(clauses, T.stripped), lambda c: (F.length(c) > 3) & (F.length(c) < 120)), "amounts": every(text, rf"[{D},]+(?:\.{D}{{1,2}})?{S}*(?:جنيه|ج\.م|EGP|USD|EUR|دولار|ريال)"),
        "signed": F.when(F.coalesce(F.col("page_signed"), F.lit(False)) | T.any_of(text, ["توقيع", "التوقيعات", "Signature", "Signatures", "Signed by"]), "true"),
    }


def _contract_fields(as_of: Column) -> list[Field]:
    return [
        Field("title", x("title"), 0.95, seen=x("title")), Field("first_party", x("one"), 0.92, seen=x("one")), Field("second_party", x("two"), 0.92, seen=x("two")), Field("parties", F.array_compact(F.array(x("one"), x("two"))), 0.92, many=True),
        _date_field("date", "made", 0.96), Field("dates", F.array_distinct(x("days")), 0.95, many=True), Field("clauses", F.slice(x("clauses"), 1, 15), 0.94, many=True), Field("amounts", F.slice(x("amounts"), 1, 5), 0.93, many=True),
        Field("signatures_detected", x("signed"), 0.95),
    ]


# Skills and languages that CVs are searched for.
SKILLS = [
    "python", "javascript", "typescript", "c++", "c#", "java", "php", "ruby", "go", "rust", "scala", "sql", "postgresql", "mysql", "mongodb", "redis", "elasticsearch", "docker", "kubernetes", "aws", "azure", "gcp", "cloud",
    "react", "angular", "vue", "next.js", "node.js", "fastapi", "django", "flask", "spring boot", "machine learning", "deep learning", "nlp", "computer vision", "tensorflow", "pytorch", "opencv", "scikit-learn", "git", "linux",
    "agile", "scrum", "ci/cd", "html", "css", "tailwind", "rest api", "graphql", "devops", "microservices", "برمجة", "تحليل البيانات", "إدارة المشاريع", "تصميم", "ذكاء اصطناعي",
]
LANGUAGES = ["arabic", "english", "french", "german", "spanish", "italian", "russian", "chinese", "japanese", "العربية", "الإنجليزية", "الفرنسية", "الألمانية"]


def _terms(low: Column, terms: list[str]) -> Column:
    """Terms with a boundary of words at both ends, in capitals if short, else as titles."""

    def hit(term: str) -> Column:
        pattern = "".join(f"\\{c}" if not c.isalnum() and c != " " else c for c in term)
        ends = R if term[-1].isalnum() else rf"(?=[{C.WORD}])"
        return F.when(low.contains(term) & low.rlike(L + pattern + ends), term.title() if len(term) > 3 else term.upper())

    return F.array_compact(F.array(*map(hit, terms)))


def _cv(text: Column, as_of: Column) -> Found:
    stops = ["curriculum", "resume", "cv", "page", "profile", "contact"]
    return {
        "low": F.lower(text), "name": first_where(F.slice(T.lines_of(text), 1, 4), lambda v: ~v.contains("@") & ~T.any_of(F.lower(v), stops) & F.size(T.words_of(v)).between(2, 5) & (F.length(v) < 45)),
        "mail": F.nullif(F.regexp_extract(text, L + C.EMAIL + R, 0), F.lit("")), "phone": T.stripped(F.nullif(F.regexp_extract(text, f"{C.PHONE_MOBILE}{R}|{C.PHONE_INTERNATIONAL}", 0), F.lit(""))),
        "links": every(text, r"(?iu)(?:https?://)?(?:www\.)?(?:linkedin\.com/in/[A-Za-z0-9_-]+|github\.com/[A-Za-z0-9_-]+|[A-Za-z0-9_-]+\.github\.io)"),
        "summary": T.stripped(found(text, rf"(?:summary|professional{S}*summary|profile|about{S}*me|نبذة{S}*شخصية|نبذة{S}*عني){S}*[:\n]{S}*([^\n]+(?:\n[^\n]+){{1,3}})")),
        "education": F.regexp_extract_all(text, F.lit(r"(?iu)(?:Bachelor|Master|PhD|B\.Sc|M\.Sc|BSc|MSc|بكالوريوس|ماجستير|دكتوراه|جامعة|University|Faculty of)[^\n]+"), F.lit(0)),
        "section": found(text, rf"(?:experience|work{S}*experience|employment{S}*history|خبرات{S}*العمل|الخبرات{S}*المهنية){S}*[:\n]{S}*([^\n]+(?:\n[^\n]+){{1,6}})"),
        "roles": F.transform(F.regexp_extract_all(text, F.lit(rf"(?iu)(?:Senior|Lead|Junior|Staff|Principal)?{S}*(?:Software{S}*Engineer|Developer|Data{S}*Scientist|Manager|Consultant|Architect|مهندس|مطور)[^\n]*"), F.lit(0)), T.stripped),
        "certs": F.regexp_extract_all(text, F.lit(rf"(?iu)(?:(?:AWS|Azure|Google{S}*Cloud|GCP|PMP|Scrum|Cisco|CCNA){S}*Certified[^\n]*|شهادة{S}*[^\n]+)"), F.lit(0)),
        "place": found(text, rf"{L}(Cairo|Giza|Alexandria|Egypt|القاهرة|الجيزة|الإسكندرية|مصر){R}"),
    }


def _cv_work(text: Column, as_of: Column) -> Found:
    stops = ["skills", "education", "certifications", "languages", "مهارات", "تعليم"]
    return {
        "jobs": F.slice(F.filter(T.lines_of(x("section")), lambda v: ~T.any_of(F.lower(v), stops)), 1, 5), "other_roles": F.slice(F.array_distinct(F.filter(x("roles"), lambda v: x("summary").isNull() | ~F.contains(x("summary"), v))), 1, 5),
        "skills": _terms(x("low"), SKILLS), "languages": _terms(x("low"), LANGUAGES), "link_text": F.nullif(F.array_join(x("links"), " "), F.lit("")),
    }


def _cv_fields(as_of: Column) -> list[Field]:
    listed = x("section").isNotNull() & (F.size(x("jobs")) > 0)
    contact = F.array_compact(F.array(*(F.when(x(c).isNotNull(), F.concat(F.lit(f"{k}="), x(c))) for k, c in (("email", "mail"), ("phone", "phone"), ("links", "link_text"), ("location", "place")))))
    mail, phone = V.email(x("mail")), V.phone(x("phone"))
    return [
        Field("name", x("name"), 0.94, seen=x("name")), Field("email", x("mail"), F.when(mail, 0.98).otherwise(0.50), mail, seen=x("mail")), Field("phone", x("phone"), F.when(phone, 0.95).otherwise(0.50), phone, seen=x("phone")), Field("links", x("links"), 0.95, many=True),
        Field("contact_information", contact, 0.95, many=True), Field("summary", x("summary"), 0.90), Field("education", F.transform(F.slice(x("education"), 1, 5), T.stripped), 0.92, many=True),
        Field("experience", F.when(listed, x("jobs")).otherwise(x("other_roles")), F.when(listed, 0.92).otherwise(0.90), many=True), Field("skills", x("skills"), 0.95, many=True),
        Field("certifications", F.array_distinct(F.transform(F.slice(x("certs"), 1, 5), T.stripped)), 0.92, many=True), Field("languages", F.array_distinct(x("languages")), 0.95, many=True),
    ]


def bank_document_fields(text: Column, as_of: Column) -> list[Field]:
    return [
        Field("bank_name", first_where(F.slice(T.lines_of(text), 1, 4), lambda v: T.any_of(F.lower(v), ["bank", "بنك", "مصرف", "al ahly", "cib", "qnb", "misr"]))),
        Field("iban", F.nullif(F.regexp_extract(F.translate(text, " ", ""), rf"{L}([A-Z]{{2}}{D}{{2}}[A-Z0-9]{{11,30}}){R}", 1), F.lit(""))),
        Field("account_number", found(text, rf"(?:account{S}*(?:no|number)|رقم{S}*الحساب){_EQ}([0-9-]{{8,20}})")), Field("swift_bic", found(text, rf"(?:swift|bic){S}*(?:code)?{_EQ}([A-Z]{{6}}[A-Z0-9]{{2}}(?:[A-Z0-9]{{3}})?)")),
        Field("balance", _money(text, rf"(?:balance|closing{S}*balance|الرصيد|الرصيد{S}*الختامي|الرصيد{S}*الحالي){_EQ}")), Field("currency", F.upper(found(text, rf"{L}(EGP|USD|EUR|GBP|SAR|AED|ج\.م|جنيه|دولار|ريال){R}"))),
    ]


def _day(text: Column) -> Field:
    return Field("date", found(text, rf"{L}({_DATE}){R}"))


def form_fields(text: Column, as_of: Column) -> list[Field]:
    lines = T.lines_of(text)
    pairs = F.filter(lines, lambda v: v.contains(":"))

    def pair(x: Column) -> Column:
        at = F.position(F.lit(":"), x)
        key = T.stripped(F.substring(x, F.lit(1), at - 1))
        return F.when(F.size(T.words_of(key)).between(1, 4), F.concat_ws("=", key, T.stripped(F.substring(x, at + 1, F.length(x)))))

    return [Field("form_title", F.try_element_at(lines, F.lit(1))), Field("form_fields", F.array_compact(F.transform(pairs, pair)), many=True)]


def report_fields(text: Column, as_of: Column) -> list[Field]:
    return [Field("report_title", F.try_element_at(T.lines_of(text), F.lit(1))), _day(text), Field("author", first_line(found(text, rf"(?:prepared{S}*by|author|إعداد|بواسطة){_EQ}{_NAME}")))]


def certificate_fields(text: Column, as_of: Column) -> list[Field]:
    return [
        Field("title", first_where(F.slice(T.lines_of(text), 1, 3), lambda v: T.any_of(F.lower(v), ["certificate", "شهادة", "تقدير", "diploma", "award"]))),
        Field("recipient", first_line(found(text, rf"(?:awarded{S}*to|certified{S}*that|منحت{S}*(?:إلى|للسيد|للطالب)|تشهد{S}*بأن){_EQ}{_NAME}"))), _day(text),
    ]


def letter_fields(text: Column, as_of: Column) -> list[Field]:
    return [Field("recipient", first_line(found(text, rf"(?:السيد{S}*/|عناية{S}*/|to{S}*:|dear{S}+){_NAME}"))), Field("subject", T.stripped(found(text, rf"(?:الموضوع|subject|re){_EQ}([^\n]+)"))), _day(text)]


def screenshot_fields(text: Column, as_of: Column) -> list[Field]:
    return [
        Field("detected_urls", every(text, r"(?:https?://[^\s\p{Z}]+|www\.[^\s\p{Z}]+)"), many=True),
        Field("detected_timestamps", every(text, rf"{L}(?:[01]?{D}|2[0-3]):[0-5]{D}{S}*(?:AM|PM|am|pm)?{R}"), many=True),
    ]


def table_fields(text: Column, as_of: Column) -> list[Field]:
    lines = T.lines_of(text)
    first = F.try_element_at(lines, F.lit(1))
    piped = F.filter(F.transform(F.split(first, r"\|"), T.stripped), lambda v: v != "")
    rows = F.greatest(F.lit(0), F.size(lines) - 1)
    return [Field("headers", F.when(F.size(piped) > 0, piped).otherwise(T.words_of(first)), many=True), Field("row_count", F.when(rows > 0, rows.cast("string")))]


def _simple(fields: Callable[[Column, Column], list[Field]]) -> Extractor:
    """An extractor whose values need no stage."""
    return Extractor((), lambda as_of: fields(F.col("text"), as_of))


GENERIC = Extractor((_generic,), _generic_fields)
_EXTRACTORS: dict[str, Extractor] = {
    "id_card": Extractor(ID_CARD_STAGES, _id_card_fields),
    "passport": Extractor((_passport_zone, _passport_lines, _passport_read, _passport_seen, _passport_merged, _passport_checked), _passport_fields),
    "invoice": Extractor((_invoice, lambda text, as_of: _dated(as_of, plain=("made", "due")) | _sums(text, as_of) | _table_rows(text, as_of), _table_items), _invoice_fields),
    "receipt": Extractor((_receipt, lambda text, as_of: _dated(as_of, past=("made",)) | _sums(text, as_of) | _table_rows(text, as_of)), _receipt_fields),
    "contract": Extractor((_contract, lambda text, as_of: {"made": F.try_element_at(x("days"), F.lit(1))}, lambda text, as_of: _dated(as_of, plain=("made",))), _contract_fields),
    "cv": Extractor((_cv, _cv_work), _cv_fields),
    "driver_license": Extractor((_license, _license_days, lambda text, as_of: _dated(as_of, past=("issued",), plain=("expiry",))), _license_fields),
    "bank_document": _simple(bank_document_fields), "form": _simple(form_fields), "report": _simple(report_fields), "certificate": _simple(certificate_fields), "letter": _simple(letter_fields),
    "screenshot": _simple(screenshot_fields), "table": _simple(table_fields),
}


def register(category: str, extractor: Extractor) -> None:
    """Adds or replaces the specialised extractor of a category."""
    _EXTRACTORS[category] = extractor


def registered() -> dict[str, Extractor]:
    return dict(_EXTRACTORS)


#: The day that validity counts from, where none is given.
AS_OF = "2026-01-01"
KEYS = ("doc_id", "page_number")
ENTRY = ("field_name", "seq", "value", "confidence", "is_valid", "note")


def _entries(f: Field) -> Column:
    """A field's values as an array of rows."""
    values = f.value if f.many else F.when(f.value.isNotNull(), F.array(f.value.cast("string")))
    sure = _lit(f.confidence, "double")
    if f.seen is not None:
        snippet = F.lower(T.stripped(f.seen.cast("string")))
        line = F.try_element_at(F.filter("page_lines", lambda v: F.contains(F.lower(v["text"]), snippet)), F.lit(1))
        sure = F.when((snippet != "") & (line["confidence"] > 0), line["confidence"]).otherwise(sure)

    def row(value: Column, i: Column) -> Column:
        return F.struct(
            F.lit(f.name).alias("field_name"), i.alias("seq"), value.alias("value"), sure.alias("confidence"), F.coalesce(_lit(f.valid, "boolean"), F.lit(False)).alias("is_valid"), _lit(f.note, "string").alias("note")
        )

    return F.transform(F.coalesce(values.cast("array<string>"), F.array().cast("array<string>")), row)


def _base(pages: DataFrame, *more: str) -> DataFrame:
    """Pages with text, with null for parts of LAYOUT that they lack."""
    return pages.where(T.filled(F.col("text"))).select(*KEYS, "text", *more, *(F.col(c).cast(kind).alias(c) if c in pages.columns else F.lit(None).cast(kind).alias(c) for c, kind in LAYOUT.items()))


def _staged(base: DataFrame, extractor: Extractor, day: Column, only: Column | None = None) -> tuple[DataFrame, Column]:
    """The pages with the extractor's stages as columns, and the array of its fields; null on pages other than ``only``."""
    held = lambda c: c if only is None else F.when(only, c)
    for stage in extractor.stages:
        base = base.withColumns({f"x{_OWN[-1]}_{n}": held(c) for n, c in stage(F.col("text"), day).items()})
    return base, held(F.filter(F.flatten(F.array(*map(_entries, extractor.fields(day)))), lambda f: f["value"].isNotNull()))


def eav(pages: DataFrame, extractor: Extractor, source: str, name: str, as_of: str = AS_OF) -> DataFrame:
    """Rows (keys, source, extractor, field_name, seq, value, confidence, is_valid, note) of one extractor.

    Null values and empty lists give no row; null and empty texts have no fields. Pages may have the columns of LAYOUT:
    a field's confidence is then the one of the first line that holds it, and items are read from the table.
    """
    base, found = _staged(_base(pages), extractor, F.lit(as_of).cast("date"))
    return base.select(*KEYS, F.explode(found).alias("f")).select(*KEYS, F.lit(source).alias("source"), F.lit(name).alias("extractor"), "f.*")


def generic(pages: DataFrame, as_of: str = AS_OF) -> DataFrame:
    return eav(pages, GENERIC, "generic", "generic", as_of)


def extract(classified: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """Fields of classified pages: generic for all, specialised by category, the specialised ones before the generic.

    One pass: every extractor's columns stand in one chain of projections and are null on pages of other categories; the
    fields of a page are one array, in which generic ones give way, so nothing is shuffled or read twice.
    """
    day, special = F.lit(as_of).cast("date"), []
    base, general = _staged(_base(classified, "category"), GENERIC, day)
    base = base.select(*KEYS, "text", "category", *LAYOUT, general.alias("_general"))
    for category, extractor in _EXTRACTORS.items():
        _OWN.append(f"_{category}")
        try:
            base, found = _staged(base, extractor, day, F.col("category") == category)
        finally:
            _OWN.pop()
        special.append(found)
    base = base.select(*KEYS, "category", "_general", F.coalesce(*special).alias("_special"))
    told = lambda array, source, name: F.transform(array, lambda f: F.struct(source.alias("source"), name.alias("extractor"), *(f[c].alias(c) for c in ENTRY)))
    special = F.coalesce("_special", F.array().cast(base.schema["_special"].dataType))
    names = F.transform(special, lambda f: f["field_name"])
    rest = F.filter("_general", lambda f: ~F.array_contains(names, f["field_name"]))
    both = F.concat(told(rest, F.lit("generic"), F.lit("generic")), told(special, F.lit("specialised"), F.col("category")))
    return base.select(*KEYS, F.explode(both).alias("f")).select(*KEYS, "f.*")


def with_layout(pages: DataFrame, page_lines: DataFrame, cells: DataFrame, signed: DataFrame | None = None) -> DataFrame:
    """Pages with the columns of LAYOUT: their lines in order, the rows of their table (``layout.tables``), and whether they
    are signed (``layout.page_info``)."""
    lines = page_lines.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("line_number", "text", "confidence"))).alias("_l"))
    lines = lines.select(*KEYS, F.transform("_l", lambda v: F.struct(v["text"].alias("text"), v["confidence"].alias("confidence"))).alias("page_lines"))
    rows = cells.groupBy(*KEYS, "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda c: c["text"]).alias("_r"))
    rows = rows.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "_r"))), lambda r: r["_r"]).alias("page_table"))
    out = pages.join(lines, list(KEYS), "left").join(rows, list(KEYS), "left")
    return out if signed is None else out.join(signed.select(*KEYS, F.col("has_signatures").alias("page_signed")), list(KEYS), "left")


def table_items(pages: DataFrame) -> DataFrame:
    """(keys, seq, cells, description, quantity, unit_price, amount) of the rows of pages' tables (``with_layout``)."""
    base = _base(pages)
    for stage in (_table_rows, _table_items):
        base = base.withColumns({f"x_{n}": c for n, c in stage(F.col("text"), F.lit(None)).items()})
    each = base.select(*KEYS, F.posexplode(F.arrays_zip(x("cells").alias("cells"), x("table").alias("item"))).alias("seq", "r"))
    return each.select(*KEYS, "seq", "r.cells", "r.item.*")


def merged(fields: DataFrame) -> DataFrame:
    """Fields of several sources (keys, source, field_name, ...): of a field of a page those of the source that is last by
    name (specialised before generic) stay."""
    rank = F.dense_rank().over(W.partitionBy(*KEYS, "field_name").orderBy(F.col("source").desc()))
    return fields.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def structured(fields: DataFrame, page_confidence: Column | float = 1.0) -> DataFrame:
    """Fields with label, language and direction of their value; without a confidence of their own they take the page's."""
    value = T.normalized(F.col("value"))
    return fields.withColumns({
        "label": T.title_case(F.col("field_name")), "language": T.language(value)["lang"], "direction": T.direction(value), "confidence": F.coalesce("confidence", _lit(page_confidence, "double")),
    })


def provenance(fields: DataFrame, page_lines: DataFrame) -> DataFrame:
    """Adds source_line, left, top, right, bottom: the first line that holds the value, else the first that holds the label.

    Lines of a page are gathered once and filtered per field, so nothing multiplies fields with lines.
    """
    held = page_lines.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("line_number", F.lower("text").alias("text"), "left", "top", "right", "bottom", "confidence"))).alias("_lines"))
    joined = fields.join(held, list(KEYS), "left")
    value, label = F.lower(T.stripped(F.col("value"))), F.lower(T.title_case(F.col("field_name")))
    by = lambda needle: F.try_element_at(F.filter("_lines", lambda v: F.contains(v["text"], needle)), F.lit(1))
    source = F.when(value != "", F.coalesce(by(value), by(label)))
    out = joined.withColumn("_at", source)
    new = ("source_line", "left", "top", "right", "bottom", "line_confidence")
    return out.select(*(c for c in fields.columns if c not in new), F.col("_at.line_number").alias("source_line"), "_at.left", "_at.top", "_at.right", "_at.bottom", F.when(F.col("_at.confidence") > 0, F.col("_at.confidence")).alias("line_confidence"))


def legacy_id(pages: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """One row per page with the fixed columns of identity cards, null where not found."""
    fixed = ["national_id", "name", "address", "birth_date", "gender", "governorate_code", "governorate"]
    rows = eav(pages, _EXTRACTORS["id_card"], "specialised", "id_card", as_of)
    wide = rows.groupBy(*KEYS).pivot("field_name", fixed).agg(F.first("value"))
    return pages.select(*KEYS).distinct().join(wide, list(KEYS), "left")
