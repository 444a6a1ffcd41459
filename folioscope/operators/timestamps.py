"""Dates and times in mixed formats to one unambiguous form.

Every value is read under each format that can hold it. The formats valid for a value form its *signature*; per source
(the station that scanned the paper) an expectation-maximisation over the counts of signatures estimates the mixture of
formats, with the station's declared numeric order as Dirichlet prior of a few values, and the posterior chooses the
reading. What stays under DECIDED is marked ``ambiguous``. The estimate sees (source, signature, count), no single values.

Defined results: null, blank, placeholder, partly unreadable (``??/05/2021``) and impossible dates give no row; digits
of any script and the look-alikes O/o and l/I inside digits count as digits; a time without a date gives no row; a wall
time of an unknown zone gives the date only; repeated rows count once; a repeated wall time is the earlier instant and
a skipped one is read with the offset before the change.
"""

from __future__ import annotations

import re
import unicodedata
from datetime import date, datetime, timedelta
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.plans.materialize import cut

# Names of months by number.
MONTHS = {
    1: "january jan janvier januar jänner enero janv ene يناير",
    2: "february feb février fevrier fév fev févr februar febrero فبراير",
    3: "march mar mars märz maerz mrz marzo مارس",
    4: "april apr avril avr abril abr أبريل ابريل إبريل",
    5: "may mai mayo مايو",
    6: "june jun juin jui juni junio يونيو يونيه",
    7: "july jul juillet juil jui juli julio يوليو يوليه",
    8: "august aug août aout aoû agosto ago أغسطس اغسطس",
    9: "september sep sept septembre septiembre set سبتمبر",
    10: "october oct octobre oktober okt octubre أكتوبر اكتوبر",
    11: "november nov novembre noviembre نوفمبر",
    12: "december dec décembre decembre déc dezember dez diciembre dic ديسمبر",
}
MONTH: dict[str, frozenset[int]] = {}
for _number, _names in MONTHS.items():
    for _name in _names.split():
        MONTH[_name] = MONTH.get(_name, frozenset()) | {_number}
# Minutes east of UTC of zone abbreviations.
ZONES = {
    "utc": 0, "gmt": 0, "z": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180, "msk": 180, "gst": 240,
    "ist": 330, "aest": 600, "aedt": 660, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
}
#: Years a reading may fall in.
YEARS = range(1900, 2100)
#: Day and second counts stand for dates from 2000 to 2069 and 2001 to 2069.
SERIAL_DAYS, EPOCH_SECONDS = range(36526, 62093), range(978307200, 3155760000)
#: Values that the declared order of a source counts as, beside those observed.
PRIOR = 8.0
#: Change of the mixture under which the estimation ends.
SETTLED = 1e-9
#: Posterior under which the choice between readings stays marked as ambiguous.
DECIDED = 0.9

_DASHES = re.compile(r"[‐-―−­]")
_INVISIBLE = re.compile(r"[​-‏‪-‮⁦-⁩﻿ـ]")
_LETTERS = re.compile(r"[^\W\d_]+")
_OFFSET = r"(?:(?P<abbr>utc|gmt)?\s*(?P<sign>[+\-])(?P<oh>\d{1,2}):?(?P<om>\d{2})?|\(?(?P<zone>[a-z]{1,4})\)?)"
_CLOCK = re.compile(
    r"^(?:(?P<h>\d{1,2})\s*[:.h]\s*(?P<m>\d{2})(?:[:.](?P<s>\d{2})(?:[.,]\d+)?)?|(?P<h4>\d{2})(?P<m4>\d{2})(?P<s4>\d{2})?)"
    r"\s*(?P<half>a\.?m\.?|p\.?m\.?|ص|م)?\s*(?:uhr|hrs|h)?\s*(?:" + _OFFSET + r")?$"
)
_ISO = re.compile(r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:t|\s+)(.+)$")
_COMPACT = re.compile(r"^(\d{4})(\d{2})(\d{2})(?:t|\s+)(\d.+)$")


def plain(value: str) -> str:
    """Lower case, ASCII digits, one kind of dash, look-alikes inside numbers repaired, blanks collapsed."""
    text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", value))
    text = "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in text)
    text = _DASHES.sub("-", text).replace("،", ",")
    if not any(len(w) > 2 and w.strip("OoIlL") for w in _LETTERS.findall(text)):
        text = re.sub(r"(?<![^\W\d_])[OoIl]+(?![^\W\d_])|(?<=\d)[OoIl]+|[OoIl]+(?=\d)", lambda m: m[0].translate(str.maketrans("OoIl", "0011")), text)
    return re.sub(r"\s+", " ", text).strip().lower()


def _day(year: int, month: int, day: int) -> str | None:
    try:
        return date(year, month, day).isoformat() if year in YEARS else None
    except ValueError:
        return None


@lru_cache(200_000)
def clock(value: str | None) -> tuple[int, int | None] | None:
    """(second of the day, offset in minutes or None) of a time of day."""
    if value is None or not (m := _CLOCK.match(plain(value))):
        return None
    g = m.groupdict()
    hour, minute, second = int(g["h"] or g["h4"]), int(g["m"] or g["m4"]), int(g["s"] or g["s4"] or 0)
    if g["half"]:
        if not 1 <= hour <= 12:
            if hour > 23 or hour == 0:
                return None
        else:
            hour = hour % 12 + 12 * (g["half"][0] in "pم")
    if hour > 23 or minute > 59 or second > 59:
        return None
    if g["sign"]:
        return hour * 3600 + minute * 60 + second, (1 if g["sign"] == "+" else -1) * (int(g["oh"]) * 60 + int(g["om"] or 0))
    if g["zone"]:
        return (hour * 3600 + minute * 60 + second, ZONES[g["zone"]]) if g["zone"] in ZONES else None
    return hour * 3600 + minute * 60 + second, None


@lru_cache(200_000)
def readings(value: str | None) -> tuple[tuple[str, str, int | None, int | None], ...]:
    """(format, date, second of the day, offset) of every valid reading, by format name."""
    if value is None or not (text := plain(value)):
        return ()
    for pattern in (_ISO, _COMPACT):
        if (m := pattern.match(text)) and (day := _day(int(m[1]), int(m[2]), int(m[3]))):
            at = clock(m[4])
            return (("iso_datetime", day, *at),) if at else ()
    if text.isdecimal():
        if len(text) > 13:
            return ()
        n = int(text)
        if len(text) == 8:
            found = [("ymd_digits", _day(n // 10000, n // 100 % 100, n % 100))]
        elif len(text) == 6:
            found = [("ymd_digits", _day(2000 + n // 10000, n // 100 % 100, n % 100))]
        elif len(text) == 5 and n in SERIAL_DAYS:
            found = [("serial_days", (date(1899, 12, 30) + timedelta(n)).isoformat())]
        elif len(text) in (10, 13) and (n := n // 1000 if len(text) == 13 else n) in EPOCH_SECONDS:
            at = datetime(1970, 1, 1) + timedelta(seconds=n)
            return (("epoch", at.date().isoformat(), n % 86400, 0),)
        else:
            found = []
        return tuple((f, d, None, None) for f, d in found if d)
    if m := re.match(r"^(\d{4})-?w(\d{1,2})-?([1-7])$", text):
        try:
            return (("iso_week", date.fromisocalendar(int(m[1]), int(m[2]), int(m[3])).isoformat(), None, None),)
        except ValueError:
            return ()
    if m := re.match(r"^(\d{1,4}) ?([./\-]) ?(\d{1,2}) ?\2 ?(\d{1,4})$", text):
        a, b, c = m[1], m[3], m[4]
        if len(a) == 4 and len(c) <= 2:
            found = [("ymd", _day(int(a), int(b), int(c)))]
        elif len(a) <= 2 and len(c) in (2, 4):
            year = int(c) + 2000 * (len(c) == 2)
            found = [("dmy", _day(year, int(b), int(a))), ("mdy", _day(year, int(a), int(b)))]
        else:
            found = []
        return tuple((f, d, None, None) for f, d in found if d)
    words = _LETTERS.findall(text)
    named = [MONTH[w] for w in words if w in MONTH]
    months = set(frozenset.intersection(*named)) if named else set()  # JUN/JUI: the abbreviation shared by two months follows the other
    if len(months) == 1 and "?" not in text:
        numbers = re.findall(r"\d+", text)
        if len(numbers) == 2:
            day, year = (numbers[1], numbers[0]) if len(numbers[0]) == 4 else numbers
            if len(day) <= 2 and len(year) in (2, 4) and (d := _day(int(year) + 2000 * (len(year) == 2), months.pop(), int(day))):
                return (("month_name", d, None, None),)
    return ()


_READINGS = "ARRAY<STRUCT<format STRING, day STRING, second INT, offset INT>>"


def _readings_of(column: str) -> Column:
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("format", "day", "second", "offset"), r)) for r in readings(v)] for v in values])

    return F.pandas_udf(run, _READINGS)(column)


def _clock_of(column: str) -> Column:
    def run(values: pd.Series) -> pd.DataFrame:
        found = [clock(v) or (None, None) for v in values]
        return pd.DataFrame({"second": pd.array([a for a, _ in found], "Int32"), "offset": pd.array([b for _, b in found], "Int32")})

    return F.pandas_udf(run, "STRUCT<second INT, offset INT>")(column)


def mixture(counts: pd.DataFrame, declared: str | None) -> pd.DataFrame:
    """EM over one source's counts of signatures (sets of formats): each signature's best format and its posterior.

    A value is as likely under each of its readings as the format's share of the source, which the declared order raises
    by PRIOR values. Without any evidence the readings stay equal and the value ambiguous. Of equal readings the first
    by name is given.
    """
    formats = sorted({f for s in counts.signature for f in s.split("|")})
    valid = np.array([[f in s.split("|") for f in formats] for s in counts.signature], float)
    prior = np.array([PRIOR if f == declared else 0.0 for f in formats])
    n, weight = counts.n.to_numpy(float)[:, None], np.full(len(formats), 1 / len(formats))
    while True:
        posterior = valid * weight
        posterior /= posterior.sum(1, keepdims=True)
        new = (posterior * n).sum(0) + prior + 1e-9
        new /= new.sum()
        settled, weight = np.abs(new - weight).max() < SETTLED, new
        if settled:
            break
    posterior = valid * weight
    posterior /= posterior.sum(1, keepdims=True)
    best = posterior.argmax(1)
    return pd.DataFrame({"signature": counts.signature.to_numpy(), "format": [formats[i] for i in best], "posterior": posterior.max(1)})


def resolve_dates(values: DataFrame, source: str, order: str) -> DataFrame:
    """Adds ``day, second, offset, format, posterior, ambiguous`` to rows with a ``value``; rows without a date stay out.

    ``source`` names the column of the mixture's source, ``order`` the one of its declared numeric order (may be null).
    """
    read = values.withColumn("_all", _readings_of("value")).where(F.size("_all") > 0)
    # read once: both the counts and the rows below come from here
    read = cut(read.withColumn("_signature", F.array_join(F.transform("_all", lambda r: r["format"]), "|")))
    counts = read.groupBy(F.col(source).alias("_source"), F.col(order).alias("_order"), F.col("_signature").alias("signature")).agg(F.count("*").alias("n"))

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return mixture(part, key[1]).assign(_source=key[0], _order=key[1])[["_source", "_order", "signature", "format", "posterior"]]

    chosen = counts.groupBy("_source", "_order").applyInPandas(fit, "_source STRING, _order STRING, signature STRING, format STRING, posterior DOUBLE")
    joined = read.join(chosen, read[source].eqNullSafe(chosen["_source"]) & read[order].eqNullSafe(chosen["_order"]) & (read["_signature"] == chosen["signature"]))
    pick = F.filter("_all", lambda r: r["format"] == F.col("format"))[0]
    return (
        joined.withColumn("_pick", pick)
        .select(*(c for c in values.columns if c not in ("day", "second", "offset", "format", "posterior", "ambiguous")), "_pick.day", "_pick.second", "_pick.offset", "format", "posterior", (F.col("posterior") < DECIDED).alias("ambiguous"))
    )


def instant(day: Column, second: Column, offset: Column, zone: Column) -> Column:
    """The UTC instant as text, or the day alone without a time; a wall time in a zone follows the rules above."""
    wall = F.timestamp_add("SECOND", second, F.to_timestamp_ntz(day))
    utc = F.when(offset.isNotNull(), F.timestamp_add("MINUTE", -offset, wall)).otherwise(F.convert_timezone(zone, F.lit("UTC"), wall))
    return F.when(second.isNull() | (offset.isNull() & zone.isNull()), day).otherwise(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def paper_dates(fields: DataFrame, uploads: DataFrame, stations: DataFrame) -> DataFrame:
    """Invoice, expiry and receipt dates of papers: doc_id, field, norm, format, posterior, ambiguous."""
    kinds = {("InvoiceExtractor", "invoice_date"): "invoice_date", ("PassportExtractor", "expiry_date"): "expiry_date", ("ReceiptExtractor", "date"): "receipt"}
    kind = F.coalesce(*(F.when((F.col("extractor") == e) & (F.col("field_name") == f), F.lit(k)) for (e, f), k in kinds.items()))
    dates = fields.select("doc_id", kind.alias("field"), "value").where("field IS NOT NULL AND value IS NOT NULL").distinct()
    places = uploads.groupBy("doc_id").agg(F.min("station_id").alias("station_id")).join(F.broadcast(stations.select("station_id", "zone", "date_order")), "station_id", "left")
    times = fields.where("extractor = 'ReceiptExtractor' AND field_name = 'time' AND value IS NOT NULL").select("doc_id", F.col("value").alias("time")).distinct()
    times = times.select("doc_id", F.lit("receipt").alias("field"), _clock_of("time").alias("clock")).where("clock.second IS NOT NULL")
    found = resolve_dates(dates.join(places, "doc_id", "left"), "station_id", "date_order").join(times, ["doc_id", "field"], "left")
    own = F.col("second").isNotNull()
    second, offset = F.when(own, F.col("second")).otherwise(F.col("clock.second")), F.when(own, F.col("offset")).otherwise(F.col("clock.offset"))
    norm = F.when(F.col("field") == "receipt", instant(F.col("day"), second, offset, F.col("zone"))).otherwise(F.col("day"))
    return found.select("doc_id", "field", norm.alias("norm"), "format", "posterior", "ambiguous")
