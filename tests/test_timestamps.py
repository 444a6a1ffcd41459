import random
from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pandas as pd
import pytest

from folioscope.operators import timestamps as T


@pytest.mark.parametrize(
    ("value", "days"),
    [
        ("2020-07-19", {"2020-07-19"}), ("03/04/2020", {"2020-04-03", "2020-03-04"}), ("13/04/2020", {"2020-04-13"}), ("20201231", {"2020-12-31"}), ("201231", {"2020-12-31"}), ("43919", {"2020-03-29"}), ("1583662218", {"2020-03-08"}),
        ("1583662218000", {"2020-03-08"}), ("2021-W01-1", {"2021-01-04"}), ("٢٣/٠٤/٢٠٢٢", {"2022-04-23"}), ("2O19-O7-2O", {"2019-07-20"}), ("le 1er mars 2019", {"2019-03-01"}), ("27 JUN/JUI 2024", {"2024-06-27"}), ("14th of February 2029", {"2029-02-14"}),
        ("den 7. August 2022", {"2022-08-07"}), ("٣٠ يونيو، ٢٠٢٢", {"2022-06-30"}), ("2019-02-20T02:40:37-05:00", {"2019-02-20"}), ("30.02.2020", set()), ("??/05/2021", set()), ("n/a", set()), ("", set()), (None, set()), ("9" * 5000, set()),
    ],
)
def test_readings(value, days):
    assert {r[1] for r in T.readings(value)} == days


@pytest.mark.parametrize(
    ("value", "expected"),
    [("1:53 AM", (6780, None)), ("12:27:00am", (1620, None)), ("١:٠٧ م", (13 * 3600 + 420, None)), ("03h07", (11220, None)), ("0627", (23220, None)), ("13:48:49,726", (49729, None)), ("07:26 UTC+01:00", (26760, 60)), ("17:22 +0530", (62520, 330)),
     ("04:18:23 UTC", (15503, 0)), ("03:27 (CEST)", (12420, 120)), ("11:00 Uhr", (39600, None)), ("25:00", None), ("see above", None), (None, None)],
)
def test_clock(value, expected):
    assert T.clock(value) == expected


def test_mixture_prefers_the_declared_order_and_learns_without_it():
    counts = pd.DataFrame({"signature": ["dmy|mdy", "dmy", "mdy"], "n": [10, 8, 1]})
    assert T.mixture(counts, "mdy").set_index("signature")["format"]["dmy|mdy"] == "mdy"
    learnt = T.mixture(counts, None).set_index("signature")
    assert learnt["format"]["dmy|mdy"] == "dmy" and learnt["posterior"]["dmy|mdy"] > 0.8
    open_ = T.mixture(pd.DataFrame({"signature": ["dmy|mdy"], "n": [3]}), None)
    assert open_["posterior"][0] < T.DECIDED


def test_held_out_orders_are_learnt_and_little_evidence_is_marked():
    """Sources without a declared order: many clear values decide, few leave the mark, and contrary ones do not settle it."""
    rng = random.Random(1)
    for order, other in (("dmy", "mdy"), ("mdy", "dmy")):
        many = pd.DataFrame({"signature": ["dmy|mdy", order, other], "n": [rng.randrange(50, 90), rng.randrange(60, 99), 1]})
        chosen = T.mixture(many, None).set_index("signature")
        assert chosen["format"]["dmy|mdy"] == order and chosen["posterior"]["dmy|mdy"] >= T.DECIDED
        even = T.mixture(pd.DataFrame({"signature": ["dmy|mdy", order, other], "n": [3, 2, 2]}), None).set_index("signature")
        assert even["posterior"]["dmy|mdy"] < T.DECIDED


def test_paper_dates(spark):
    fields = [
        (1, "ReceiptExtractor", "date", "31/03/2019"), (1, "ReceiptExtractor", "time", "02:30"), (2, "ReceiptExtractor", "date", "27/10/2019"), (2, "ReceiptExtractor", "time", "02:30"), (3, "InvoiceExtractor", "invoice_date", "03/04/2020"),
        (3, "InvoiceExtractor", "invoice_date", "03/04/2020"), (4, "InvoiceExtractor", "invoice_date", "03/04/2020"), (5, "PassportExtractor", "expiry_date", None), (6, "ReceiptExtractor", "date", "2020-01-01"), (7, "ReceiptExtractor", "time", "10:00"),
        (8, "ReceiptExtractor", "date", "2020-01-01 10:00:00+02:00"),
    ]
    f = spark.createDataFrame(fields, "doc_id BIGINT, extractor STRING, field_name STRING, value STRING")
    u = spark.createDataFrame([(i, "A" if i != 4 else "B") for i in range(1, 9)] + [(1, "A")], "doc_id BIGINT, station_id STRING")
    s = spark.createDataFrame([("A", "Europe/Berlin", "dmy"), ("B", "America/Chicago", "mdy")], "station_id STRING, zone STRING, date_order STRING")
    found = {(r.doc_id, r.field): r.norm for r in T.paper_dates(f, u, s).select("doc_id", "field", "norm").distinct().collect()}
    berlin = ZoneInfo("Europe/Berlin")
    skipped = datetime(2019, 3, 31, 2, 30, tzinfo=berlin).astimezone(timezone.utc)
    repeated = datetime(2019, 10, 27, 2, 30, tzinfo=berlin, fold=0).astimezone(timezone.utc)
    assert found == {
        (1, "receipt"): skipped.strftime("%Y-%m-%dT%H:%M:%SZ"), (2, "receipt"): repeated.strftime("%Y-%m-%dT%H:%M:%SZ"), (3, "invoice_date"): "2020-04-03", (4, "invoice_date"): "2020-03-04", (6, "receipt"): "2020-01-01",
        (8, "receipt"): "2020-01-01T08:00:00Z",
    }


def test_empty(spark):
    f = spark.createDataFrame([], "doc_id BIGINT, extractor STRING, field_name STRING, value STRING")
    u, s = spark.createDataFrame([], "doc_id BIGINT, station_id STRING"), spark.createDataFrame([], "station_id STRING, zone STRING, date_order STRING")
    assert T.paper_dates(f, u, s).count() == 0
