from datetime import UTC, datetime

import pytest
from dateutil import parser
from pyspark.sql import functions as F

from lodestone.functions.dates import read
from lodestone.functions.schema import MetadataField, normalized, problem

GOOD = [
    "2024-03-05", "2024-03-05T10:20:30Z", "2024-03-05 10:20:30.75", "2024-03-05T10:20:30+02:00", "Oct 3 1998", "October 3, 1998", "oct. 3rd, 1998", "3 Oct 1998", "03-OCT-1998", "3rd of", "Sat, 3 Oct 1998 10:00:00 +0200",
    "Saturday October 3, 1998 4:05 PM", "Sept 9 2020", "2024/03/05", "2024.3.5", "2024/03/05 23:59", "10/03/1998", "13/02/2020", "02-13-2020 12:00 am", "12/31/1999 12:30pm", "19981003", "May 5 2021 7pm", "1 June 2021 00:00:01",
]
BAD = ["", "x", "32 Oct 1998", "Foo 3 1998", "13/13/2020", "Oct 1998 or so", "Feb 30 2021", "99999999", "Oct 3 1998 25:00", "Oct 3 1998 tomorrow", "3rd of"]


@pytest.fixture
def utc(spark):
    kept = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    yield spark
    spark.conf.set("spark.sql.session.timeZone", kept)


def test_forms_of_stored_dates(utc):
    texts = [t for t in GOOD if t not in BAD]
    rows = utc.createDataFrame([(t,) for t in texts], "t string").select("t", F.unix_seconds(read(F.col("t"))).alias("s")).collect()
    for r in rows:
        want = parser.parse(r["t"], default=datetime(2000, 1, 1)).replace(microsecond=0)
        want = want if want.tzinfo else want.replace(tzinfo=UTC)
        assert r["s"] == int(want.timestamp()), r["t"]


def test_what_is_no_date(utc):
    rows = utc.createDataFrame([(t,) for t in BAD] + [(None,)], "t string")
    assert [r["t"] for r in rows.where(read(F.col("t")).isNotNull()).collect()] == []
    made = MetadataField("made", "datetime")
    told = utc.createDataFrame([("Oct 3 1998",), ("Oct 3",)], "t string").select(normalized(made, F.col("t")).isNotNull().alias("ok"), problem(made, F.col("t")).alias("p")).collect()
    assert [tuple(r) for r in told] == [(True, None), (False, "made: not a valid datetime")]
