"""The grammar of dates, form by form."""

import pytest

from loomwork.functions import dates as D

FORMS = [
    ("3 May 2020", (2020, 5, 3)), ("3rd of may", (None, 5, 3)), ("3rd may '99", (1999, 5, 3)), ("Sat, 03 Aug 2001 04:05:06 +0900", (2001, 8, 3, 4, 5, 6, 540)),
    ("May 3, 2020", (2020, 5, 3)), ("september 3rd", (None, 9, 3)), ("Posted on Jan 5, 44 BC", (-43, 1, 5)), ("5 jan 44 b.c.", (-43, 1, 5)), ("5 jan bc 44", (-43, 1, 5)), ("may 3 AD 99", (1999, 5, 3)),
    ("2001-02-03", (2001, 2, 3)), ("2001-02-03T04:05:06Z", (2001, 2, 3, 4, 5, 6, 0)), ("2001-02-03 04:05 EST", (2001, 2, 3, 4, 5, None, -300)), ("03-02-2001", (2001, 2, 3)), ("-2001-02-03", (-2001, 2, 3)),
    ("2001-W05-6", (2001, 2, 3)), ("2001w056", (2001, 2, 3)), ("2001-W05", (2001, 1, 29)), ("2001-034", (2001, 2, 3)), ("2001034", (2001, 2, 3)), ("--02-03", (None, 2, 3)), ("--0203", (None, 2, 3)),
    ("H13.02.03", (2001, 2, 3)), ("s44.7.20", (1969, 7, 20)), ("R2.05.01", (2020, 5, 1)),
    ("3-Feb-2001", (2001, 2, 3)), ("Feb-3-2001", (2001, 2, 3)), ("2001/02/03", (2001, 2, 3)), ("3/2/2001", (2001, 2, 3)), ("01/02", (2001, 2, None)), ("2001.02.03", (2001, 2, 3)), ("3.2.2001", (2001, 2, 3)),
    ("20010203", (2001, 2, 3)), ("20010203T040506", (2001, 2, 3)), ("010203", (2001, 2, 3)), ("690203", (1969, 2, 3)), ("01034", (2001, 2, 3)), ("0203", (None, 2, 3)), ("03", (None, None, 3)),
    ("in May", (None, 5, None)), ("the 21st", (None, None, 21)), ("class of '99", (1999, None, None)),
    ("10:20:30.5 pm GMT+2", (None, None, None, 22, 20, 30, 120)), ("12 am", (None, None, None, 0, None, None, None)), ("4h30m", (None, None, None, 4, 30, None, None)), ("10:20 -0330", (None, None, None, 10, 20, None, -210)),
    ("no date", None), ("", None), (None, None), ("x" * 129 + " 2001-02-03", None), ("2001-02-03" + " " * 119, None), ("2001-02-03" + " " * 118, (2001, 2, 3)),
]


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(FORMS)], "i int, t string")
    return {r.i: r.d for r in df.select("i", D.parsed_date(df.t).alias("d")).collect()}


@pytest.mark.parametrize("i", range(len(FORMS)), ids=[str(t)[:30] for t, _ in FORMS])
def test_form(parsed, i):
    want = FORMS[i][1]
    assert parsed[i] is None if want is None else tuple(parsed[i]) == want + (None,) * (7 - len(want))
