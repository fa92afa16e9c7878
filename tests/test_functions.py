"""Column expressions on tables of inputs and results."""

import pytest
from pyspark.sql import functions as F

from orderloom.functions import amounts, dates, jsons, labels, text


def column(spark, values, *fs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [tuple(r[1:]) for r in sorted(df.select("i", *(f(F.col("v")).alias(f"c{k}") for k, f in enumerate(fs))).collect())]


def test_amount_texts(spark):
    cases = {
        "23,213.4": ("23,213.4", "23,213.4"), "23,213.40": ("23,213.4", "23,213.40"), "70,000,000.00000001": ("70,000,000", "70,000,000"), "-1,000.00": ("-1,000", "-1,000"),
        "0019.9999999": ("20", "20"), "+5": ("5", "5"), "-0.0": ("0", "0"), "007.50": ("7.5", "7.50"), "1,2,3": ("123", "123"), " 1 000 ": ("1,000", "1,000"), "0.123456": ("0.123456", "0.123456"),
        "-": (None, None), "N/A": (None, None), "": (None, None), "1e5": (None, None), "12a": (None, None), "1234567890123": ("1,234,567,890,123", "1,234,567,890,123"),
    }
    assert column(spark, list(cases), amounts.canonical, amounts.source) == list(cases.values())
    assert column(spark, [None], amounts.canonical, amounts.source) == [(None, None)]


def test_document_numbers(spark):
    got = column(spark, ["1.5억", "3만", "KRW 1,000", "₩5천", "1억5천", "-", "2,000 원", "abc"], lambda c: amounts.document_number(c).cast("decimal(18,2)").cast("string"), amounts.is_zero)
    assert got == [("150000000.00", False), ("30000.00", False), ("1000.00", False), ("5000.00", False), (None, False), (None, True), ("2000.00", False), (None, False)]


def test_signs_and_output(spark):
    df = spark.createDataFrame([("40", "RED"), ("-40", "RED"), ("40", "SUB"), ("+40.50", "SUB"), (None, "RED"), ("x", "RED")], "a string, t string")
    assert [str(r[0]) if r[0] is not None else None for r in df.select(amounts.signed(F.col("a"), F.col("t")).cast("decimal(9,1)")).collect()] == ["-40.0", "-40.0", "40.0", "40.5", None, None]
    assert [r[0] for r in df.select(amounts.output(F.col("a"), F.col("t"))).collect()] == ["40", "40", "40", "40.50", None, "x"]


def test_dates(spark):
    cases = {"2025-11-28": "2025-11-28", "20251128": "2025-11-28", "2025.1.8": "2025-01-08", "11-28-2025": "2025-11-28", "27-Nov-25": "2025-11-27", "1-jan-70": "1970-01-01", "기준일 2024/3/5 확정": "2024-03-05", "20259999": "2025-99-99", "none": None, "": None}
    assert [x[0] for x in column(spark, list(cases), dates.normalize)] == list(cases.values())
    assert [x[0] for x in column(spark, ["2025-99-99", "2024-02-29"], lambda c: dates.typed(c).cast("string"))] == [None, "2024-02-29"]


def test_buckets(spark):
    cases = {"T+2 예정": "T+2", "D+1(예상금액)": "T+1", "익익영업일": "T+2", "제 3 영업일": "T+3", "T일": "T0", "3월 9일 설정": "M03D09", "2024-05-06": "2024-05-06", "결제금액": "T0", "비고": "COL_7"}
    assert [x[0] for x in column(spark, list(cases), lambda c: dates.bucket_key(c, F.lit(7)))] == list(cases.values())
    got = column(spark, ["3월19일", "T+4", "비고"], lambda c: dates.days_ahead(c, F.lit("2026-03-18")))
    assert [x[0] for x in got] == [1, 4, None]


@pytest.mark.parametrize(
    "label,direction,kind,schedule",
    [("설정금액", "SUB", "explicit", False), ("환매 예정", "RED", "other", True), ("정산액", None, "execution", False), ("Subscription", "SUB", "explicit", False), ("설정/해지", None, "other", False), ("당일이체금액", None, "execution", False), ("", None, "other", False)],
)
def test_labels(spark, label, direction, kind, schedule):
    assert column(spark, [label], labels.direction, labels.evidence_kind, labels.is_schedule) == [(direction, kind, schedule)]


def test_text_helpers(spark):
    assert column(spark, ["  a \t b ", "A / B"], text.squeeze, text.join_split_name) == [("a b", "  a \t b "), ("A / B", "A B")]
    assert column(spark, ["Ab-1 가(H)", None], text.name_key) == [("ab1가h",), ("",)]
    assert column(spark, [" table row! ", "--", "x" * 80], text.reason_code) == [("TABLE_ROW",), (None,), ("X" * 64,)]
    df = spark.createDataFrame([(["T_DAY_MISSING_FOR_6114", "B:1"],)], "i array<string>")
    assert df.select(text.has_issue(F.col("i"), "T_DAY_MISSING"), text.has_issue(F.col("i"), "B"), text.without_issue(F.col("i"), "B")).first()[:3] == (True, True, ["T_DAY_MISSING_FOR_6114"])


def test_answers_of_models():
    assert jsons.recover_one('<think>{"a": 1}</think> so: {"b": "}{"} end') == '{"b": "}{"}'
    assert jsons.recover_one('```json\n{"a": [1]}\n```') == '{"a": [1]}'
    assert jsons.recover_one("[1, 2]") is None and jsons.recover_one("{broken") is None and jsons.recover_one(None) is None
