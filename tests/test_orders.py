"""Evidence to orders, their de-duplication and output."""

from pyspark.sql import functions as F

from orderloom.operators import merge, orders, sets, stages

ITEM = "doc_id long, ord string, fund_code string, fund_name string, base_date string, t_day int, slot_id string, evidence_label string, transfer_amount string, settle_class string, order_type string, reason_code string"


def items(spark, rows):
    return spark.createDataFrame([(1, f"{i:03d}", code, name, "2025-11-28", 0, "T0", label, amount, None, kind, None) for i, (code, name, label, amount, kind) in enumerate(rows)], ITEM)


def result(spark, rows):
    c = orders.live(orders.candidates(items(spark, rows)))
    return sorted((r.fund_code, r.order_type, r.transfer_amount, r.conflict) for r in orders.aggregate(c).collect())


def test_two_directions_without_net_stay_apart(spark):
    got = result(spark, [("F001", "A", "입금액", "100", None), ("F001", "A", "출금액", "40", None), ("F002", "B", "출금액", "200", None)])
    assert got == [("F001", "RED", "-40", False), ("F001", "SUB", "100", False), ("F002", "RED", "-200", False)]


def test_net_evidence_wins(spark):
    assert result(spark, [("F1", "A", "설정금액", "100", None), ("F1", "A", "해지금액", "40", None), ("F1", "A", "정산액", "60", "SUB")]) == [("F1", "SUB", "60", False)]
    assert result(spark, [("F1", "A", "설정금액", "100", None), ("F1", "A", "정산액", "-7", None), ("F1", "A", "정산액", "100", "SUB")]) == [("F1", "SUB", "100", False)]
    assert result(spark, [("F1", "A", "설정금액", "90", None), ("F1", "A", "정산액", "-7", None), ("F1", "A", "정산액", "100", "SUB")]) == [("F1", "RED", "-7", True)]


def test_same_evidence_counts_once(spark):
    assert result(spark, [("F1", "A", "설정금액", "23,213.4", None), ("F1", "A  ", "설정금액", "23,213.40", None)]) == [("F1", "SUB", "23,213.4", False)]
    assert result(spark, [("F1", "A", "설정금액", "10", None), ("F1", "A", "매입금액", "10", "SUB")]) == [("F1", "SUB", "20", False)]


def test_what_is_no_candidate(spark):
    c = orders.candidates(items(spark, [(None, "A", "설정금액", "1", None), ("F1", "A", "좌수", "1", None), ("F1", "A", "설정금액", "-", None), ("F1", "A", "설정금액", "0.00", None), ("F1", "A", "기타", "5", None), ("F1", "A", None, "+5.5", None)]))
    got = [r.drop_reason for r in c.orderBy("ord").collect()]
    assert got == ["FUND_METADATA_INCOMPLETE", "NON_AMOUNT_EVIDENCE_DROPPED", "TRANSFER_AMOUNT_MISSING", "ZERO_AMOUNT", "ORDER_TYPE_MISSING", None]
    assert orders.aggregate(orders.candidates(items(spark, [])).drop("drop_reason")).count() == 0


PAYLOAD = "payload_id long, run_no int, file_name string, source_path string, model_name string, base_date string, status string, reason string, issues array<string>, orders array<struct<fund_code: string, fund_name: string, settle_class: string, order_type: string, base_date: string, t_day: string, transfer_amount: string>>, finished_at timestamp"


def payloads(spark):
    o = lambda amount, kind="3": ("F1", "A", "2", kind, "2025-11-28", "01", amount)
    rows = [
        (1, 1, "a.xlsx", "/a", "m", None, "COMPLETED", None, ["X"], [o("9")], None),
        (1, 2, "a.xlsx", "/a", "m", "2025-11-28", "COMPLETED", None, ["X"], [o("23,213.40"), o("23,213.4"), o("5", "1")], None),
        (1, 2, "a.xlsx", "/a", "m", "2025-11-28", "COMPLETED", None, ["X"], [o("23,213.40"), o("23,213.4"), o("5", "1")], None),
        (2, 1, "b.xlsx", "/b", "m", "2025-11-28", "COMPLETED", None, [], [o("23213.4")], None),
        (3, 1, "c.xlsx", "/c", "m", None, "SKIPPED", "r", [], [], None),
    ]
    return spark.createDataFrame(rows, PAYLOAD)


def test_merging_documents(spark):
    last = merge.latest(payloads(spark))
    assert sorted((r.payload_id, r.run_no) for r in last.collect()) == [(1, 2), (2, 1), (3, 1)]
    got = sorted((r.order_type, r.transfer_amount, r.first_file, r.copies) for r in merge.merged(last).collect())
    assert got == [("1", "5", "a.xlsx", 1), ("3", "23,213.40", "a.xlsx", 3)]
    one = merge.summary(last).first()
    assert (one.file_count, one.status, one.n_orders, one.model_name, one.issues, one.reasons, one.first_base_date, one.first_file) == (3, "COMPLETED", 4, "m", "X", "r", "2025-11-28", "a.xlsx")
    assert merge.flat(last).count() == 4


def test_output_codes_and_positions(spark):
    df = spark.createDataFrame([(1, "a", "F1", "A", "CONFIRMED", "RED", "2025-11-28", 0, "-1,000.00"), (1, "b", "12", "B", "PENDING", "SUB", None, 9, "+5"), (1, "c", "3", "C", "PENDING", "SUB", None, None, "7.50")], "doc_id long, ord string, fund_code string, fund_name string, settle_class string, order_type string, base_date string, t_day int, transfer_amount string")
    out = orders.output_form(df)
    assert [tuple(r[4:]) for r in out.orderBy("ord").collect()] == [("2", "1", "2025-11-28", "01", "1,000"), ("1", "3", None, "10", "5"), ("1", "3", None, None, "7.50")]
    assert [r.ord for r in orders.sort_position(out, ["doc_id"]).orderBy("position").collect()] == ["a", "c", "b"]
    assert [(r.ord, r.settle_class) for r in orders.only_pending(df).collect()] == [("a", "PENDING")]


def test_multisets(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (1, None), (2, "y")], "d long, k string")
    b = spark.createDataFrame([(1, "x"), (1, None), (3, "z")], "d long, k string")
    got = {r.d: (r.only_left, r.only_right, r.shared) for r in sets.multiset_difference(a, b, "d", ["k"]).collect()}
    assert got == {1: (1, 0, 2), 2: (1, 0, 0), 3: (0, 1, 0)}


class Flaky:
    """Fails once in transport, then answers nonsense, then the items with an issue, then the items."""

    def __init__(self):
        self.calls = 0

    def answer(self, stage, prompt, rows):
        import json

        self.calls += 1
        if self.calls == 1:
            raise TimeoutError("slow")
        if self.calls == 2:
            return "no json"
        if self.calls == 3:
            return json.dumps({"items": rows[:1], "issues": ["LOST"]})
        return json.dumps({"items": [{**x, "settle_class": "PENDING"} for x in rows], "issues": []})


def test_retries_only_improve():
    rows = [{"ord": "1", "settle_class": None}, {"ord": "2", "settle_class": None}]
    got, issues, bad = stages.ask(Flaky(), "settle_class", "p", rows)
    assert [x["settle_class"] for x in got] == ["PENDING", "PENDING"] and issues == [] and bad == ["no json"]


def test_stage_over_batches(spark):
    df = spark.createDataFrame([(1, f"{i:03d}", f"T{i % 2}_SUB", None) for i in range(30)], "doc_id long, ord string, slot_id string, settle_class string")
    out = stages.run_stage(df, "settle_class")
    assert out.count() == 3
    got = stages.unpacked(out, "ord string, slot_id string, settle_class string").collect()
    assert len(got) == 30 and all(r.settle_class == ("CONFIRMED" if r.slot_id.startswith("T0") else "PENDING") for r in got)
    assert [r.n for r in stages.batches(df, "t_day").groupBy("batch").agg(F.count("*").alias("n")).orderBy("batch").collect()] == [6] * 5
