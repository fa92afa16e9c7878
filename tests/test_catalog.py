"""Every query of the core against its SQL in DuckDB, on the smallest tables; streams; the entry."""

import glob
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orderloom.operators import orders
from orderloom.plans import catalog
from orderloom.sources import mail
from orderloom.streaming import landing

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(df):
    def one(v):
        if isinstance(v, list) or hasattr(v, "tolist") and not isinstance(v, str):
            return str(list(v)) if hasattr(v, "__len__") else str(v)
        return None if v is None or v is pd.NaT or v is pd.NA or v != v else str(v)

    df = df[sorted(df.columns)]
    return sorted(str([one(v) for v in r]) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, duck, name):
    got = catalog.queries()[name](spark, DATA).toPandas()
    want = duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    ours, theirs = rows(got), rows(want)
    assert [x.replace(".0'", "'") for x in ours] == [x.replace(".0'", "'") for x in theirs]


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_the_rest_runs(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0


def test_sql_belongs_to_queries():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_html_round_trip_loses_no_cell(spark):
    r = catalog.queries()["html_round_trip"](spark, DATA).agg(F.sum("n_cells"), F.sum("n_same")).first()
    assert r[0] == r[1] > 0


def test_streams_equal_batches(spark, tmp_path):
    q = landing.drain(landing.windowed_counts(landing.table_stream(spark, DATA, "events"), "ts", "event_type"), str(tmp_path / "o"), str(tmp_path / "c"))
    assert q.exception() is None
    e = spark.read.parquet(f"{DATA}/events.parquet").withColumn("start", F.date_trunc("day", F.col("ts").cast("timestamp")))
    want = {(r["start"], r.event_type): r.n for r in e.groupBy("start", "event_type").agg(F.count("*").alias("n")).collect()}
    got = {(r["start"], r.event_type): r.n for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert got and all(want[k] == n for k, n in got.items())
    landing.drain(landing.windowed_counts(landing.table_stream(spark, DATA, "events"), "ts", "event_type"), str(tmp_path / "o"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == len(got)  # a second run adds nothing


def test_streams_of_many_files_equal_batches(spark, tmp_path):
    """More files than one micro-batch takes, the latest rows first."""
    for name, time in (("events", "ts"), ("order_extractions", "extracted_at")):
        t = spark.read.parquet(f"{DATA}/{name}.parquet")
        t.repartitionByRange(70, F.desc(time)).write.parquet(str(tmp_path / f"{name}.parquet"))
        assert len(glob.glob(str(tmp_path / f"{name}.parquet" / "*.parquet"))) > 64
    e = spark.read.parquet(f"{DATA}/events.parquet").groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("start"), "event_type").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, catalog.queries()["stream_event_counts"](spark, str(tmp_path)).collect())) == sorted(map(tuple, e.collect()))
    o = orders.output_identity(orders.output_form(spark.read.parquet(f"{DATA}/order_extractions.parquet").select("order_id", *orders.OUTPUT)))
    o = o.dropDuplicates([f"i_{c}" for c in orders.OUTPUT]).groupBy("settle_class", "order_type").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, catalog.queries()["stream_first_orders"](spark, str(tmp_path)).collect())) == sorted(map(tuple, o.collect()))


def test_mail_dates_anywhere_in_the_header(spark, tmp_path):
    head = ["[EML x.eml]", "Subject: 운용지시", "From: A <a@x.example>", *(f"X-{i}: y" for i in range(9)), "Date: Mon, 13 May 2024 22:25 +0000", "Date (Asia/Seoul): 2024-05-14"]
    texts = ["\n".join([*head, "", "body"]), "\n".join([*head[:3], "", "Date: Mon, 13 May 2024 22:25 +0000"]), "no header", ""]
    p = spark.createDataFrame([(i, "x.eml", "message/rfc822", t) for i, t in enumerate(texts)], "payload_id long, file_name string, content_type string, raw_text string")
    p.write.parquet(str(tmp_path / "task_payloads.parquet"))
    got = {r.payload_id: r.day for r in catalog.queries()["mail_headers"](spark, str(tmp_path)).collect()}
    assert got == {0: "2024-05-14", 1: None, 2: None, 3: None}
    back = mail.read_eml(mail.rebuild(texts[0]), "x.eml").split("\n")
    assert back == ["[EML x.eml]", *head[1:3], *head[-2:], "", "body"]
