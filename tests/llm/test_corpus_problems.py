"""Copies, packing, leaked items and shared spans against brute force on small tables."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderloom.llm import p1_hidden_copies as p1
from orderloom.llm import p2_split_items as p2
from orderloom.llm import p3_new_text as p3
from orderloom.llm import p4_encoding as p4
from orderloom.llm import p5_lookalikes as p5
from orderloom.llm import p6_packing as p6
from orderloom.llm import p7_leaked_items as p7
from orderloom.llm import p8_shared_spans as p8
from orderloom.llm.shared import checkpointed

DOCS = "doc_id long, text string, h string, gram string"
ORDERS = "order_id long, fund_code string, fund_name string, settle_class string, order_type string, base_date string, t_day int, transfer_amount string, record_text string, h1 string"


def brute_spans(docs, window):
    where = collections.defaultdict(set)
    for d, t in docs:
        for i in range(len(t or "") - window + 1):
            where[t[i : i + window]].add(d)
    out = set()
    for d, t in docs:
        at = [i for i in range(len(t or "") - window + 1) if len(where[t[i : i + window]]) > 1]
        runs = []
        for i in at:
            if runs and i <= runs[-1][1]:
                runs[-1][1] = i + window
            else:
                runs.append([i, i + window])
        out |= {(d, a + 1, b) for a, b in runs}
    return out


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    words = ["펀드", "order", "금액", "sell", "ß", "𝄞", "ab"]
    make = lambda n: " ".join(r.choice(words) + str(r.randrange(99)) for _ in range(n))
    clause, other = make(40), make(25)
    docs = [(i, make(r.randrange(0, 50))) for i in range(1, 40)]
    docs += [(50, make(9) + clause + make(9)), (51, clause), (52, make(5) + clause[:150] + make(4)), (53, other + make(3) + other), (54, make(4) + other + clause)]
    docs += [(60, docs[3][1]), (61, docs[3][1]), (70, None), (71, ""), (72, "x" * 400), (73, "x" * 330), (74, make(3000))]
    return docs


def test_shared_spans_equal_brute_force(spark, texts):
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in texts] + [(None, "z" * 500, "x", "y")], DOCS)
    got = {tuple(r) for r in p8.shared_spans(df.select("doc_id", "text"), 60, 24).collect()}
    assert got == brute_spans(texts, 60)


def test_shared_spans_of_nothing(spark):
    assert p8.shared_spans(spark.createDataFrame([], DOCS).select("doc_id", "text")).count() == 0


def test_a_third_of_copies_is_one_group(spark, texts):
    docs = [*texts, *((1000 + i, texts[5][1] + "tail" * 20) for i in range(30))]
    df = spark.createDataFrame([(d, t, "", "") for d, t in docs], DOCS)
    assert {tuple(r) for r in p8.shared_spans(df.select("doc_id", "text"), 60, 24).collect()} == brute_spans(docs, 60)


def words_of(t):
    return re.findall(r"[^\W_]+", (t or "").casefold())


def test_leaked_items_equal_brute_force(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["Größe", "펀드코드", "Σας", "İstan"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(3, 30)))) for i in range(30)] + [(90, None), (91, "")]
    docs = []
    for d in range(120):
        text = [r.choice(vocabulary) for _ in range(r.randrange(0, 40))]
        if d % 3 == 0:
            src = (items[d % 30][1] or "").split()
            a = r.randrange(0, max(1, len(src) - 12))
            text[5:5] = [x.upper() if r.random() < 0.3 else x for x in src[a : a + r.choice([11, 12, 14])]]
        docs.append((d, r.choice([" ", " | ", "\n", "_"]).join(text)))
    docs += [(500, None), (501, "")]
    want = set()
    grams = lambda w: {tuple(w[i : i + 12]) for i in range(len(w) - 11)}
    per_item = {i: grams(words_of(t)) for i, t in items}
    for d, t in docs:
        g = grams(words_of(t))
        want |= {(d, i) for i, q in per_item.items() if g & q}
    df = spark.createDataFrame([(d, t, "", "") for d, t in docs], DOCS)
    it = spark.createDataFrame(items, "item_id long, item_text string")
    index = checkpointed(p7.build_index(df, shard_bytes=600))
    assert index.count() > 3
    assert {tuple(x) for x in p7.leaked(index, it).collect()} == want
    assert {tuple(x) for x in p7.leaked(index, it, most=900).collect()} == want  # blocks of items, long ones cut
    near = {tuple(x) for x in p7.leaked(index, it, slop=2).collect()}
    brute = {(d, i) for d, t in docs for i, q in items if close(words_of(t), words_of(q), 2)}
    assert want <= near == brute and len(near) > len(want)
    assert p7.leaked(index, it.limit(0)).count() == 0 and p7.leaked(p7.build_index(df.limit(0)), it).count() == 0


def close(doc, item, slop):
    """Is there a window of 12 words of the item and a place where each of them lies within `slop` of its own place?"""
    where = collections.defaultdict(list)
    for p, w in enumerate(doc):
        where[w].append(p)
    for a in range(len(item) - 11):
        window = item[a : a + 12]
        if all(w in where for w in window):
            for start in range(-slop, len(doc)):
                if all(any(abs(p - start - k) <= slop for p in where[w]) for k, w in enumerate(window)):
                    return True
    return False


def test_proximity_lets_words_lie_apart(spark):
    item = "a1 b2 c3 d4 e5 f6 g7 h8 i9 j10 k11 l12"
    moved = item.replace("f6 g7", "g7 f6")
    df = spark.createDataFrame([(1, item), (2, moved), (3, "a1 b2 c3")], "doc_id long, text string")
    it = spark.createDataFrame([(7, item)], "item_id long, item_text string")
    assert {r.doc_id for r in p7.leaked(p7.build_index(df), it).collect()} == {1}
    assert {r.doc_id for r in p7.leaked(p7.build_index(df), it, slop=1).collect()} == {1, 2}


def test_proximity_stays_within_a_document(spark):
    one, two = "a1 b2 c3 d4 e5 f6 g7 h8 i9 j10 k11 l12", "m1 n2 o3 p4 q5 r6 s7 t8 u9 v10 w11 x12"
    opening = one.replace("a1 b2", "b2 a1")  # b2, the rarest, is the document's first word
    df = spark.createDataFrame([(1, "x a1"), (2, opening), (3, two[:17]), (4, two[18:])], "doc_id long, text string").coalesce(1)
    it = spark.createDataFrame([(7, one), (8, two)], "item_id long, item_text string")
    assert [tuple(r) for r in p7.leaked(p7.build_index(df), it, slop=2).collect()] == [(2, 7)]


@pytest.mark.parametrize("lengths", [np.random.default_rng(1).integers(1, 2049, 5000), np.full(100, 1025), np.full(10, 2048), np.arange(1, 2049), np.array([], int)])
def test_packing(lengths):
    bins = p6.pack(lengths)
    total = np.bincount(bins, weights=lengths) if len(lengths) else np.zeros(0)
    assert (bins >= 0).all() and (total <= 2048).all() and (total > 0).all()
    if len(lengths) > 1000:
        assert lengths.sum() / (len(total) * 2048) > 0.97


def test_containers(spark):
    docs = [(i, "order sheet " * (i % 50 + 1)) for i in range(300)] + [(900, None), (901, ""), (902, "long text " * 3000), (1, "order sheet order sheet ")]
    got = p6.containers(spark.createDataFrame([(d, t, "", "") for d, t in docs], DOCS), per_worker=100).collect()
    room = collections.Counter()
    for r in got:
        assert (r.container is None) == (r.n_tokens == 0)
        if r.container is not None:
            room[r.container] += r.n_tokens
    assert max(room.values()) <= 2048
    long = sorted((r.piece_no, r.start_token, r.n_tokens) for r in got if r.doc_id == 902)
    assert len(long) > 1 and all(n == 2048 for _, _, n in long[:-1]) and [s for _, s, _ in long] == [2048 * i for i in range(len(long))]
    assert sum(r.doc_id < 900 for r in got) == 301


WRITINGS = {
    "code": ["XV-3938", "xv 3938", "(XV3938)", "XV_39.38"],
    "name": ["온새미 중소형주 - Acc", "온새미중소형주acc", "[온새미  중소형주 - ACC],"],
    "amount": ["-1,234.50", "- 1234.5", "-1'234.500", "-1,23 4.5"],
}


def test_amount_hashes_and_comparison_agree():
    import pyarrow as pa

    same = ["1,000", "+1000.00", "01 000", "1'000.", "1000"]
    other = ["-1,000", "1,000.01", "10000", "100", "0", "abc", ""]
    h = [tuple(x) for x in zip(*(a.tolist() for a in p1.amount_hashes(pa.array(same + other))))]
    assert len(set(h[: len(same)])) == 1 and len(set(h)) == 1 + len(other)
    for a in same:
        assert all(p1.same_amount(a, b) for b in same) and not any(p1.same_amount(a, b) for b in other)
    assert p1.same_amount("0.00", "-0") and p1.same_amount(".50", "0.5") and not p1.same_amount("5", "50")
    assert p1.same_text("Größe-1", "GRÖSSE 1") and not p1.same_text("ab", "abc") and p1.same_text("", "-- ")


def test_copies_of_records(spark, monkeypatch):
    r = random.Random(2)
    rows, sets = [], collections.defaultdict(list)
    for i in range(1, 400):
        key = (r.randrange(6), r.randrange(3), r.choice([None, "2024-01-02"]), r.choice([None, 0, 1]))
        code, name = r.choice(WRITINGS["code"]).replace("38", str(key[0])), r.choice(WRITINGS["name"])
        amount = r.choice(WRITINGS["amount"]).replace("2", str(key[1]), 1)
        if i % 3 == 0:
            text = r.choice(["Fund Code : {0} | Fund Name : {1} | Transfer Amount : {2}", "이체금액: {2}\n펀드명: {1}\n펀드코드: {0}", '{{"fundName": "{1}", "FUND_CODE": "{0}", "transfer_amount": "{2}"}}', "fund_name={1};transfer_amount={2};fund_code={0}"]).format(code, name, amount)
            rows.append((i, None, None, "PENDING", "RED", key[2], key[3], None, text, ""))
        else:
            rows.append((i, code, name, "PENDING", "RED", key[2], key[3], amount, None, ""))
        sets[key].append(i)
    rows.append((500, None, "", "PENDING", "RED", None, None, "", None, ""))
    rows.append((501, "", None, "PENDING", "RED", None, None, None, None, ""))
    rows.append((502, "XV-3938", "온새미​ 중소형주 - Acc", "PENDING", "RED", None, None, "5", None, ""))  # problem 5
    rows.append((503, "XV-3938", "온새미​ 중소형주 - Acc", "PENDING", "RED", None, None, "5", None, ""))
    rows.append((None, "XV-3938", "온새미", "PENDING", "RED", None, None, "5", None, ""))
    want = {(min(v), i) for v in sets.values() for i in v if i != min(v)} | {(500, 501)}
    df = spark.createDataFrame(rows, ORDERS)
    got = {tuple(x) for x in p1.groups(df, ["온새미 중소형주 - Acc"], []).where("order_id <> keep_id").select("keep_id", "order_id").collect()}
    assert got == want
    assert p1.groups(df.limit(0), ["x"], []).count() == 0


def test_rows_told_apart_are_grouped_again(spark, monkeypatch):
    """With hashes that always collide, the comparison and the exact grouping must still find the sets."""
    own = p1.hashed

    def colliding(*args):
        return own(*args).withColumn("h1", F.lit(1).cast("long")).withColumn("h2", F.lit(1).cast("long"))

    monkeypatch.setattr(p1, "hashed", colliding)
    rows = [(i, f"C{i % 3}", "n", "PENDING", "RED", None, None, "1,0", None, "") for i in range(1, 10)]
    got = {tuple(x) for x in p1.groups(spark.createDataFrame(rows, ORDERS), ["x"], []).where("order_id <> keep_id").select("keep_id", "order_id").collect()}
    assert got == {(1, 4), (1, 7), (2, 5), (2, 8), (3, 6), (3, 9)}


def test_map_operators_on_odd_rows(spark):
    mail = "Subject: x\nFrom: A B <a@b.example>\n\nnew\n> old"
    rows = [(1, "message/rfc822", mail, "a" * 2500, ["b", None, "c" * 2001]), (1, "message/rfc822", mail, "a" * 2500, None), (2, "message/rfc822", None, None, []), (3, "text/html", "Ã©tÃ©\nx", "", None), (None, "message/rfc822", mail, "z" * 3000, ["y" * 3000])]
    df = spark.createDataFrame(rows, "payload_id long, content_type string, raw_text string, markdown_text string, chunks array<string>")
    assert sorted(map(tuple, p3.not_new(df).collect())) == [(1, 5), (1, 5)]
    assert sorted(map(tuple, p4.lines(df, "payload_id", "raw_text").collect())) == [(3, 1)]
    pieces = p2.split(p2.items_of(df), ["payload_id", "item_no"])
    assert sorted({(r.payload_id, r.item_no) for r in pieces.collect()}) == [(1, 0), (1, 3)]
    assert p5.find(df, "payload_id", ["markdown_text"], ["x"], [], "t").count() == 0
    for op in (lambda d: p3.not_new(d), lambda d: p4.lines(d, "payload_id", "raw_text"), lambda d: p2.split(p2.items_of(d), ["payload_id", "item_no"])):
        assert op(df.limit(0)).count() == 0
