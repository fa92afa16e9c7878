"""Splitting, new text, encodings and look-alikes: on small cases, without Spark where a function suffices."""

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orderloom.llm import p2_split_items as p2
from orderloom.llm import p3_new_text as p3
from orderloom.llm import p4_encoding as p4
from orderloom.llm import p5_lookalikes as p5

NAMES = ["Corvale Infrastructure Balanced C", "Ação Crescimento - Acc", "국내·해외 분산투자(H)", "Линия Роста Фонд III", "솔빛 리츠 채권형", "Γραμμή Ανάπτυξης(H)"]
OWN = p5.Finder(NAMES)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n|가𝄞", max_size=700), st.integers(20, 60), st.integers(0, 9))
def test_pieces_cover_the_text(text, limit, overlap):
    got = p2.plan(text, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(e - s <= limit for s, e, _ in got)
    for (_, e, _), (s, f, _) in zip(got, got[1:]):
        assert s == e - overlap and f > e


def test_pieces_end_at_boundaries_where_they_can():
    text = ("This is one sentence. " * 30 + "\n") * 12
    assert {p2.KINDS[k] for _, _, k in p2.plan(text)} <= {"line", "sentence", "end"}
    assert [k for _, _, k in p2.plan("x" * 5000)][:-1] == [p2.HARD] * 2
    assert p2.plan("short") == [(0, 5, p2.END)]
    assert p2.plan("") == [(0, 0, p2.END)]


MAIL = """Hello,
New text one.
-----
- not a signature
Metadata example, for the form only:
From: generated value
Subject: fund report
Best regards,

Osta Quilme
Treasury Operations, Hollowmere Mutual
Tel. 02-5780-7931
o@x.example
Disclaimer - views are private.

On 2024-06-27, Pelka Zandor wrote:
> quoted one
reply inside
| > quoted two"""


def test_new_text_of_a_mail():
    lines = MAIL.split("\n")
    new = p3.classify(lines, "Osta Quilme")
    kept = [x for x, n in zip(lines, new) if n and x]
    assert kept == lines[:8] + ["reply inside"]


def test_a_long_signature_is_one():
    block = ["Osta Quilme", "Treasury Operations", "Hollowmere Mutual", "오스타 퀼메", "자금운용팀", "홀로미어 상호", "12 Pier Road, Hollow Town", "Tel. 02-5780-7931", "Fax. 02-5780-7932", "Mobile 010-5780-7931", "o@x.example", "www.hollowmere.example"]
    for delimiter in ([], ["-- "]):
        lines = ["Please confirm the orders below.", "", *delimiter, *block, "", "One more thing is written here."]
        new = p3.classify(lines, "Osta Quilme")
        assert [x for x, n in zip(lines, new) if n and x] == [lines[0], lines[-1]]


@pytest.mark.parametrize("head", [["From: A B <a@b.example>", "Sent: Mon, 1 Jan 2024", "To: c@d.example"], ["----- 원본 메시지 -----", "보낸 사람: 가 <a@b.example>", "보낸 날짜: 2024년 1월 1일", "받는 사람: c@d.example"], ["Begin forwarded message:", "From: A <a@b.example>", "Sent: x 2024", "To: y"]])
def test_an_earlier_message_goes_to_the_end(head):
    lines = ["새 글입니다.", "", *head, "", "옛 글입니다."]
    assert [x for x, n in zip(lines, p3.classify(lines, "")) if n and x] == ["새 글입니다."]


def test_mails_without_a_body():
    assert p3.split_mail("Subject: x")[1] == []
    assert p3.classify([], "A") == []
    assert p3.classify(["", ""], "A") == [True, True]


CLEAN = ["기준일자: 2024-08-02", "VA9851 | Ação Crescimento B | 입금", "Société de dépôt à préciser", "ÂNCORA e ÃO no rótulo", "投資信託 基準價 確認 要", "株式型 特別計定 內譯 (別紙)", "Линия Роста: проверить остаток", "Γραμμή Ανάπτυξης(H)", "Tolerance ±0.5 at 20°, see §4", "The custodian’s note says “revised” – see below", "VA5640 | Estoril Robotics 2호 | 1천", ""]


@pytest.mark.parametrize("line", CLEAN)
def test_clean_lines_stay(line):
    assert p4.repair(line) == line and not p4.affected(line)


@pytest.mark.parametrize("read,written", [("latin-1", "utf-8"), ("mac-roman", "utf-8"), ("latin-1", "cp949"), ("gbk", "cp949")])
def test_one_layer_is_undone(read, written):
    for line in ["기준일자: 2024-08-02", "누리벗생명 상품지원실에서 확인하여 주십시오."]:
        assert p4.repair(line.encode(written).decode(read)) == line


def test_nested_layers_are_undone():
    web = {v: k for k, v in p4._WEB.items()}
    once = "".join(web[b] for b in "별하늬 단기국공채 인덱스형".encode())
    twice = "".join(web[b] for b in once.encode())
    assert p4.repair(once) == p4.repair(twice) == "별하늬 단기국공채 인덱스형"


def test_lost_characters_stay_lost():
    garbled = "하늘채생명 운용지시서".encode().decode("cp949", "replace")
    assert p4.affected(garbled)
    assert "�" in p4.repair(garbled)
    assert p4.repair("Se챰al de a챰o anterior") == "Señal de año anterior"


@pytest.mark.parametrize(
    "written,name",
    [("Corvale Infrаstructure Balanced C", 0), ("Ｃｏｒｖａｌｅ Infrastructure Balanced C", 0), ("Ação Cresсimento - Acc", 1), ("국내∙해외 분산투자（H）", 2), ("솔빛​ 리츠\xa0채권형", 4), ("Линия Роста Фонд Ⅲ", 3), ("Γραμμή Ανάπτυξης(H)", 5), ("Corvale Infrastructure Balanced С", 0)],
)
def test_look_alikes_are_found_and_undone(written, name):
    assert OWN.flagged(pa.array([written])).tolist() == [True]
    assert OWN.name(written) == NAMES[name]


@pytest.mark.parametrize("written,plain", [("corvale infrastructure balanced с", "corvale infrastructure balanced c"), ("x\nИтог\nacс с | 5", "x\nИтог\nacc c | 5")])
def test_look_alikes_in_another_case(written, plain):
    own = p5.Finder(NAMES, ["acc"])
    assert own.flagged(pa.array([written])).tolist() == [True]
    assert own.text(written) == plain
    assert OWN.flagged(pa.array([NAMES[0].lower(), "Рост с начала года", "линия роста фонд iii"])).tolist() == [False] * 3


def test_names_are_matched_whole():
    own = p5.Finder(["Линия Роста А", "Фонд Роста C", "Alpha B"])
    names = ["фонд роста с", "Фонд-Роста С", "ЛИНИЯ РОСТА А", "линия роста а", "alpha b", "Фонд Роста C"]
    assert own.flagged(pa.array(names), names=True).tolist() == [True, True, False, False, False, False]
    assert own.name(names[0]) == own.name(names[1]) == "Фонд Роста C"


def test_plain_text_is_left_alone():
    plain = [*NAMES, "솔빛\t리츠  채권형", "<SOLBIT>", None, "", "投資信託 別紙", "ÂNCORA à la Größe ±0.5 §4 ※", "Order-No. 5O is odd but alone"]
    assert OWN.flagged(pa.array(plain, pa.string())).tolist() == [False] * len(plain)


def test_amounts():
    odd = ["1,35Ο,000", "－１２，３４５．６０", "12‌,345", "1l,000", "−5"]
    assert OWN.flagged(pa.array(odd), True).all()
    assert [OWN.amount(x) for x in odd] == ["1350000", "-12345.6", "12345", "11000", "-5"]
    assert not OWN.flagged(pa.array(["-1,234.50", "+5", "1 000", "1'000", None, ""]), True).any()


def test_hanja_read_as_latin():
    for line in ["投資信託 基準價 確認 要", "株式型 特別計定 內譯 (別紙)"]:
        assert p4.repair(line.encode("cp949").decode("latin-1")) == line


def test_a_sender_whose_name_is_lost():
    garble = lambda x: x.encode().decode("cp949", "replace")
    header = [f"From: {garble('누온채')} <a@b.example>"]
    body = [garble("안녕하세요."), garble("확인 부탁드립니다."), "", garble("누온채"), "a@b.example"]
    assert p3.classify(body, p3.sender(header)) == [True, True, True, False, False]
    assert p3.sender(["From: ��� <a@b.example>"]) == ""


@pytest.mark.parametrize(
    "line,written",
    [("中文测试文件已经确认", "gbk"), ("請確認基金公司的資料", "big5"), ("Проверить остаток фонда", "cp1251"), ("Проверить остаток фонда", "koi8-r"), ("ファンドの注文を確認してください", "cp932"), ("Příliš žluťoučký kůň", "cp1250")],
)
def test_other_written_encodings(line, written):
    web = {v: k for k, v in p4._WEB.items()}
    assert p4.repair("".join(web[b] for b in line.encode(written))) == line


@pytest.mark.parametrize("line", ["中文测试文件已经确认", "請確認基金公司的資料", "Проверить остаток фонда", "ПРОВЕРИТЬ ОСТАТОК", "Данное сообщение является конфиденциальным.", "Το μήνυμα είναι εμπιστευτικό", "ファンドの注文を確認", "Příliš žluťoučký kůň", "à la crème brûlée, où êtes-vous", "l'attività è più sù", "blåbærgrød på øen", "row 26 рrecedes", "Rеtirement Path"])
def test_clean_foreign_text_stays(line):
    assert p4.repair(line) == line


def test_a_close_call_is_not_complete():
    assert p4.certain("기준일자: 2024-08-02".encode().decode("latin-1")) and p4.certain("plain")
    assert p4.repair("ÖÐÎÄ²âÊÔ") in ("ÖÐÎÄ²âÊÔ", "中文测试")


@pytest.mark.parametrize(
    "line",
    ["Op ma 3 jun. 2024 om 09:12 schreef Jan Vos <jan@vos.example>:", "Jan Vos schreef op 3 juni 2024:", "Den mån 3 juni 2024 kl 09:12 skrev Eva Ek <eva@ek.example>:", "W dniu 3.06.2024 o 09:12 Ewa Nowak pisze:", "Dne 3. 6. 2024 v 9:12 napsal Jan Novák:", "3.6.2024 9.12 Matti Meikäläinen kirjoitti:", "Ar 3 Meh 2024, 09:12 ysgrifennodd Rhys:"],
)
def test_attributions_in_many_languages(line):
    lines = ["New text.", "", line, "> old", "and a reply"]
    assert [x for x, n in zip(lines, p3.classify(lines, "")) if n and x] == ["New text.", "and a reply"]


@pytest.mark.parametrize(
    "notice",
    ["The information in this transmission is proprietary and for the named recipient.\nDelete it otherwise.", "Diese Nachricht ist vertraulich und nur für den Empfänger bestimmt.", "Dit bericht is vertrouwelijk en uitsluitend bestemd voor de ontvanger.", "Данное сообщение является конфиденциальным.", "본 이메일은 기밀 정보를 담고 있으며\n수신자 이외의 이용을 금지합니다.", "We accept no liability for errors in this e-mail."],
)
def test_notices_in_other_words(notice):
    lines = ["Please check the orders.", "", *notice.split("\n"), "", "One more line."]
    assert [x for x, n in zip(lines, p3.classify(lines, "")) if n and x] == [lines[0], lines[-1]]


def test_lines_that_only_sound_like_notices():
    for line in ["Please delete this row.", "The recipient account is unchanged.", "책임자에게 전달했습니다.", "Sent the confidential file yesterday.", "At 10:30 we call:"]:
        assert p3.classify([line, "", "x"], "") == [True, True, True]


def test_long_signature_lines():
    lines = ["Confirm please.", "", "-- ", "Osta Quilme", "Head of the Variable Annuity Operations and Fund Transfer Settlement Desk, Hollowmere Mutual", "o@x.example"]
    assert p3.classify(lines, "") == [True, True, False, False, False, False]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n|", min_size=30, max_size=140), st.integers(14, 30), st.integers(0, 5))
def test_the_plan_is_the_cheapest(text, limit, overlap):
    """Against every plan over the same boundaries."""
    import numpy as np

    if len(text) <= limit:
        return
    at, kind = p2.boundaries(text, limit, overlap)
    share = (len(text) - overlap) / -(-(len(text) - overlap) // (limit - overlap)) + overlap
    price = lambda s, e, k: p2.PENALTY[k] + p2.PIECE + p2.BALANCE * ((e - s - share) / limit) ** 2
    best = {0: 0.0}
    starts = {0: 0}
    for j, (e, k) in enumerate(zip(at, kind), 1):
        reach = [(best[i] + price(s, e, k)) for i, s in starts.items() if i in best and e - s <= limit and s < e]
        if reach:
            best[j] = min(reach)
        starts[j] = e - overlap
    got = sum(price(s, e, k) for s, e, k in p2.plan(text, limit, overlap))
    assert np.isclose(got, best[len(at)])
