"""Problem 3: e-mails reduced to what their sender wrote for this message.

Method: line rules in several languages for quote prefixes, attribution lines, headers of forwarded or earlier
messages, signature delimiters and disclaimers. A body is read once: quoted lines and the attributions before them
go, what stands between quotations stays (a reply written into them), an earlier message that isn't prefixed goes
from its header to the end, and below the last line written come a signature (opened by a delimiter, by the
sender's own name or by a mobile client's line) and notices. Lines are compared in their plain form: wrong encoding
is undone and look-alike characters are folded before a rule sees the line.

Each e-mail is read on its own in an Arrow batch; nothing is shuffled.

Defined cases: rows of other content types or without an id, null texts and texts without an empty line have no body and give no
rows; blank lines belong to neither side; an empty body is all new (an empty text); repeated rows repeat.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .p4_encoding import LOST, repair
from .p5_lookalikes import normalize_by_table
from .shared import slices, table

_QUOTE = re.compile(r"[ \t]*(?:\|[ \t]*)*>")

# The line before a quotation, in the languages of mail programs.
_ATTRIBUTION = re.compile(
    r"""(?: On\ .+\bwrote: | .+\bwrote\ on\ [\d\-/. ]+: | .+<[^<>@\s]+@[^<>\s]+>\ wrote:
    | .*(?:님이\ 작성:|님이\ 쓰신\ 글:|님\ 글:|님의\ 말:|작성\ ?\(\d{4}[-./]\d{1,2}[-./]\d{1,2}\))
    | (?:Am|Den)\ .+\bschrieb\b.*: | (?:Op\ .+\b|.+\ )schreef\b.*: | (?:Den\ .+\b|.+\ )skrev\b.*: | (?:W\ dniu\ .+|.+\ )(?:pisze|napisał(?:a|\(a\))?)\b.*: | .+\bnapsal(?:a|\(a\))?\b.*: | .+\bkirjoitti: | .+\byazdı: | Le\ .+\ba\ écrit\ ?: | El\ .+\bescribió: | Em\ .+\bescreveu: | Il\ .+\bha\ scritto:
    | .+\bнаписала?(?:\(а\))?: | .+写道[:：] | .+さんは書きました[:：] | .+のメール[:：] )""",
    re.X | re.I,
)
_WRAPPED = re.compile(r"(?:On\ .*\d.*|Am\ .*\d.*|Le\ .*\d.*|El\ .*\d.*|\d{4}년 .*[,，].*)", re.I)
# Names of header fields that open an earlier message; the first group names its sender.
_FROM = re.compile(r"(?:From|보낸 ?사람|발신(?:인|자)?|Von|De|Da|От|发件人|差出人)\s*:\s*\S", re.I)
_FIELD = re.compile(
    r"(?:From|Sent|Date|To|Cc|Bcc|Subject|Reply-To|보낸 ?사람|보낸 ?날짜|날짜|받는 ?사람|참조|숨은 ?참조|제목|발신(?:인|자)?|수신(?:인|자)?"
    r"|Von|Gesendet|An|Betreff|De|Envoyé|À|Objet|Enviado|Para|Asunto|Assunto|От|Отправлено|Кому|Тема|发件人|发送时间|收件人|主题|差出人|送信日時|宛先|件名)\s*:",
    re.I,
)
_MARKER = re.compile(
    r"(?:[-_=*]{2,}\s*(?:Original Message|Original Appointment|Forwarded message|Forwarded by.*|원본 ?메시지|전달된 ?메시지|Ursprüngliche Nachricht|Message d'origine|Mensaje original|Mensagem original|Исходное сообщение|原始邮件|元のメッセージ)\s*[-_=*]{2,}"
    r"|Begin forwarded message:|전달된 메시지 시작:|Anfang der weitergeleiteten Nachricht:|_{8,})",
    re.I,
)
# Stems of legal notices. A notice speaks of secrecy or law together with a recipient, a misuse or the
# message itself, or of the message together with liability or a recipient; it runs on to the next blank line.
_SECRECY = re.compile(
    r"confidential|privileged|proprietary|disclaimer|legally|비밀|기밀|\[보안|\[법적|법적|vertraulich|confidentiel|confidencial|riservat|vertrouwelijk|konfidentiell|fortrolig|poufn|důvěrn|конфиденциал|机密|機密|秘密",
    re.I,
)
_MISUSE = re.compile(
    r"addressee|intended (?:only|solely|for)|recipient|in error|liability|responsib|unauthori[sz]ed|prohibited|copying|disclos|disseminat|bind the company|수신인|수신자|잘못 수신|책임지지|책임을 지지|금합니다|금지|공개할 수 없|Empfänger|Haftung|destinataire|destinatari|ontvanger|mottagare|odbiorc|příjemc|адресат|收件人|受信者|宛先以外",
    re.I,
)
_MESSAGE = re.compile(
    r"this (?:e-?mail|message|communication|transmission)|the (?:sender|company|author) accepts|이 메시지|이 메일|본 메일|본 메시지|본 이메일|본 전자우편|이 전자우편|당사는|발신인에게|diese[rs]? (?:e-?mail|nachricht)|ce (?:message|courriel)|este (?:mensaje|correo|e-?mail)|questo messaggio|(?:deze|dit) (?:e-?mail|bericht)|detta meddelande|ta wiadomość|tato zpráva|данное сообщение|это сообщение|本邮件|このメール|本メール",
    re.I,
)
_LABEL = re.compile(r"\[?(?:confidential(?:ity)?|legal|privacy|security)\b[\w ]*(?:notice|note|disclaimer)\b|disclaimer\b|please consider the environment", re.I)


def is_notice(line: str) -> bool:
    """Does a legal notice begin in this line?"""
    secrecy, misuse, message = (bool(p.search(line)) for p in (_SECRECY, _MISUSE, _MESSAGE))
    return bool(_LABEL.match(line)) or secrecy and (misuse or message) or misuse and message


_MOBILE = re.compile(r"(?:Sent from (?:my|a|an)\b.{0,40}|(?:나의 |내 )?[\w ]{0,20}(?:모바일|휴대폰|휴대전화|iPhone|갤럭시)에서 보냄|Von meinem .{0,30} gesendet|Envoyé de mon .{0,30}|Enviado desde mi .{0,30})\.?", re.I)
_DELIMITER = re.compile(r"--[ \t]?|[─━═—]{5,}|_{5,7}")
_ENDING = re.compile(r"\s*(?:드림|올림|배상|拜|님)\.?")
_ADDRESS = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+")
_CONTACT = re.compile(r"(?:(?:T|F|E|M|Tel|Fax|Phone|Mobile|전화|팩스|휴대폰|이메일|E-?mail)\b[.:]?\s*[+\d(]|E\s+\S+@|.*\d{2,4}-\d{3,4}-\d{4}|https?://)", re.I)
_CLOSING = re.compile(
    r"(?:(?:best|kind|warm|many)?\s*(?:regards|wishes|thanks)|thank you|sincerely|cheers|감사합니다|고맙습니다|수고하세요|수고하십시오|확인 부탁드립니다|(?:mit )?freundlichen? grüßen?|cordialement|saludos|atenciosamente)[\s,.!]*",
    re.I,
)
_SENTENCE = re.compile(r".*[.!?。:]\s*$|.*다\s*$")
#: A line below a signature's first that is no contact and no sentence belongs to it up to so many words.
SIGNATURE_WORDS = 14
#: A line before a quotation that ends with a colon and names a day, a time or an address attributes it, in any language.
_NAMES_WHEN = re.compile(r"\d{1,4}[-./]\d{1,2}|\d{1,2}[:：]\d{2}|\b(?:19|20)\d{2}\b|[\w.+-]+@[\w-]+\.\w")
_PLAIN = re.compile(r"[\x20-\x7e\t가-힣·]*\Z")


def plain(line: str) -> str:
    """The line as a rule should see it."""
    if _PLAIN.match(line):
        return line
    return normalize_by_table(repair(line))


def sender(header: list[str]) -> str:
    """The name in the From field, '' if there is none. Where characters of it are lost, the name as it stands: a
    signature below was read in the same wrong encoding."""
    for line in header:
        if line[:5].lower() == "from:":
            name, written = (re.sub(r"<.*", "", x[5:]).strip().strip("\"'") for x in (plain(line), line))
            return name if LOST not in name else written if written.strip(LOST) else ""
    return ""


def _header_at(lines: list[str], i: int) -> bool:
    """Does an earlier message's header stand at i: a sender's field and two more, one of them with an address or a time?"""
    if not _FROM.match(lines[i]):
        return False
    j = i
    while j < len(lines) and _FIELD.match(lines[j]):
        j += 1
    block = lines[i:j]
    return len(block) >= 3 or len(block) == 2 and bool(_ADDRESS.search(block[0])) and bool(re.search(r"\d", block[1]))


def _signature_line(line: str) -> bool:
    """May the line stand in a signature, below its first line?"""
    return bool(line.strip()) and (bool(_ADDRESS.search(line) or _CONTACT.match(line.strip())) or len(line.split()) <= SIGNATURE_WORDS and not _SENTENCE.match(line) and " | " not in line.replace(" | ", "", 1))


def _named(line: str, name: str) -> bool:
    """Is the line the sender's name, alone or with what a signature puts beside it?"""
    line = line.strip()
    if not name or not line.startswith(name):
        return False
    rest = line[len(name) :]
    return not rest.strip(" .,") or bool(_ENDING.fullmatch(rest)) or bool(re.fullmatch(r"\s*<[^<>]+@[^<>]+>", rest)) or bool(re.fullmatch(r"(?:\s+\S{1,8})?\s*[|/]\s*[^|]{1,60}", rest)) or bool(re.fullmatch(r"\s+(?:사원|주임|대리|과장|차장|부장|팀장|이사|상무|매니저|책임|수석)(?:\s*(?:드림|올림))?", rest))


def classify(body: list[str], name: str) -> list[bool]:
    """For each line of a body: is it newly written? Blank lines count as new."""
    lines = [plain(x) for x in body]
    n = len(lines)
    new = [True] * n
    quoted = [bool(_QUOTE.match(x)) for x in lines]
    end = n
    for i in range(n):
        if quoted[i] or not lines[i].strip():
            continue
        if _header_at(lines, i):
            end = i
            while end and (not lines[end - 1].strip() or _MARKER.fullmatch(lines[end - 1].strip())):
                end -= 1
            break
        if _MARKER.fullmatch(lines[i].strip()) and not lines[i].strip().startswith("__"):
            end = i
            break
    for i in range(end, n):
        new[i] = False

    def follows_quote(i: int) -> bool:
        while i < end and not lines[i].strip():
            i += 1
        return i < end and quoted[i]

    i = 0
    while i < end:
        line = lines[i].strip()
        if quoted[i]:
            new[i] = False
        elif not line:
            pass
        elif _ATTRIBUTION.fullmatch(line) or line[-1] in ":：" and _NAMES_WHEN.search(line) and follows_quote(i + 1):
            new[i] = False
            if i and re.match(r"<?[^<>@\s]+@", line) and _WRAPPED.fullmatch(lines[i - 1].strip()):
                new[i - 1] = False
        elif i + 1 < end and _WRAPPED.fullmatch(line) and not _SENTENCE.match(line) and _ATTRIBUTION.fullmatch(f"{line} {lines[i + 1].strip()}") and follows_quote(i + 2):
            new[i] = new[i + 1] = False
            i += 1
        elif is_notice(line):
            while i < end and lines[i].strip() and not quoted[i]:
                new[i] = False
                i += 1
            continue
        elif _MOBILE.fullmatch(line):
            new[i] = False
        elif _named(line, name) or _named(body[i], name) or _DELIMITER.fullmatch(lines[i].rstrip("\r")) and i + 1 < end and _signature_line(lines[i + 1]) and not quoted[i + 1]:
            new[i] = False
            j = i + 1
            while j < end and not quoted[j] and _signature_line(lines[j]) and not is_notice(lines[j].strip()) and not _ATTRIBUTION.fullmatch(lines[j].strip()):
                new[j] = False
                j += 1
            i = j
            continue
        i += 1
    return new


def split_mail(text: str) -> tuple[list[str], list[str], int]:
    """(header lines, body lines, number of the body's first line); no body without an empty line."""
    lines = text.split("\n")
    for i, line in enumerate(lines):
        if not line.strip("\r"):
            return lines[:i], lines[i + 1 :], i + 2
    return lines, [], len(lines) + 1


def _mails(payloads: DataFrame) -> DataFrame:
    return payloads.where("content_type = 'message/rfc822' AND raw_text IS NOT NULL AND payload_id IS NOT NULL").select(F.col("payload_id").cast("long"), "raw_text")


def not_new(payloads: DataFrame) -> DataFrame:
    """(payload_id, line_no) of the non-blank body lines that aren't newly written; line_no counts within raw_text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ["raw_text"]):
            rows, nos = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                header, body, first = split_mail(text)
                for k, (line, new) in enumerate(zip(body, classify(body, sender(header)))):
                    if not new and line.strip():
                        rows.append(i)
                        nos.append(first + k)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(nos, pa.int64())], ["payload_id", "line_no"])

    return _mails(payloads).mapInArrow(run, "payload_id long, line_no long")


def new_text(payloads: DataFrame) -> DataFrame:
    """(payload_id, new_text): each e-mail's newly written text, without blank lines at its ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ["raw_text"]):
            out = []
            for text in batch.column(1).to_pylist():
                header, body, _ = split_mail(text)
                kept = "\n".join(line for line, new in zip(body, classify(body, sender(header))) if new)
                out.append(re.sub(r"\n{3,}", "\n\n", kept).strip("\n"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["payload_id", "new_text"])

    return _mails(payloads).mapInArrow(run, "payload_id long, new_text string")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_new(table(spark, sf_dir, "task_payloads"))


def p3_new_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return new_text(table(spark, sf_dir, "task_payloads"))
