"""Problem 4: lines that were read in another encoding than they were written in.

Method: round-trip repair. A line is encoded again in each encoding that it may have been read in and strictly
decoded in each that it may have been written in; the repair is accepted when the cost of garbling drops clearly,
and tried again on its result, for nested layers. Characters lost in reading (U+FFFD) can't be encoded: there the
parts between them are repaired one by one, and what is lost stays U+FFFD. A text written in an encoding of another
language (Chinese, Japanese, Russian, Central European) is restored only where the reading looks native, and a
restoration is called complete only where no other reading comes near it.

Rows are worked on in Arrow batches without a shuffle; a line of ASCII only is never looked at, and equal lines of a
worker are repaired once.

Defined cases: null and empty texts have no lines affected; a line that holds U+FFFD is affected even if nothing can
be restored; genuine accents, Chinese characters, Cyrillic and Greek stay; rows without an id are left out; repeated rows give repeated lines.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import slices, table

#: (encoding that the text was read in, encoding that it was written in), as Python names them.
PAIRS = (
    ("web-1252", "utf-8"), ("latin-1", "utf-8"), ("mac-roman", "utf-8"), ("cp949", "utf-8"), ("gbk", "utf-8"),
    ("cp1251", "utf-8"), ("cp437", "utf-8"), ("shift_jisx0213", "utf-8"), ("big5", "utf-8"),
    ("web-1252", "cp949"), ("latin-1", "cp949"), ("gbk", "cp949"), ("mac-roman", "cp949"), ("shift_jisx0213", "cp949"), ("big5", "cp949"),
)
#: Further encodings that a text may have been written in: (read in, written in). Of single bytes read one by one nearly
#: every reading is valid, so these are taken only where the text they give looks written in that encoding's language.
OTHER_PAIRS = tuple(
    (read, written)
    for read in ("web-1252", "latin-1", "mac-roman", "cp949", "cp1251", "koi8-r")
    for written in ("gbk", "big5", "cp932", "cp1251", "koi8-r", "cp1250")
    if read != written and not (read in ("cp949", "cp1251", "koi8-r") and written in ("cp932", "cp1250"))
)
#: Layers are undone until none is found; each must lower the cost, so this bound is a guard that no text reaches.
LAYERS = 64
#: A restoration is complete only if every other reading costs at least so many times as much.
MARGIN = 1.5
LOST = "�"
#: A repair must leave at most this share of the cost.
SHARE = 0.5

# The five bytes that windows-1252 leaves undefined stand for the control characters of the same number.
_HOLES = {0x81, 0x8D, 0x8F, 0x90, 0x9D}
_WEB = {(chr(b) if b in _HOLES or b < 0x80 or b >= 0xA0 else bytes([b]).decode("cp1252")): b for b in range(256)}


def _encode(text: str, name: str) -> bytes | None:
    try:
        return bytes([_WEB[c] for c in text]) if name == "web-1252" else text.encode(name)
    except (KeyError, UnicodeEncodeError):
        return None


@functools.cache
def _common_hangul(c: str) -> bool:
    """One of the syllables of the national standard, which ordinary text keeps to."""
    try:
        return len(c.encode("euc_kr")) == 2
    except UnicodeEncodeError:
        return False


@functools.cache
def _weight(c: str) -> float:
    """How much a character alone speaks for garbling."""
    o = ord(c)
    if o < 0x80:
        return 0.0 if c >= " " or c in "\t\r" else 2.0
    if c == LOST:
        return 2.0
    if o < 0xA0:
        return 2.5
    if 0xAC00 <= o <= 0xD7A3:
        return 0.1 if _common_hangul(c) else 1.5
    if c in "·–—‘’“”…※─§°±№₩€":
        return 0.2 if c in "·–—‘’“”…※─" else 0.5
    if o < 0x180:
        return 0.4 if c.isalpha() and c not in "ªº" else 1.2
    if 0x370 <= o <= 0x52F:
        return 0.3
    if 0x3400 <= o <= 0x9FFF or 0xF900 <= o <= 0xFAFF:
        return 1.0
    if 0x3040 <= o <= 0x30FF:
        return 1.0
    if 0xE000 <= o <= 0xF8FF:
        return 2.5
    return 1.2


def _kind(c: str) -> str:
    o = ord(c)
    if o < 0x250:
        return "L" if c.isalpha() else ""
    if 0xAC00 <= o <= 0xD7A3:
        return "H"
    if 0x3400 <= o <= 0x9FFF or 0xF900 <= o <= 0xFAFF:
        return "C"
    if 0x3040 <= o <= 0x30FF or 0xFF66 <= o <= 0xFF9F:
        return "J"
    if 0x370 <= o <= 0x3FF:
        return "G"
    if 0x400 <= o <= 0x52F:
        return "R"
    return ""


#: Neighbours of two scripts that ordinary text doesn't put into one word.
_APART = {frozenset(p) for p in ("LC", "LJ", "LG", "LR", "HG", "HR", "HJ", "CG", "CR", "JG", "JR", "GR", "HC")}


def cost(text: str) -> float:
    """The cost of garbling: odd characters, odd neighbours."""
    total, before, accents = 0.0, "", 0
    for c in text:
        if c.isascii():
            total += 0.0 if c >= " " or c in "\t\r" else 2.0
            k = "L" if c.isalpha() else ""
            accents = 0
        else:
            total += _weight(c)
            k = _kind(c)
            # several accented letters in a row, as bytes read one by one give them
            accents = accents + 1 if k == "L" or 0xA0 <= ord(c) < 0xC0 else 0
            if accents > 1:
                total += 0.3 if accents == 2 else 0.8
        if k and before and k != before and frozenset((k, before)) in _APART:
            total += 0.4
        before = k
    return total


_HIGH = re.compile(r"[^\x00-\x7f]")
_EUROPEAN = re.compile(r"[\u00a0-\u00ff\u0384-\u03ce\u0401-\u0451\u2013-\u201d]+")
#: Beside ASCII only letters that Korean read as UTF-8 gives where its bytes happen to be valid.
_RARE = re.compile(r"[\x00-\x7f\u0180-\u02af\u0500-\u07ff]*\Z")
#: Only ASCII, Hangul and common marks: of all pairs such a line can only be UTF-8 that was read as Korean.
_KOREAN = re.compile(r"[\x00-\x7f가-힣·─※]*\Z")


def _beside(text: str, m: re.Match) -> bool:
    """Does a letter stand beside a Latin letter, or a sign beside a Latin letter or a digit?"""
    near = text[max(m.start() - 1, 0) : m.start()] + text[m.end() : m.end() + 1]
    sign = not any(c.isalpha() for c in m[0])
    return any(c.isascii() and (c.isalpha() or sign and c.isdigit()) for c in near)


_HANJA_IN_WORD = re.compile(r"[A-Za-z][\u3400-\u9fff\uf900-\ufaff]|[\u3400-\u9fff\uf900-\ufaff][A-Za-z]")


def _unlikely_korean(back: str, read: str) -> bool:
    """Kana; or Chinese characters, where they stand beside Latin letters (accents read as pairs) or came from such."""
    kinds = {_kind(c) for c in back}
    return "J" in kinds or "C" in kinds and (read not in ("latin-1", "web-1252", "mac-roman") or bool(_HANJA_IN_WORD.search(back)))


def _level_one(c: str, written: str) -> bool:
    """Is a Chinese character one of the common half of its national set?"""
    try:
        raw = c.encode({"gbk": "gb2312", "big5": "big5", "cp932": "cp932"}[written])
    except UnicodeEncodeError:
        return False
    return len(raw) == 2 and (0xB0 <= raw[0] <= 0xD7 if written == "gbk" else 0xA4 <= raw[0] <= 0xC6 if written == "big5" else 0x81 <= raw[0] <= 0x98)


_CASED = re.compile(r"[А-ЯЁ]?[а-яё]+|[А-ЯЁ]+")
_VOWELS = frozenset("аеёиоуыэюяАЕЁИОУЫЭЮЯ")
_CYRILLIC_WORD = re.compile(r"[\u0400-\u045f]+")
#: Letters that only encodings of Central Europe have, and what Western readers show in their place.
_CENTRAL = frozenset("řčěůňťďŘČĚŮŇŤĎłąęśźćńŁĄĘŚŹĆŃőűŐŰ")
_MISREAD = re.compile(r"ø[a-z]*[ìèùòïžšýáíé]|[ìèùòïžšýáíé][a-z]*ø|[A-Za-z][¹³¿œŸ][a-z]|[a-z][¹³¿](?![\w])")


def _native(back: str, written: str) -> bool:
    """Does a text look written in the language of an encoding: by its letters, their case, its vowels, its common characters?"""
    high = _HIGH.findall(back)
    if written in ("cp1251", "koi8-r"):
        words = _CYRILLIC_WORD.findall(back)
        letters = "".join(words)
        if len(letters) < 4 or len(letters) < 0.9 * len(high) or not all(_CASED.fullmatch(w) for w in words):
            return False
        return 0.25 <= sum(c in _VOWELS for c in letters) / len(letters) <= 0.65 and not re.search(r"[A-Za-z][\u0400-\u045f]|[\u0400-\u045f][A-Za-z]", back)
    if written == "cp1250":
        return all(c in _CENTRAL or c in "áéíóúýšžöüäôÁÉÍÓÚÝŠŽÖÜÄÔ„“”–" for c in high) and sum(c in _CENTRAL for c in high) > 0
    kinds = [_kind(c) for c in high]
    han = [c for c, k in zip(high, kinds) if k == "C"]
    other = [c for c, k in zip(high, kinds) if k not in ("C", "J") and not ("\u3000" <= c <= "\u303f" or "\uff00" <= c <= "\uff5e")]
    if other or len(han) + kinds.count("J") < 3 or _HANJA_IN_WORD.search(back):
        return False
    if written == "cp932":
        return kinds.count("J") >= max(2, len(han) // 2) and not any("\uff66" <= c <= "\uff9f" for c in high)
    return "J" not in kinds and sum(_level_one(c, written) for c in han) >= 0.95 * len(han)


_HANGUL, _HAN = re.compile("[가-힣]"), re.compile(r"[\u3400-\u9fff\uf900-\ufaff]")


def _other(text: str) -> list[tuple[float, str]]:
    """(cost, reading) of the further readings of a text that look native."""
    out = []
    # Chinese read as Korean gives Chinese characters among the syllables; without them it is Korean
    korean = len(_HANGUL.findall(text)) > 2 * len(_HAN.findall(text))
    for read, written in OTHER_PAIRS:
        if korean or written == "cp1250" and not _MISREAD.search(text) or read in ("cp1251", "koi8-r") and _native(text, read):
            continue
        raw = _encode(text, read)
        if raw is None:
            continue
        try:
            back = raw.decode(written)
        except UnicodeDecodeError:
            continue
        if back != text and _native(back, written):
            # common characters of a native text cost a fraction of what strange ones do
            out.append((cost(back) * (0.25 if written != "cp1250" else 0.5), back))
    return out


def _readings(text: str) -> list[tuple[float, str]]:
    """(cost, reading) of every reading of a line that has no lost character, the line's own among them, cheapest first."""
    now = cost(text)
    found = {text: now}
    for read, written in PAIRS:
        raw = _encode(text, read)
        if raw is None:
            continue
        try:
            back = raw.decode(written)
        except UnicodeDecodeError:
            continue
        if back == text or written == "cp949" and (_unlikely_korean(back, read) or _foreign(text, read)):
            continue
        c = cost(back)
        if written == "utf-8" and c < now:
            c *= 0.25  # a text that is strictly valid UTF-8 by chance is very rare
        found[back] = min(c, found.get(back, c))
    for c, back in _other(text):
        found[back] = min(c, found.get(back, c))
    return sorted((c, x) for x, c in found.items())


_FOREIGN = re.compile(r"[\u0386-\u0481]")


def _foreign(text: str, read: str) -> bool:
    """Greek or Cyrillic letters (as such, or as look-alikes in a Latin word): no reading of Korean by pairs gives them."""
    return read in ("gbk", "big5", "shift_jisx0213") and bool(_FOREIGN.search(text))


def certain(line: str, layers: int = LAYERS) -> bool:
    """Is the last step of a repair far cheaper than every other reading?"""
    for _ in range(layers):
        new = _parts(line) if LOST in line else _whole(line)
        if new == line:
            return True
        if LOST not in line and not _KOREAN.match(line) and not _RARE.match(line):
            rivals = [c for c, x in _readings(line) if x not in (new, line)]
            own = next((c for c, x in _readings(line) if x == new), 0.0)
            if rivals and min(rivals) < own * MARGIN:
                return False
        line = new
    return False


def _whole(text: str) -> str:
    """text with one layer undone where that lowers the cost enough; else text."""
    if _KOREAN.match(text):
        try:
            back = text.encode("cp949").decode("utf-8")
        except UnicodeError:
            return text
        # by chance a line of one or two syllables is valid too: its letters then stand beside no Latin letter
        new = list(_EUROPEAN.finditer(back))
        beside = sum(_beside(back, m) for m in new)
        return back if beside * 2 >= len(new) > 0 and sum(len(m[0]) for m in new) == len(_HIGH.findall(back)) else text
    if _RARE.match(text):
        try:
            return text.encode("utf-8").decode("cp949")
        except UnicodeError:
            return text
    now = cost(text)
    least, best = _readings(text)[0]
    return best if best != text and (least < now * SHARE or least == 0 < now) else text


def _parts(text: str) -> str:
    """A line with lost characters: bytes that survive are decoded, what can't be is left as U+FFFD."""
    best, least = text, cost(re.sub(f"{LOST}+", LOST, text)) * 0.8
    for read, written in PAIRS:
        out, ok = [], True
        for part in re.split(f"({LOST}+)", text):
            if part.startswith(LOST):
                out.append(b"\xff" * len(part))
                continue
            raw = _encode(part, read)
            if raw is None:
                ok = False
                break
            out.append(raw)
        if ok:
            back = re.sub(f"{LOST}+", LOST, b"".join(out).decode(written, "replace"))
            if (c := cost(back)) < least:
                best, least = back, c
    return best


@functools.lru_cache(1 << 14)
def repair(line: str, layers: int = LAYERS) -> str:
    """The line as it was written, as far as it can be restored; the line itself if it wasn't garbled."""
    for _ in range(layers):
        if not _HIGH.search(line):
            break
        new = _parts(line) if LOST in line else _whole(line)
        if new == line:
            break
        line = new
    return line


def affected(line: str) -> bool:
    return LOST in line or repair(line) != line


def _doubtful(text: str) -> Iterator[tuple[int, str]]:
    """(number, line) of the lines that aren't plain ASCII or plain Hangul."""
    for no, line in enumerate(text.split("\n"), 1):
        if not line.isascii():
            yield no, line


def lines(df: DataFrame, key: str, field: str, restored: bool = False) -> DataFrame:
    """(key, line_no[, line, restored, complete]) of the garbled lines of a text column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, [field]):
            ids, nos, old, new = [], [], [], []
            texts = pc.fill_null(batch.column(1), "")
            for i, text in enumerate(texts.to_pylist()):
                if text.isascii():
                    continue
                for no, line in _doubtful(text):
                    if affected(line):
                        ids.append(i)
                        nos.append(no)
                        old.append(line)
                        new.append(repair(line))
            if ids:
                arrays = [batch.column(0).take(pa.array(ids)), pa.array(nos, pa.int64())]
                names = [key, "line_no"]
                if restored:
                    arrays += [pa.array(old), pa.array(new), pa.array([LOST not in x and certain(o) for o, x in zip(old, new)])]
                    names += ["line", "restored", "complete"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    more = ", line string, restored string, complete boolean" if restored else ""
    return df.where(F.col(key).isNotNull()).select(F.col(key).cast("long"), field).mapInArrow(run, f"{key} long, line_no long{more}")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(table(spark, sf_dir, "task_payloads"), "payload_id", "raw_text")


def p4_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The garbled lines with their restored text; complete is false where characters were lost for good."""
    return lines(table(spark, sf_dir, "task_payloads"), "payload_id", "raw_text", restored=True)
