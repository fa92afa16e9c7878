"""Problem 5: text that looks the same but differs in its characters.

Method: a trie of canonical spellings (fund names; words of names) is walked by a weighted edit automaton in
which look-alikes and ignorable characters cost nothing, a difference of case, space or mark costs a little and
any real edit more than is allowed. The cheapest canonical spelling is selected; what matches none is
normalized by table. A fund name is affected if its cheapest path to a name of the master uses look-alikes or
ignorables, which the automaton counts along the path; names that reach none, amounts (which have no vocabulary) and
texts go by table: a character that stands for another or isn't seen, a word of two scripts, a number with letters;
words of a text that are wholly in another script are asked of the trie of words. All runs per row in Arrow batches,
without a shuffle; a worker walks the automaton once per spelling.

Defined cases: null and empty values are plain and normalize to themselves; repeated rows give one row each in
the normalizing query and one in p5_found (whose rows are distinct by key); rows without an id are left out; extra columns are ignored.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import LIMIT, codepoints, slices, table

#: Rows of the vocabulary (funds) that a worker holds as a trie; beyond it `vocabulary` refuses.
MOST_NAMES = 100_000

# Letters of other scripts and the Latin letters that they look like.
LATIN_LOOKALIKES = {
    # Cyrillic
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p",
    "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Ԍ": "G", "Н": "H", "І": "I", "Ӏ": "I", "Ј": "J", "К": "K",
    "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "У": "Y", "Ү": "Y",
    # Greek
    "α": "a", "ϲ": "c", "ι": "i", "ϳ": "j", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "γ": "y", "χ": "x",
    "Α": "A", "Β": "B", "Ϲ": "C", "Ε": "E", "Η": "H", "Ι": "I", "Ϳ": "J", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Χ": "X", "Υ": "Y", "Ζ": "Z",
    # Armenian
    "օ": "o", "ս": "u", "ո": "n", "հ": "h", "ց": "g", "զ": "q", "Օ": "O", "Ս": "U",
    # Latin letters of phonetic alphabets and the like
    "ɑ": "a", "ɡ": "g", "ɩ": "i", "ı": "i", "ʏ": "y", "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s",
}
#: Latin letters that never occur in ordinary text of this domain beside the letter they look like.
ODD_LATIN = frozenset("ɑɡɩʏᴄᴏᴠᴡᴢꜱ")
# Marks and the ordinary marks that they look like.
MARKS = {
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-", "⁃": "-", "﹣": "-", "－": "-",
    "‚": ",", "，": ",", "﹐": ",", "،": ",", "٫": ",", "．": ".", "․": ".", "‘": "'", "’": "'", "ʼ": "'", "′": "'",
    "“": '"', "”": '"', "″": '"', "∙": "·", "‧": "·", "・": "·", "⋅": "·", "ㆍ": "·", "ᆞ": "·", "·": "·", "･": "·",
    "⁄": "/", "∕": "/", "∣": "|", "ǀ": "|", "∗": "*", "∼": "~", "：": ":", "；": ";",
}
#: What a letter stands for inside a number.
IN_NUMBERS = {**dict.fromkeys("OoОоΟοՕօ", "0"), **dict.fromkeys("lIІӀӏΙ|", "1")}
FILLERS = frozenset("͏ᅟᅠ឴឵ㅤﾠ⠀")
#: Costs of the automaton: another case; a space or mark too many or too few; any other edit; the most accepted.
CASE, LAYOUT, EDIT, MOST_COST = 10_000, 20_000, 1_000_000, 900_000
#: A look-alike or ignorable costs nothing; it is counted in the last digits of the cost, which settle no comparison.
LOOK = 1

PLAIN, BAD, OTHER, MARK = 0, 1, 2, 3


def _script(c: str) -> str:
    o = ord(c)
    if o < 0x80:
        return "L" if c.isalpha() else ""
    if 0x370 <= o <= 0x3FF or 0x1F00 <= o <= 0x1FFF:
        return "G" if c.isalpha() else ""
    if 0x400 <= o <= 0x52F:
        return "C" if c.isalpha() else ""
    if 0x530 <= o <= 0x58F:
        return "A" if c.isalpha() else ""
    if o <= 0x24F or 0x250 <= o <= 0x2AF or 0x1D00 <= o <= 0x1D7F or 0x1E00 <= o <= 0x1EFF:
        return "L" if c.isalpha() else ""
    return "H" if 0xAC00 <= o <= 0xD7A3 else ""


def ignorable(c: str) -> bool:
    o = ord(c)
    return (
        c in FILLERS
        or unicodedata.category(c) == "Cf"
        or 0xFE00 <= o <= 0xFE0F
        or 0x180B <= o <= 0x180F
        or 0xE0100 <= o <= 0xE01EF
        or unicodedata.category(c) == "Cc"
        and c not in "\t\n\r"
    )


def special_space(c: str) -> bool:
    return c != " " and unicodedata.category(c) in ("Zs", "Zl", "Zp")


def _plain_for(c: str) -> str | None:
    """What c stands for by table alone; None if c is plain."""
    if c in MARKS:
        return MARKS[c]
    if special_space(c):
        return " "
    if ignorable(c):
        return ""
    if c in ODD_LATIN:
        return LATIN_LOOKALIKES[c]
    if (n := unicodedata.normalize("NFC", c)) != c:
        return n
    tag, _, _ = unicodedata.decomposition(c).partition(" ")
    o = ord(c)
    if (
        tag in ("<wide>", "<narrow>", "<font>")
        or tag == "<compat>" and (0x2160 <= o <= 0x217F or 0xFB00 <= o <= 0xFB06 or o == 0xB5 or 0x132 <= o <= 0x133)
    ):
        return unicodedata.normalize("NFKC", c)
    return None


@functools.cache
def plain_for(c: str) -> str | None:
    return _plain_for(c)


@functools.cache
def class_table() -> np.ndarray:
    """PLAIN; BAD: stands for something else or isn't seen; OTHER: a script to compare with its word; MARK: combining."""
    out = np.zeros(LIMIT + 1, np.uint8)
    out[LIMIT] = PLAIN
    for o in range(0x80, LIMIT):
        if 0x3400 <= o <= 0x9FFF or 0xAC00 <= o <= 0xD7A3 or 0xD800 <= o <= 0xF8FF or 0x20000 <= o <= 0x2F7FF:
            continue
        c = chr(o)
        if 0x1100 <= o <= 0x11FF or plain_for(c) is not None:
            out[o] = BAD
        elif _script(c) in ("G", "C", "A"):
            out[o] = OTHER
        elif unicodedata.combining(c):
            out[o] = MARK
    for o in (*range(0x2F800, 0x2FA20),):
        out[o] = BAD
    return out


def _classes(points: np.ndarray) -> np.ndarray:
    out = class_table()[np.minimum(points, LIMIT)]
    out[(points >= 0xE0000) & (points <= 0xE0FFF)] = BAD
    return out


_WORD = re.compile(r"[^\W\d_]+")
_NUMBER = re.compile(
    r"(?<![\w.,])[-+]?(?:[\dOolI]{1,3}(?:,[\dOolI]{3})+(?:\.[\dOolI]+)?|[\dOlI]+\.[\dOolI]+|[\dOlI]{3,})(?![\w,]|\.\w)"
)
_NUMBER_ANY = re.compile(
    r"(?<![\w.,])[-+]?(?:[\dOolIОоІӀΟοΙ]{1,3}(?:,[\dOolIОоІӀΟοΙ]{3})+(?:\.[\dOolIОоІӀΟοΙ]+)?|[\dOlIОІΟΙ]+\.[\dOolIОоІΟοΙ]+|[\dOlIОІΟΙ]{2,})(?![\w,]|\.\w)"
)
#: RE2: a letter that looks like a digit next to a digit or a comma.
_NUMBER_HINT = r"[0-9,][OolI]|[OolI][,0-9]"


def odd_number(token: str) -> bool:
    digits = sum(c.isdigit() for c in token)
    return digits > 0 and any(c in IN_NUMBERS for c in token) and ("," in token or digits >= 2)


def mixed(word: str) -> bool:
    kinds = {s for s in map(_script, word) if s and s != "H"}
    return len(kinds) > 1


def key(text: str) -> str:
    """text without what CASE and LAYOUT pay for: case, spaces and marks."""
    return "".join(c for c in unicodedata.normalize("NFC", text) if c.isalnum()).casefold()


class Trie:
    """Canonical spellings, walked by a weighted edit automaton."""

    def __init__(self, spellings: Iterable[str]):
        spellings = list(spellings)
        self.keys = {key(x) for x in spellings if x}
        self.children: list[dict[str, int]] = [{}]
        self.canonical: list[str | None] = [None]
        for s in sorted({x for x in spellings if x}):
            node = 0
            for c in s:
                nxt = self.children[node].get(c)
                if nxt is None:
                    nxt = self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.canonical.append(None)
                node = nxt
            self.canonical[node] = s

    def _close(self, states: dict[int, int], limit: int) -> dict[int, int]:
        """Adds what is reached by spaces and marks that the input leaves out."""
        todo = list(states.items())
        while todo:
            node, cost = todo.pop()
            for c, nxt in self.children[node].items():
                if not c.isalnum() and (new := cost + LAYOUT) <= limit and new < states.get(nxt, 1 << 60):
                    states[nxt] = new
                    todo.append((nxt, new))
        return states

    def _step(self, states: dict[int, int], options: tuple[tuple[str, int], ...], limit: int) -> dict[int, int]:
        out: dict[int, int] = {}
        for node, cost in states.items():
            for text, extra in options:
                reached = [(node, cost + extra)]
                for c in text:
                    follow = []
                    for n, k in reached:
                        kids = self.children[n]
                        if c in kids:
                            follow.append((kids[c], k))
                        for other in {c.lower(), c.upper()} - {c}:
                            if other in kids:
                                follow.append((kids[other], k + CASE))
                    reached = follow
                for n, k in reached:
                    if k <= limit and k < out.get(n, 1 << 60):
                        out[n] = k
        return self._close(out, limit)

    def match(self, text: str, limit: int = MOST_COST) -> tuple[str, int, int] | None:
        """(cheapest canonical spelling, its cost, look-alikes and ignorables on the way); None if none costs `limit` or less."""
        limit += len(text) * LOOK
        states = self._close({0: 0}, limit)
        composed = unicodedata.normalize("NFC", text)
        for c in composed:
            states = self._step(states, options(c), limit)
            if not states:
                return None
        ends = [(k, self.canonical[n]) for n, k in states.items() if self.canonical[n] is not None]
        if not ends:
            return None
        least, name = min(ends)
        looks = least % CASE
        return name, least - looks, looks + (composed != text)


@functools.lru_cache(1 << 16)
def options(c: str) -> tuple[tuple[str, int], ...]:
    """What the automaton may read c as, each with its cost."""
    out = {c: 0}
    plain = plain_for(c)
    if plain is not None:
        out[plain] = LOOK
    if c in LATIN_LOOKALIKES:
        out[LATIN_LOOKALIKES[c]] = LOOK
    for other, latin in LATIN_LOOKALIKES.items():
        if latin == c:
            out.setdefault(other, LOOK)
    if not c.isalnum() and "" not in out:
        out[""] = LAYOUT
    return tuple(out.items())


def skeleton(word: str) -> str:
    return "".join(LATIN_LOOKALIKES.get(c, c) for c in word)


def recased(m: re.Match, words: Trie) -> bool:
    """Is the word, wholly of look-alikes, one of `words` in another case? Not if its line holds other letters of its script."""
    w, text = m[0], m.string
    if not all(c in LATIN_LOOKALIKES for c in w) or key(w) in words.keys or words.match(w) is None:
        return False
    stop = text.find("\n", m.end())
    line = text[text.rfind("\n", 0, m.start()) + 1 : stop if stop >= 0 else len(text)]
    return not any(_script(c) == _script(w[0]) and c not in LATIN_LOOKALIKES for c in line)


def normalize_by_table(text: str, words: Trie | None = None) -> str:
    """text with every character that stands for another replaced; words of two scripts are brought into one."""
    text = "".join(c if (p := plain_for(c)) is None else p for c in unicodedata.normalize("NFC", text))
    text = unicodedata.normalize("NFC", text)
    text = _NUMBER_ANY.sub(lambda m: "".join(IN_NUMBERS.get(c, c) for c in m[0]) if odd_number(m[0]) else m[0], text)

    def word(m: re.Match) -> str:
        w = m[0]
        if w.isascii() or not any(c in LATIN_LOOKALIKES for c in w):
            return w
        if not mixed(w):
            known = words is not None and words.match(w, 0)
            return known[0] if known else skeleton(w) if words is not None and recased(m, words) else w
        foreign = [c for c in w if _script(c) in ("C", "G", "A") and c not in LATIN_LOOKALIKES]
        if not foreign:
            return skeleton(w)
        back = {v: k for k, v in reversed(LATIN_LOOKALIKES.items()) if _script(k) == _script(foreign[0])}
        return "".join(back.get(c, c) if _script(c) == "L" else c for c in w)

    return _WORD.sub(word, text)


class Finder:
    """Tells which values hold look-alikes or unseen characters, and brings them to one form."""

    def __init__(self, names: Iterable[str], others: Iterable[str] = ()):
        names, others = [x for x in names if x], [x for x in others if x]
        self.names = Trie(names)
        self.known = set(names)
        self.vocabulary = {w for x in [*names, *others] for w in _WORD.findall(x)}
        self.words = Trie(self.vocabulary)
        self._name = functools.lru_cache(1 << 17)(self._name_of)
        self.looks = functools.lru_cache(1 << 18)(self._looks)

    def _looks(self, text: str) -> int | None:
        """How many look-alikes and ignorables lie on the cheapest path to a name of the master; None if there is no path."""
        if text in self.known:
            return 0
        found = self.names.match(text)
        return None if found is None else found[2]

    def odd_words(self, text: str) -> bool:
        for found in _WORD.finditer(text):
            w = found[0]
            if w.isascii():
                continue
            if mixed(w):
                return True
            if all(c in LATIN_LOOKALIKES for c in w) and w not in self.vocabulary:
                if (m := self.words.match(w, 0)) and m[0] != w or recased(found, self.words):
                    return True
        return False

    def flagged(self, column: pa.Array, amounts: bool = False, names: bool = False) -> np.ndarray:
        """For each value of a string column (of amounts, of fund names): does it hold a character that isn't plain?"""
        column = pc.fill_null(column, "")
        if names:
            coded = column.dictionary_encode()
            spelt = coded.dictionary
            looks = [self.looks(x) if x else 0 for x in spelt.to_pylist()]
            lost = pa.array([k for k, n in enumerate(looks) if n is None], pa.int64())
            own = np.array([bool(n) for n in looks])
            own[lost.to_numpy()] = self._by_table(spelt.take(lost), False)
            return own[coded.indices.to_numpy()] if len(own) else np.zeros(len(column), bool)
        return self._by_table(column, amounts)

    def _by_table(self, column: pa.Array, amounts: bool) -> np.ndarray:
        points, starts = codepoints(column)
        kind = _classes(points)
        odd = np.concatenate([[0], np.cumsum(kind == BAD)])
        out = odd[starts[1:]] > odd[starts[:-1]]
        look = np.concatenate([[0], np.cumsum(kind >= OTHER)])
        doubt = ~out & (look[starts[1:]] > look[starts[:-1]])
        for i in np.flatnonzero(doubt):
            text = column[int(i)].as_py()
            out[i] = unicodedata.normalize("NFC", text) != text or (amounts and any(c in IN_NUMBERS for c in text)) or self.odd_words(text) or any(odd_number(m[0]) for m in _NUMBER_ANY.finditer(text))
        hint = pc.match_substring_regex(column, r"[OolI]" if amounts else _NUMBER_HINT).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(hint & ~out):
            text = column[int(i)].as_py()
            if amounts:
                out[i] = any(c.isdigit() for c in text) and not re.search(r"[A-Za-z]{2,}", re.sub(r"[OolI]", "", text))
            else:
                out[i] = any(odd_number(m[0]) for m in _NUMBER.finditer(text))
        return out

    def _name_of(self, text: str) -> str:
        if text in self.known:
            return text
        found = self.names.match(text)
        return found[0] if found else " ".join(normalize_by_table(text, self.words).split())

    def name(self, text: str | None) -> str | None:
        """The name of the master that text looks like; else text normalized by table, with single spaces."""
        return text if not text else self._name(text)

    def amount(self, text: str | None) -> str | None:
        """text as a plain signed number without grouping; text normalized by table if it is no number."""
        if not text:
            return text
        plain = normalize_by_table(text)
        plain = "".join(IN_NUMBERS.get(c, c) for c in plain)
        digits = re.sub(r"[\s,'_]", "", plain)
        if not re.fullmatch(r"[-+]?\d*\.?\d*", digits) or not re.search(r"\d", digits):
            return plain.strip()
        whole, _, rest = digits.lstrip("+-").partition(".")
        whole, rest = whole.lstrip("0") or "0", rest.rstrip("0")
        number = whole + ("." + rest if rest else "")
        return "-" + number if digits[0] == "-" and number != "0" else number

    def text(self, text: str | None) -> str | None:
        return text if not text else normalize_by_table(text, self.words)


def vocabulary(spark: SparkSession, sf_dir: str, most: int = MOST_NAMES) -> tuple[list[str], list[str]]:
    """The fund master's names and managers, a table that doesn't grow; its size is checked before it is collected."""
    rows = table(spark, sf_dir, "funds").select("fund_name", "manager_name").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the vocabulary has more than {most} rows; split it by first letter before building tries")
    return sorted({r[0] for r in rows if r[0]}), sorted({r[1] for r in rows if r[1]})


@functools.lru_cache(4)
def finder(names: tuple[str, ...], others: tuple[str, ...]) -> Finder:
    """One finder per worker process and vocabulary."""
    return Finder(names, others)


def find(df: DataFrame, id_column: str, fields: list[str], names: list[str], others: list[str], table_name: str) -> DataFrame:
    """(table_name, row_id, field_name) of every value of `fields` that isn't plain."""
    key = (tuple(names), tuple(others))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = finder(*key)
        for batch in slices(batches, fields):
            ids = batch.column(0)
            for k, field in enumerate(fields, 1):
                hit = np.flatnonzero(own.flagged(batch.column(k), field == "transfer_amount", field == "fund_name"))
                if len(hit):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([table_name] * len(hit)), ids.take(pa.array(hit)), pa.array([field] * len(hit))],
                        ["table_name", "row_id", "field_name"],
                    )

    return df.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long"), *fields).mapInArrow(run, "table_name string, row_id long, field_name string")


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "order_extractions"), table(spark, sf_dir, "task_payloads")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, others = vocabulary(spark, sf_dir)
    orders, payloads = _tables(spark, sf_dir)
    return find(orders, "order_id", ["fund_name", "transfer_amount"], names, others, "order_extractions").unionByName(
        find(payloads, "payload_id", ["markdown_text"], names, others, "task_payloads")
    )


def p5_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value that isn't plain, with its one consistent form."""
    names, others = vocabulary(spark, sf_dir)
    key = (tuple(names), tuple(others))
    orders, payloads = _tables(spark, sf_dir)

    def of(df: DataFrame, id_column: str, fields: list[str], table_name: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = finder(*key)
            form = {"fund_name": own.name, "transfer_amount": own.amount, "markdown_text": own.text}
            for batch in slices(batches, fields):
                for k, field in enumerate(fields, 1):
                    hit = pa.array(np.flatnonzero(own.flagged(batch.column(k), field == "transfer_amount", field == "fund_name")))
                    if len(hit):
                        values = batch.column(k).take(hit)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([table_name] * len(hit)), batch.column(0).take(hit), pa.array([field] * len(hit)), values, pa.array([form[field](x) for x in values.to_pylist()], pa.string())],
                            ["table_name", "row_id", "field_name", "value", "plain_value"],
                        )

        return df.select(F.col(id_column).cast("long"), *fields).mapInArrow(run, "table_name string, row_id long, field_name string, value string, plain_value string")

    return of(orders, "order_id", ["fund_name", "transfer_amount"], "order_extractions").unionByName(
        of(payloads, "payload_id", ["markdown_text"], "task_payloads")
    )
