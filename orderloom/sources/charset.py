"""Bytes to text: candidates by mark, declaration and look, the one that reads best."""

from __future__ import annotations

import re

# Names that mail programs give to a wider encoding.
ALIASES = {"ks_c_5601-1987": "cp949", "ks_c_5601": "cp949", "euc-kr": "cp949", "euckr": "cp949", "gb2312": "gb18030", "gbk": "gb18030", "shift_jis": "cp932", "iso-8859-1": "cp1252", "latin-1": "cp1252", "utf8": "utf-8"}
DEFAULTS = ["utf-8", "cp949", "utf-16-le", "cp1252"]
_META = re.compile(rb"""(?i)<meta[^>]+charset\s*=\s*["']?\s*([\w-]+)""")


def candidates(raw: bytes, declared: str | None = None) -> list[str]:
    out: list[str] = []
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if raw.startswith(mark):
            out.append(name)
    if declared:
        out.append(declared.strip().strip("\"'").lower())
    if m := _META.search(raw):
        out.append(m[1].decode("ascii").lower())
    if len(raw) > 8 and raw[1::2].count(0) > len(raw) // 4:
        out.append("utf-16-le")
    out += DEFAULTS
    return list(dict.fromkeys(ALIASES.get(x, x) for x in out))


def score(text: str) -> int:
    """Hangul and common words speak for a reading, lost and control characters against it."""
    hangul = sum("가" <= c <= "힣" for c in text)
    lost = text.count("�")
    control = sum(c < " " and c not in "\t\r\n\f" for c in text)
    odd = sum("\x80" <= c <= "\x9f" or "" <= c <= "" for c in text)
    latin = len(re.findall(r"[À-ÿ]{3,}", text))
    return 2 * hangul - 40 * lost - 20 * control - 20 * odd - 15 * latin


def decode(raw: bytes, declared: str | None = None) -> str:
    """The best reading; the earliest of equals. Strict readings come before lossy ones."""
    best: tuple[int, int, str] | None = None
    for rank, name in enumerate(candidates(raw, declared)):
        try:
            text = raw.decode(name)
        except (UnicodeDecodeError, LookupError):
            continue
        if best is None or score(text) > best[0]:
            best = (score(text), -rank, text)
    return best[2].lstrip("﻿") if best else raw.decode("utf-8", "replace")
