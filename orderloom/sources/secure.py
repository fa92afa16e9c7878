"""Password-protected input: OpenSSL-salted AES as Column expressions, members of protected ZIP files."""

from __future__ import annotations

import io
import re
import zipfile

from pyspark.sql import Column
from pyspark.sql import functions as F


def _md5(c: Column) -> Column:
    return F.unhex(F.md5(c))


def derive(password: Column, salt: Column, key_bytes: int) -> tuple[Column, Column]:
    """(key, iv) by OpenSSL's chain of MD5 digests."""
    seed = F.concat(F.encode(password, "UTF-8"), salt)
    d1 = _md5(seed)
    d2 = _md5(F.concat(d1, seed))
    d3 = _md5(F.concat(d2, seed))
    return (d1, d2) if key_bytes == 16 else (F.concat(d1, d2), d3)


def decrypt(text: Column, password: Column) -> Column:
    """The plain bytes of base64 text that `openssl enc` salted and encrypted (AES-CBC, 256 bits tried before 128);
    null if the password is wrong or the text is none of that kind. All of it runs in the JVM."""
    raw = F.try_to_binary(F.regexp_replace(text, r"\s+", ""), F.lit("base64"))
    ok = F.substring(raw, 1, 8) == F.encode(F.lit("Salted__"), "UTF-8")
    salt, body = F.substring(raw, 9, 8), F.substring(raw, 17, 1 << 30)
    tries = []
    for size in (32, 16):
        key, iv = derive(password, salt, size)
        tries.append(F.try_aes_decrypt(F.concat(iv, body), key, F.lit("CBC"), F.lit("PKCS")))
    return F.when(ok, F.coalesce(*tries))


def member_rank(name: str) -> tuple[int, int, int, str]:
    """index.html first, then by depth, length and name."""
    low = name.lower()
    return (0 if low.rsplit("/", 1)[-1] in ("index.html", "index.htm") else 1, low.count("/"), len(low), low)


def html_member(raw: bytes, password: str | None = None) -> bytes | None:
    """The page inside a ZIP file; names that climb out of the archive are never used."""
    if not raw.startswith(b"PK"):
        return None
    z = zipfile.ZipFile(io.BytesIO(raw))
    names = [n for n in z.namelist() if n.lower().endswith((".html", ".htm")) and not n.startswith("/") and ".." not in n.split("/")]
    for name in sorted(names, key=member_rank):
        for pwd in [None, *(password.encode(e) for e in ("utf-8", "cp949", "utf-16-le"))] if password else [None]:
            try:
                return z.read(name, pwd=pwd)
            except RuntimeError:
                continue
    return None


# What pages say that hold a protected mail and ask for its password.
MAIL_WORDS, ASK_WORDS = ["보안메일", "인증메일"], ["인증암호", "인증 암호"]
ACTION_WORDS = ["인증하기", "인증 하기", "본문 보기", "보안메일 보기", "열람하기"]
NOTICE_WORDS = ["주민번호 앞 6자리", "소유자가 아닐 경우", "본인 인증"]
_BASE64 = re.compile(r"[A-Za-z0-9+/][A-Za-z0-9+/\s]{31,}={0,2}")
_LITERALS = re.compile(r"""(?:"[^"\n]*"|'[^'\n]*')(?:\s*\+\s*(?:"[^"\n]*"|'[^'\n]*'))*""")
_PASSWORD_FIELD = re.compile(r"<input\b[^>]*type\s*=\s*['\"]?password", re.I)
#: How salted text begins in base64.
SALTED = "U2FsdGVkX1"


def ciphers(page: str) -> list[str]:
    """The texts of a page that may be encrypted, salted and long ones first: as they stand, or put together from a
    script's string literals."""
    found = [m[0] for m in _BASE64.finditer(page)]
    found += ["".join(re.findall(r"[\"']([^\"'\n]*)[\"']", m[0])) for m in _LITERALS.finditer(page)]
    tidy = (re.sub(r"\s+", "", x.replace("\\n", "").replace("\\/", "/")) for x in found)
    kept = dict.fromkeys(x[x.find(SALTED) :] if SALTED in x else x for x in tidy if len(x) >= 32)
    return sorted((x for x in kept if re.fullmatch(r"[A-Za-z0-9+/]{32,}={0,2}", x)), key=lambda x: (not x.startswith(SALTED), -len(x)))


def is_shell(page: str) -> bool:
    """Does a page hold a protected mail and ask for its password?"""
    has = lambda words: any(w in page for w in words)
    tight = page.lower().replace(" ", "")
    crypto = any(w in tight for w in ("crypto-js", "cryptojs", "aes.decrypt", "decrypt("))
    asks, mail, acts = has(ASK_WORDS), has(MAIL_WORDS), has(ACTION_WORDS)
    blob = SALTED in page or "Salted__" in page
    if asks and crypto and (mail or acts):
        return True
    if not _PASSWORD_FIELD.search(page):
        return "Salted__" in page and bool(_BASE64.search(page))
    return (mail or asks or has(NOTICE_WORDS)) and (crypto or acts or blob) or crypto and blob
