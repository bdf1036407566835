"""Order of distribution package versions, as keys that compare byte by byte."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed: pre- and post-release suffixes of apk versions, in order.
APK_SUFFIXES = ("alpha", "beta", "pre", "rc", "", "cvs", "svn", "git", "hg", "p")


def _digits(s: str) -> bytes:
    s = s.lstrip("0")
    return len(s).to_bytes(2, "big") + s.encode()


def _dpkg_part(s: str) -> bytes:
    """Text and numbers in turn; a tilde is below the end, letters are below other characters."""
    out = b""
    for text, number in re.findall(r"(\D*)(\d*)", s):
        if not text and not number:
            break
        for c in text:
            out += b"\x01" if c == "~" else bytes([0x10]) + c.encode() if c.isalpha() and c.isascii() else bytes([0xA0]) + c.encode()
        out += b"\x05" + _digits(number)
    return out + b"\x05"


def dpkg_key(version: str | None) -> bytes | None:
    """Bytes that order as ``epoch:upstream-revision`` does; null for what is no version."""
    v = (version or "").strip()
    epoch, colon, rest = v.partition(":")
    if not colon:
        epoch, rest = "0", v
    upstream, _, revision = rest.rpartition("-") if "-" in rest else (rest, "", "")
    if not epoch.isdigit() or not upstream or not re.fullmatch(r"[A-Za-z0-9.+~:\-]+", rest):
        return None
    return _digits(epoch) + b"\x00" + _dpkg_part(upstream) + b"\x00" + _dpkg_part(revision or "0")


def apk_key(version: str | None) -> bytes | None:
    """Bytes that order as ``1.2.3b_rc1-r4`` does; null for what is no version."""
    m = re.fullmatch(r"(\d+(?:\.\d+)*)([a-z]?)((?:_[a-z]+\d*)*)(?:-r(\d+))?", (version or "").strip())
    if not m:
        return None
    numbers = b"".join(b"\x01" + _digits(x) for x in m[1].split("."))
    suffixes = b""
    for word, number in re.findall(r"_([a-z]+)(\d*)", m[3]):
        if word not in APK_SUFFIXES:
            return None
        suffixes += bytes([0x20 + APK_SUFFIXES.index(word)]) + _digits(number or "0")
    return numbers + b"\x00" + (m[2] or "\x01").encode() + b"\x00" + suffixes + bytes([0x20 + APK_SUFFIXES.index("")]) + _digits(m[4] or "0")


def _keyed(version: Column, how) -> Column:
    @F.pandas_udf("binary")
    def keys(v: pd.Series) -> pd.Series:
        return v.map(how)

    return keys(version)


def compared(a: Column, b: Column, kind: str) -> Column:
    """-1, 0, 1 or null for two dpkg or apk versions."""
    how = {"dpkg": dpkg_key, "apk": apk_key}[kind]
    x, y = _keyed(a, how), _keyed(b, how)
    return F.when(x.isNull() | y.isNull(), F.lit(None).cast("int")).when(x < y, -1).when(x > y, 1).otherwise(0)


def distro_verdict(verdicts: Column) -> Column:
    """Verdicts per release of a distribution must agree, else null; so must there be any."""
    known = F.filter(verdicts, lambda v: v.isNotNull())
    agree = F.size(F.array_distinct(known)) == 1
    return F.when(agree & (F.size(known) == F.size(verdicts)), F.get(known, F.lit(0)))
