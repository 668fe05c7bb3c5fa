"""Decoding of legacy Arabic text, in Arrow batches: Spark has no safe decoder for these bytes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# From how many bytes and which share of zeros UTF-16 is taken for granted; share and number of high Latin letters that look wrong.
UTF16_BYTES, UTF16_ZEROS = 16, 0.25
MOJIBAKE_SHARE, MOJIBAKE_LETTERS = 0.2, 4
ARABIC, HIGH_LATIN = "[؀-ۿ]", "[À-ÿ]"


def decode(data: bytes | None) -> str:
    """UTF-16 where every other byte is mostly zero, else the Arabic code page, else UTF-8, else nothing."""
    if data is None:
        return ""
    zeros = data[1::2].count(0)
    guesses = ["cp1256", "utf-8"]
    if len(data) >= UTF16_BYTES and zeros / (len(data) / 2) > UTF16_ZEROS:
        guesses.insert(0, "utf-16le")
    for encoding in guesses:
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return ""


def repair(text: str) -> str:
    """Text whose Arabic was read as Latin, read again; other text as it is."""
    if re.search(ARABIC, text) or len(re.findall(HIGH_LATIN, text)) < max(MOJIBAKE_LETTERS, int(len(text) * MOJIBAKE_SHARE)):
        return text
    again = bytes(ord(c) & 0xFF for c in text).decode("cp1256", errors="ignore")
    return again if re.search(ARABIC, again) else text


def decoded(data: Column) -> Column:
    """Text of binary values."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda b: decode(None if b is None else bytes(b)))

    return run(data)


def suspicious(text: Column) -> Column:
    """Whether ``repair`` may change a text; a cheap test that keeps most rows in the JVM."""
    letters = F.regexp_count(text, F.lit(HIGH_LATIN))
    return ~text.rlike(ARABIC) & (letters >= F.greatest(F.lit(MOJIBAKE_LETTERS), F.floor(F.length(text) * MOJIBAKE_SHARE)))


def repaired(text: Column) -> Column:
    """Text with mojibake undone, without NUL, with the Persian kaf that stands for an elongation mark replaced by it."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else repair(x))

    fixed = F.when(suspicious(text), run(F.when(suspicious(text), text))).otherwise(text)
    return F.translate(F.replace(fixed, F.lit("\0"), F.lit("")), "ک", "ـ")
