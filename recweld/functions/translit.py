"""Transliteration to lower-case ASCII from what Unicode itself says of a character.

Latin letters lose their marks; letters of other scripts are read from their Unicode names. Indic scripts have the inherent
vowel, which vowel signs replace and a virama takes away. Nasal marks are n; symbols are a space; characters of scripts
written without spaces are words of their own.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import SYMBOLS, UNSPACED_SCRIPTS

_INDIC = ("DEVANAGARI", "BENGALI", "GURMUKHI", "GUJARATI", "ORIYA", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM", "SINHALA")
_NASAL = re.compile("ANUSVARA|SIGN TIPPI|CANDRABINDU")
_NAMED = re.compile(r"(?:LETTER|LIGATURE|SYLLABLE|DIGIT|VOWEL SIGN|SIGN)\s+(?:[A-Z]+ (?=[A-Z]+$))?([A-Z-]+)")
#: Letters that are no base letter with a mark, and Greek and Cyrillic names that are not their sound (fixed values).
_LETTERS = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ı": "i", "ŋ": "ng", "ь": "", "ъ": "", "ж": "zh", "ш": "sh", "щ": "shch", "ц": "ts", "ч": "ch", "ю": "yu", "я": "ya", "х": "kh", "ё": "yo", "э": "e", "ы": "y", "й": "y"}
_GREEK = {"ALPHA": "a", "BETA": "b", "GAMMA": "g", "DELTA": "d", "EPSILON": "e", "ZETA": "z", "ETA": "i", "THETA": "th", "IOTA": "i", "KAPPA": "k", "LAMDA": "l", "MU": "m", "NU": "n", "XI": "x", "OMICRON": "o", "PI": "p", "RHO": "r", "SIGMA": "s", "TAU": "t", "UPSILON": "y", "PHI": "f", "CHI": "ch", "PSI": "ps", "OMEGA": "o"}


@functools.lru_cache(1 << 16)
def _sound(char: str) -> tuple[str, str]:
    """What a character reads as, and its kind: consonant, vowel sign, virama or other."""
    name, category = unicodedata.name(char, ""), unicodedata.category(char)
    if char.isascii():
        return char, ""
    if _NASAL.search(name):
        return "n", ""
    if category[0] == "S":
        return " ", ""
    low = char.lower()
    if low in _LETTERS:
        return _LETTERS[low], ""
    if char.isdecimal():
        return str(unicodedata.decimal(char)), ""
    plain = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
    if plain.isascii() and plain:
        return plain, ""
    found = _NAMED.search(name)
    own = found[1].lower().replace("-", "") if found else ""
    script = name.split(" ", 1)[0]
    if script == "GREEK" and found:
        return next((v for k, v in _GREEK.items() if k in name.split()), own), ""
    if name.startswith(UNSPACED_SCRIPTS):
        return f" {own or format(ord(char), 'x')} ", ""
    if "VIRAMA" in name or "HALANT" in name or "AL-LAKUNA" in name:
        return "", "virama"
    if category in ("Mn", "Mc") and "VOWEL SIGN" in name:
        return own, "sign"
    if category[0] == "M" or category == "Cf":
        return "", ""
    if script in _INDIC and "LETTER" in name:
        return (own[:-1], "consonant") if own.endswith("a") and len(own) > 1 else (own, "")
    if script == "CYRILLIC" and len(own) > 1 and own[0] in "aeiou":
        own = own[1:] if own not in ("ie", "io", "yu", "ya", "i") else own[-1]
    return own, ""


def transliterate(text: str | None) -> str:
    """Lower-case ASCII; never fails. Null is the empty text."""
    if not text:
        return ""
    text = unicodedata.normalize("NFKC", text)
    if text.isascii():
        return text.lower()
    for symbol, plain in SYMBOLS.items():
        text = text.replace(symbol, plain)
    out: list[str] = []
    open_consonant = False
    for char in text:
        sound, kind = _sound(char)
        if open_consonant and kind not in ("sign", "virama"):
            out.append("a")
        open_consonant = kind == "consonant"
        out.append(sound)
    if open_consonant:
        out.append("a")
    return "".join(out).encode("ascii", "ignore").decode().lower()


def transliterated(text: Column) -> Column:
    """transliterate() of a column; each distinct text that is not plain ASCII is worked out once a batch. Null is empty."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        seen: dict[str, str] = {}
        out = []
        for text in texts:
            if text is None or text.isascii():
                out.append((text or "").lower())
            else:
                if text not in seen:
                    seen[text] = transliterate(text)
                out.append(seen[text])
        return pd.Series(out, dtype=object)

    return run(text)
