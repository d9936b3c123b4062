"""Text in the form in which it is compared: repaired, without markup, case, accents and punctuation."""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np

#: Tags, comments and declarations of any length; a sign before anything but a letter is a sign.
_TAG = re.compile(r"<(?:/?[A-Za-z]|[!?])[^<>]*>")
_NOT_ASCII = re.compile(r"[^\x00-\x7f]+")
_INVISIBLE = re.compile("[­​-‏‪-‮⁠-⁤﻿]")
_ACCENT = re.compile("[̀-ͯ]")
_WORD = re.compile(r"[^\W_]+")
_LETTERS = re.compile(r"[^\W\d_]+")
#: Kana, CJK ideographs with their iteration and length marks.
_CJK = re.compile("[々-〇ぁ-ヿ㐀-䶿一-鿿豈-﫿]")


def _bytes_of(c: str) -> bytes:
    try:
        return c.encode("cp1252")
    except UnicodeEncodeError:
        return c.encode("latin-1")


def repair(text: str) -> str:
    """Undo UTF-8 that was read as a Western single-byte encoding, run by run; other text stays as it is."""

    def fix(m: re.Match) -> str:
        try:
            return b"".join(map(_bytes_of, m[0])).decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            return m[0]

    return _NOT_ASCII.sub(fix, text)


def plain(text: str | None) -> str:
    """Lower case without markup, entities, invisible characters, accents and compatibility forms; null is empty."""
    if not text:
        return ""
    if not text.isascii():
        text = repair(text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    text = text.casefold()
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).casefold()
        text = unicodedata.normalize("NFC", _ACCENT.sub("", unicodedata.normalize("NFD", text)))
    return text


def words(text: str) -> list[str]:
    """Runs of letters and digits of a :func:`plain` text."""
    return _WORD.findall(text)


def is_cjk(text: str) -> bool:
    """Whether more than half of the letters are kana or ideographs, so that words have no spaces between them."""
    n = len(_CJK.findall(text))
    return n > 0 and 2 * n > sum(map(len, _LETTERS.findall(text)))


def has_cjk(text: str) -> bool:
    return _CJK.search(text) is not None


def letter_units(text: str) -> tuple[list[str], bool]:
    """Words of letters only, or the letters themselves for CJK text, and which of the two."""
    found = _LETTERS.findall(text)
    if is_cjk(text):
        return list("".join(found)), True
    return found, False


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_hashes(units: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` unit hashes."""
    n = len(units) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for i in range(width):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + units[i : i + n])
    return h
