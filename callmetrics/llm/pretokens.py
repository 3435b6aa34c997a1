"""Texts to the pieces that a word-level BPE vocabulary merges within.

NFC, every run of white space as one space, lower case letter by letter, then
contractions, runs of letters, single digits and runs of other signs. The vocabulary's
library carries three Unicode tables of different ages; what they say otherwise than
Python's is pinned below, so that every code point is treated as the library treats it.
"""

from __future__ import annotations

import re
import unicodedata

# How the library's tables differ from Unicode 15.1, by inclusive ranges of code points.
#: Letters and numbers that its pattern engine knows beside those of 15.1.
NEWER_LETTERS = (
    "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 "
    "11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF 1E5D0-1E5ED 1E5F0"
)
NEWER_NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"
#: Capitals that it lower-cases beside those of 15.1: from each range to the letters that begin where the second part says.
NEWER_CAPITALS = "1C89>1C8A A7CB>0264 A7CC>A7CD A7CE>A7CF A7D2>A7D3 A7D4>A7D5 A7DA>A7DB A7DC>019B 10D50-10D65>10D70 16EA0-16EB8>16EBB"
#: Signs that its normal form takes for starters that nothing composes with: marks of later
#: versions, which it does not reorder, and the second part of U+11938.
UNORDERED = (
    "07FD 0898-089F 08CA-08D3 09FE 0C3C 0D3B-0D3C 0EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50 10F82-10F85 "
    "11070 1133B 1145E 11839-1183A 11930 1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42 16FF0-16FF1 1E08F 1E130-1E136 "
    "1E2AE 1E2EC-1E2EF 1E4EC-1E4EF"
)

#: What stands for a letter, a number, white space and any other sign beyond ASCII.
_LETTER, _NUMBER, _SPACE, _OTHER = "\u00aa", "\u00b2", " ", "\u00a7"
_SPACES = frozenset((0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, *range(0x2000, 0x200B)))


def _ranges(stated: str) -> list[tuple[int, int]]:
    pairs = (part.split("-") for part in stated.split())
    return [(int(p[0], 16), int(p[-1], 16)) for p in pairs]


_LATE = {c: kind for stated, kind in ((NEWER_LETTERS, _LETTER), (NEWER_NUMBERS, _NUMBER)) for a, b in _ranges(stated) for c in range(a, b + 1)}
_LOWER = {
    c: int(to, 16) + c - a for part in NEWER_CAPITALS.split() for source, to in (part.split(">"),) for a, b in _ranges(source) for c in range(a, b + 1)
} | {0x3A3: 0x3C3}  # and the capital sigma, which str.lower() looks at in its word
_CAPITALS = re.compile("[" + "".join(map(chr, _LOWER)) + "]")
_APART = re.compile("([" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _ranges(UNORDERED)) + "])")


class _Kinds(dict):
    """By code point: itself within ASCII, else the sign that stands for its kind."""

    def __missing__(self, code: int) -> str:
        if code in _LATE:
            kind = _LATE[code]
        elif code in _SPACES:
            kind = _SPACE
        else:
            kind = {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(code))[0], _OTHER)
        self[code] = kind
        return kind


_KINDS = _Kinds({code: chr(code) for code in range(128)})
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_PIECES = re.compile(rf"{_CONTRACTIONS}|[a-zA-Z{_LETTER}]+|[0-9{_NUMBER}]|[^ \t-\r{_SPACE}a-zA-Z{_LETTER}0-9{_NUMBER}]+")
#: Separators that str.split() takes for white space though the library does not.
_FALSE_SPACES = re.compile("[\x1c-\x1f]")
_SPLIT = re.compile("[ \t-\r" + "".join(map(chr, sorted(_SPACES))) + "]+")


def composed(text: str) -> str:
    """NFC as the library makes it."""
    if _APART.search(text) is None:
        return unicodedata.normalize("NFC", text)
    return "".join([unicodedata.normalize("NFC", part) for part in _APART.split(text)])


def lowered(text: str) -> str:
    if _CAPITALS.search(text) is not None:
        text = text.translate(_LOWER)
    return text.lower()


def words(text: str) -> list[str]:
    """The strings between white space, composed and in lower case."""
    text = text.lower() if text.isascii() else lowered(composed(text))
    return [w for w in _SPLIT.split(text) if w] if _FALSE_SPACES.search(text) else text.split()


def pieces(word: str) -> list[str]:
    """The pieces of one of words(), which merges never cross."""
    if word.isascii():
        return _PIECES.findall(word)
    return [word[m.start() : m.end()] for m in _PIECES.finditer(word.translate(_KINDS))]
