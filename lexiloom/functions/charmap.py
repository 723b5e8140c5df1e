"""Character classes and the normalisation table, as constants for expressions and as lookup arrays for kernels.

Types follow Unicode general categories: white space is EMPTY; controls and punctuation are POS; symbols beyond
ASCII are SYMBOLS; ASCII and Latin letters are ENG; decimal digits are NUM; ideographs are CJK; all else is WUNK.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TYPES = ("EMPTY", "POS", "SYMBOLS", "ENG", "NUM", "CJK", "WUNK")
EMPTY, POS, SYMBOLS, ENG, NUM, CJK, WUNK = range(7)
SPACES = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
IDEOGRAPHS = "3005 3007 303B 3400-4DBF 4E00-9FFF F900-FAFF 20000-2A6DF 2A700-2EE5F 2F800-2FA1F 30000-3347F"
TOP = 0x110000
_LEFT, _RIGHT = "『〖【「❬❮❰〘〚〔", "】〗』」❭❯❱〙〛〉〕"


def _spans(listed: str) -> list[tuple[int, int]]:
    ends = [x.split("-") for x in listed.split()]
    return [(int(e[0], 16), int(e[-1], 16)) for e in ends]


@cache
def table() -> np.ndarray:
    """The type of each code point."""
    out = np.full(TOP, WUNK, dtype=np.uint8)
    for code in range(TOP):
        kind = unicodedata.category(chr(code))
        if kind[0] == "P" or kind in ("Cc", "Cf", "Co", "Cs"):
            out[code] = POS
        elif kind[0] == "S":
            out[code] = SYMBOLS if code > 127 else POS
        elif kind == "Nd":
            out[code] = NUM
        elif kind[0] in "LM" and "LATIN" in unicodedata.name(chr(code), ""):
            out[code] = ENG
    for low, high in _spans(IDEOGRAPHS):
        out[low : high + 1] = CJK
    out[list(SPACES)] = EMPTY
    return out


@cache
def char_class(kind: int) -> str:
    """The inside of a regular expression's brackets for a type, in a form that Java and RE2 read alike."""
    hit = np.concatenate([[False], table() == kind, [False]])
    hit[0xD800 + 1 : 0xE000 + 1] = False  # surrogates aren't characters
    start, end = np.flatnonzero(hit[1:] & ~hit[:-1]), np.flatnonzero(hit[:-1] & ~hit[1:]) - 1
    return "".join(rf"\x{{{a:X}}}" if a == b else rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in zip(start, end))


@cache
def atom_pattern() -> str:
    """Runs of one type, but ideographs and punctuation one by one; white space is a run too."""
    c = char_class
    rest = "".join(c(k) for k in (EMPTY, POS, SYMBOLS, ENG, NUM, CJK))
    return rf"[{c(CJK)}{c(POS)}]|[{c(ENG)}]+|[{c(NUM)}]+|[{c(EMPTY)}]+|[{c(SYMBOLS)}]+|[^{rest}]+"


@cache
def normal_map(confusables: tuple[tuple[str, str], ...] = ()) -> dict[str, str]:
    """What each character becomes; the tab becomes four spaces, line breaks and spaces are never mapped."""
    blank = [*range(0x21), 0x7F, *range(0x2006, 0x2010), *range(0x2028, 0x2030), *range(0x205F, 0x2070), *range(0xFE00, 0xFE10), 0x3000]
    out = dict(confusables) | {chr(c): " " for c in blank} | {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    for goal, sources in (('"', "“”"), (",", "、"), ("~", "〜～"), ("-", "－–"), ("\n", "\r"), ("|", "︳▎丨│︱｜"), ("i", "ⅰ"), ("/", "／"), ("《", _LEFT), ("》", _RIGHT)):
        out |= dict.fromkeys(sources, goal)
    out = {k: v for k, v in out.items() if k != v and k not in "\n "} | {"\t": " " * 4}
    return {k: out.get(v, v) for k, v in out.items()}


def translation() -> tuple[str, str]:
    """The one-to-one part of `normal_map` as arguments for translate."""
    pairs = sorted((k, v) for k, v in normal_map().items() if k != "\t" and k != "\0")
    return "".join(k for k, _ in pairs), "".join(v for _, v in pairs)


def normalize(text: Column) -> Column:
    """Text with every character replaced as `normal_map` says."""
    source, goal = translation()
    return F.replace(F.translate(text, source, goal), F.lit("\t"), F.lit(" " * 4))


def char_type(char: Column) -> Column:
    """The type of the first character; null for an empty string."""
    out = F.when(F.length(char) == 0, None)
    for kind in (EMPTY, POS, SYMBOLS, ENG, NUM, CJK):
        out = out.when(char.rlike(f"^[{char_class(kind)}]"), TYPES[kind])
    return out.otherwise(TYPES[WUNK])


def type_of_atom(image: Column) -> Column:
    """The type of an atom, all of whose characters share it."""
    return char_type(image)
