"""Atoms and sentences as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .charmap import CJK, EMPTY, ENG, NUM, POS, SYMBOLS, atom_pattern, char_class

_WORD = r"[a-zA-Z]+(?:['._-][0-9a-zA-Z]+)*"
_NUMBER = r"[0-9]+(?:[%/:.-][0-9]+)*"
CORPUS_ATOM = rf"{_WORD}|{_NUMBER}|[^{char_class(EMPTY)}]"
ENDS, BREAKS, MARKS = "!?;。！？；", ",:、，：", "!,?;:。！，？；："
FOLD = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SQUEEZE = r"[\t\r\f\x{0B} ]+"


def atom_runs(text: Column) -> Column:
    """Every atom in order, white space runs among them; joined they give the text."""
    return F.regexp_extract_all(text, F.lit(atom_pattern()), F.lit(0))


def atoms(text: Column) -> Column:
    """The atoms without white space."""
    space = f"^[{char_class(EMPTY)}]"
    return F.filter(atom_runs(text), lambda a: ~a.rlike(space))


def atom_count(text: Column) -> Column:
    return F.size(atoms(text))


def corpus_atoms(text: Column) -> Column:
    """The atoms of the corpus tools: words with inner marks, digit groups with inner marks, single characters."""
    return F.regexp_extract_all(text, F.lit(CORPUS_ATOM), F.lit(0))


def corpus_atom_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(CORPUS_ATOM))


def fold(text: Column) -> Column:
    """ASCII capitals in lower case; other letters stay."""
    return F.translate(text, *FOLD)


def squeeze(text: Column) -> Column:
    """Runs of blanks other than line breaks become one space; neither stays at the ends."""
    return F.trim(F.regexp_replace(text, SQUEEZE, " "), F.lit(" \n"))


def sentences(text: Column) -> Column:
    """Pieces after sentence ends and at line breaks, trimmed, without empty ones."""
    marked = F.regexp_replace(squeeze(text), f"([{ENDS}])", "$1\n")
    return F.filter(F.transform(F.split(marked, "\n+"), lambda x: F.trim(x)), lambda s: s != "")


def join_atoms(parts: Column) -> Column:
    return F.array_join(parts, "")


def number_pieces(digits: Column) -> Column:
    """Groups of three digits from the right, in reading order."""
    return F.reverse(F.transform(F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]{1,3}"), F.lit(0)), F.reverse))


def clean_markup(html: Column) -> Column:
    """Visible paragraphs of a marked-up page: script, style and comments go, block ends part paragraphs, blanks are squeezed."""
    text = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", "")
    text = F.regexp_replace(text, r"(?i)</?(p|div|li|ul|h[1-6]|br|article|nav|footer|title|head|body)[^>]*>", "\n\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    parts = F.transform(F.split(text, "\n{2,}"), lambda p: squeeze(F.replace(p, F.lit("\n"), F.lit(" "))))
    return F.filter(parts, lambda p: (p != "") & ~p.rlike(r"(?i)^(分类|图像|文件|category|file|image|template):"))


NESTED = 6
"""How deep templates and tables of wiki text are followed into each other."""


def clean_wikitext(text: Column) -> Column:
    """Visible paragraphs of wiki markup: comments, references, templates, tables, files and categories go; links and headings leave their text; see `clean_markup` for the rest."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)<!--.*?-->|<ref[^>/]*/>|<ref[^>]*>.*?</ref>|<(math|gallery|nowiki|timeline|source|syntaxhighlight)[^>]*>.*?</\1>", "")
    for _ in range(NESTED):
        out = F.regexp_replace(out, r"\{\{[^{}]*\}\}", "")
    for _ in range(NESTED // 2):
        out = F.regexp_replace(out, r"(?s)\{\|(?:(?!\{\||\|\}).)*\|\}", "")
    for _ in range(NESTED // 2):
        out = F.regexp_replace(out, r"(?i)\[\[\s*(?:file|image|category|文件|图像|分类)\s*:(?:[^\[\]]|\[\[[^\[\]]*\]\])*\]\]", "")
    out = F.regexp_replace(out, r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", "$1")
    out = F.regexp_replace(out, r"\[[a-z]+://[^\s\]]+\s*([^\]]*)\]", "$1")
    out = F.regexp_replace(out, r"(?m)^(=+)\s*(.*?)\s*\1[ \t]*$", "$2")
    out = F.regexp_replace(out, "'{2,}|__[A-Z]+__", "")
    out = F.regexp_replace(out, r"(?m)^[*#:;]+[ \t]*", "")
    return clean_markup(out)


def at(values: Column, place: int) -> Column:
    """The element at a place from 0; beyond the ends it's an error."""
    return F.element_at(values, F.when(F.lit(place) < F.size(values), place + 1).otherwise(F.raise_error(F.lit(f"no atom {place}")).cast("int"))) if place >= 0 else F.element_at(values, place)


def joined(images: Column, start: Column, end: Column) -> Column:
    """The atoms from start to end as one word; '' for a span that isn't within them."""
    good = (start >= 0) & (start < end) & (end <= F.size(images))
    return F.when(good, F.array_join(F.slice(images, start + 1, F.greatest(end - start, F.lit(0))), "")).otherwise("")


def masked(images: Column, places: Column) -> Column:
    """Booleans: which atoms are among the places; they change codes only."""
    return F.transform(images, lambda x, i: F.array_contains(places, i))


def runs_with_space(text: Column) -> Column:
    """Atoms with white space kept, where a run of white space joins punctuation next to it, nothing being lost."""
    pos, space = char_class(POS), char_class(EMPTY)
    rest = "".join(char_class(k) for k in (EMPTY, POS, SYMBOLS, ENG, NUM, CJK))
    pattern = rf"[{char_class(CJK)}]|[{pos}{space}]*[{pos}][{pos}{space}]*|[{char_class(ENG)}]+|[{char_class(NUM)}]+|[{space}]+|[{char_class(SYMBOLS)}]+|[^{rest}]+"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
