"""Language identification by rank-order profiles (Cavnar and Trenkle, 1994).

A text is lower-cased; its words are the runs of letters (a-z and, from U+00C0 on, everything but x and / signs and the
punctuation of U+2000-U+206F and U+3000-U+303F). Grams are the runs of 1 to 3 characters of each word set between two
spaces, but for the space alone. The `size` most frequent grams of a language's documents, in order of frequency (ties
in code point order), are its profile; the same of one text is the text's. The out-of-place distance sums, over the
text's grams, how far a gram's rank is from its rank in the language, or `size` where the language doesn't rank it.

Both passes read whole texts and all documents. Training sends one count per language and gram from each task; the
profiles (`size` rows a language, checked) are the only thing that all tasks get.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .common import DOC, id_kind, need, own_id

SIZE = 300
MOST_LANGUAGES = 5_000
_MERGE = 1 << 20
_NONE, _SPACE = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())


def symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, code point) of the texts as words between single spaces."""
    text = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    data, offsets = tk.utf8(pc.binary_join_element_wise(_NONE, text, _NONE, _SPACE))
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    lead = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    first = lead[offsets]
    letter = (points >= 97) & (points <= 122) | (points >= 0xC0) & (points != 0xD7) & (points != 0xF7)
    letter &= ~((points >= 0x2000) & (points <= 0x206F) | (points >= 0x3000) & (points <= 0x303F))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[first[:-1]] = True
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return row[keep], np.where(letter, points, 32)[keep]


class Grams:
    """Gram counts by group: group, code (order-preserving), count, and how to read the codes."""

    def __init__(self, group: np.ndarray, points: np.ndarray, n_groups: int):
        present = np.zeros(int(points.max(initial=0)) + 1, dtype=bool)
        present[points] = True
        self.alphabet = np.flatnonzero(present)
        table = np.cumsum(present)
        code = table[points].astype(np.int64)
        b = self.bits = int(len(self.alphabet)).bit_length()
        if 3 * b + int(n_groups).bit_length() > 63:
            raise OverflowError
        space = points == 32
        same = group[1:] == group[:-1]
        base = group.astype(np.int64) << (3 * b)
        one = (base | code << (2 * b))[~space]
        two = (base[:-1] | code[:-1] << (2 * b) | code[1:] << b)[same]
        ok = same[1:] & same[:-1] & ~space[1:-1]
        three = (base[:-2] | code[:-2] << (2 * b) | code[1:-1] << b | code[2:])[ok]
        keys = np.sort(np.concatenate([one, two, three]))
        start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        self.count = np.diff(np.append(start, len(keys)))
        keys = keys[start]
        self.group, self.code = keys >> (3 * b), keys & ((1 << 3 * b) - 1)

    def packed(self, code: np.ndarray) -> np.ndarray:
        """Codes as 21 bits for each code point, 0 where there is none; the order is that of the strings."""
        letters = np.append(0, self.alphabet)
        mask, out = (1 << self.bits) - 1, np.zeros(len(code), dtype=np.int64)
        for k in (2, 1, 0):
            out = out << 21 | letters[code >> (k * self.bits) & mask]
        return out

    def top(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, packed gram, rank from 0) of each group's most frequent grams."""
        most = int(self.count.max(initial=0))
        bits = most.bit_length()
        if bits + 3 * self.bits + int(self.group.max(initial=0)).bit_length() <= 63:
            keys = np.sort(self.group << (bits + 3 * self.bits) | (most - self.count) << (3 * self.bits) | self.code)
            group, code = keys >> (bits + 3 * self.bits), keys & ((1 << 3 * self.bits) - 1)
        else:
            order = np.lexsort((self.code, -self.count, self.group))
            group, code = self.group[order], self.code[order]
        rank = np.arange(len(group)) - np.searchsorted(group, group)
        held = rank < size
        return group[held], self.packed(code[held]), rank[held]


def _pieces(part: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batch, halved where its alphabet and rows are too many for one key."""
    row, points = symbols(part.column(part.schema.get_field_index("text")))
    distinct = len(np.unique(points))
    if part.num_rows > 1 and 3 * int(distinct).bit_length() + int(part.num_rows).bit_length() > 62:
        half = part.num_rows // 2
        yield from _pieces(part.slice(0, half))
        yield from _pieces(part.slice(half))
    else:
        yield part, row, points


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lang, gram, n = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((gram, lang))
    lang, gram, n = lang[order], gram[order], n[order]
    start = np.flatnonzero(np.append(True, (lang[1:] != lang[:-1]) | (gram[1:] != gram[:-1])))
    return lang[start], gram[start], np.add.reduceat(n, start)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names: dict[str, int] = {}
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for batch in batches:
        for whole in tk.chunks(batch, "text"):
            for part, row, points in _pieces(whole):
                langs = part.column(part.schema.get_field_index("lang")).dictionary_encode()
                own = np.array([names.setdefault(x, len(names)) for x in langs.dictionary.to_pylist()], dtype=np.int64)
                by = langs.indices.to_numpy(zero_copy_only=False)
                order = np.argsort(by[row], kind="stable")
                g = Grams(by[row][order], points[order], len(own))
                if len(g.code):
                    parts.append((own[g.group], g.packed(g.code), g.count))
        if sum(len(p[0]) for p in parts) > _MERGE:
            parts = [_merged(parts)]
    if parts:
        lang, gram, n = _merged(parts)
        listed = pa.DictionaryArray.from_arrays(pa.array(lang.astype(np.int32)), pa.array(list(names), pa.string())).cast(pa.string())
        out = pa.RecordBatch.from_arrays([listed, pa.array(gram), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])
        for at in range(0, out.num_rows, 1 << 16):
            yield out.slice(at, 1 << 16)


def train_profiles(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(lang, gram, place): the ranked grams of each language of docs (text, lang); gram holds 21 bits a code point, place starts at 0.

    Rows with a null text or lang don't count, repeated rows count each. Equal frequencies rank in code point order.
    """
    base = need(docs, ("text", "lang")).where("text is not null and lang is not null").select("text", F.col("lang").cast("string").alias("lang"))
    counted = base.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size).select("lang", "gram", (F.col("place") - 1).alias("place"))


def _guess(names: list[str], grams: np.ndarray, places: np.ndarray, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for whole in tk.chunks(batch, "text"):
                for part, row, points in _pieces(whole):
                    n = part.num_rows
                    doc, gram, rank = Grams(row, points, n).top(size)
                    at = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
                    there = grams[at] == gram
                    held = np.bincount(doc, minlength=n)
                    away = np.empty((len(names), n), dtype=np.int64)
                    for k in range(len(names)):
                        place = np.where(there, places[at, k], -1)
                        off = np.where(place < 0, size, np.abs(place - rank))
                        away[k] = np.bincount(doc, weights=off, minlength=n)
                    order = np.argsort(away, axis=0, kind="stable")  # names are sorted, so ties go to the first
                    best, none = order[0], held == 0
                    near = away[best, np.arange(n)]
                    second = order[min(1, len(names) - 1)]
                    margin = away[second, np.arange(n)] - near
                    label = lambda k, m: pa.DictionaryArray.from_arrays(pa.array(k.astype(np.int32), mask=m), pa.array(names)).cast(pa.string())
                    alone = none | (len(names) < 2)
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(part.schema.get_field_index(c)) for c in ("doc_id", "lang")), label(best, none), pa.array(near, mask=none), label(second, alone), pa.array(margin, mask=alone)],
                        ["doc_id", "lang", "predicted", "distance", "runner_up", "margin"],
                    )

    return run


def identify(docs: DataFrame, profiles: DataFrame, size: int = SIZE) -> DataFrame:
    """A row for each row of docs (doc_id, text, lang) with a doc_id: doc_id, lang, predicted, distance, runner_up, margin.

    predicted has the least out-of-place distance, the first by name on a tie; margin is how much further runner_up is (null with one profile).
    Null and wordless texts have nulls, as all have if there are no profiles. Repeated rows have a row each. docs may lack lang; it plays no part.
    """
    rows = profiles.collect()  # size rows a language
    names = sorted({r["lang"] for r in rows})
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"{len(names)} languages; lang should hold language codes")
    has = "lang" in docs.columns
    base = need(docs, [*DOC, "lang"] if has else DOC).where("doc_id is not null")
    base = base.select(own_id(docs), "text", (F.col("lang").cast("string") if has else F.lit(None).cast("string")).alias("lang"))
    if not names:
        none = F.lit(None)
        return base.select("doc_id", "lang", none.cast("string").alias("predicted"), none.cast("long").alias("distance"), none.cast("string").alias("runner_up"), none.cast("long").alias("margin"))
    grams = np.array(sorted({r["gram"] for r in rows}), dtype=np.int64)
    places = np.full((len(grams), len(names)), -1, dtype=np.int64)
    for r in rows:
        places[np.searchsorted(grams, r["gram"]), names.index(r["lang"])] = r["place"]
    return base.mapInArrow(_guess(names, grams, places, size), f"doc_id {id_kind(docs)}, lang string, predicted string, distance long, runner_up string, margin long")


SQL = r"""
with t as (
  select row_number() over () as rid, doc_id, lang, trim(regexp_replace(lower(text), '[^a-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{1FFF}\x{2070}-\x{2FFF}\x{3040}-\x{10FFFF}]+', ' ', 'g')) as s from documents where doc_id is not null),
w as (select rid, word, count(*) as c from (select rid, unnest(string_split(s, ' ')) as word from t where s <> '') group by all),
p as (select word, ' ' || word || ' ' as x, length(word) + 2 as len from (select distinct word from w)),
g as (
  select word, substr(x, i, 1) as gram from p, range(2, p.len) r(i) union all
  select word, substr(x, i, 2) from p, range(1, p.len) r(i) union all
  select word, substr(x, i, 3) from p, range(1, p.len - 1) r(i)),
d as (select rid, gram, sum(c)::bigint as n from w join g using (word) group by all),
l as (select lang, gram, row_number() over (partition by lang order by n desc, gram) - 1 as place from (select lang, gram, sum(n) as n from d join t using (rid) where lang is not null group by all) qualify place < 300),
k as (select rid, gram, row_number() over (partition by rid order by n desc, gram) - 1 as rank from d qualify rank < 300),
a as (select rid, name, sum(coalesce(abs(place - rank), 300))::bigint as away from k cross join (select distinct lang as name from l) n left join l on l.lang = n.name and l.gram = k.gram group by all),
o as (select *, row_number() over (partition by rid order by away, name) as o from a)
select t.doc_id, t.lang, b.name as predicted, b.away as distance, c.name as runner_up, c.away - b.away as margin
from t left join o b on b.rid = t.rid and b.o = 1 left join o c on c.rid = t.rid and c.o = 2
"""
