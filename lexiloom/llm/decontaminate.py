"""Benchmark decontamination over a distributed positional inverted index.

The index is a written table of segments. A segment holds the postings of about SEGMENT_BYTES of training text: its
terms in hash order, each with its number of documents and its list of (document, position), so that an index is as
distributed as the text it was built from, a hot term is never gathered in one place, and a search moves no postings.

A search first counts, over all segments, in how many documents each test term occurs. In each segment it then takes
the windows of `phrase` consecutive terms of each item all of whose terms the segment holds, and intersects their
lists, each list's positions less the term's offset in the item, from the rarest term on, until the intersection is
empty or all are in. What remains are exact phrase matches; windows that follow each other on a diagonal join into one
match. An item shorter than `phrase` is one window. For proximity, the lists of the item's `key_terms` rarest terms are
merged, and a document matches if at least `near_share` of them lie within `slack` times the item's length.

The rarest terms of an edited passage may be just those that no document holds. So other documents match as edited if
`near_share` of all the item's distinct terms lie that close. Such a document lacks few of them, so it holds one of the
rarest few; only documents in those lists are looked up in the longer ones, and leave when they lack too many.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..plans.storage import lookup_join, materialize, scratch
from . import textkit as tk
from .common import id_kind, need, own_id, texts

PHRASE, KEY_TERMS, NEAR_SHARE, SLACK, LEAST_TERMS = 10, 8, 0.75, 2.0, 4
ITEM_BYTES = 64_000_000
"""Test items that every task gets at once; a larger benchmark is searched in blocks, each with an index of its own."""
VOCABULARY_ROWS = 2_000_000
"""Test vocabularies up to this size restrict the index to their terms; beyond it the index holds every term."""
SEGMENT_BYTES = 1 << 20
_SEGMENT = "terms array<long>, doc_freq array<int>, ends array<int>, docs array<int>, positions array<int>"


def _segments(vocabulary: np.ndarray | None, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.chunks(batch, "text", SEGMENT_BYTES):
                w = tk.words(part.column("text"))
                first = np.searchsorted(w.doc, np.arange(part.num_rows))
                position = np.arange(len(w.doc)) - first[w.doc] if len(w.doc) else np.zeros(0, np.int64)
                term, doc = w.hash.view(np.int64), w.doc
                if vocabulary is not None and len(vocabulary):
                    at = np.minimum(np.searchsorted(vocabulary, term), len(vocabulary) - 1)
                    held = vocabulary[at] == term
                    term, doc, position = term[held], doc[held], position[held]
                order = np.argsort(term, kind="stable")
                term, doc, position = term[order], doc[order], position[order]
                new = np.ones(len(term), dtype=bool)
                new[1:] = term[1:] != term[:-1]
                new_doc = new.copy()
                new_doc[1:] |= doc[1:] != doc[:-1]
                start = np.flatnonzero(new)
                ends = np.append(start[1:], len(term)) if len(start) else start
                count = np.add.reduceat(new_doc.astype(np.int32), start) if len(start) else np.zeros(0, np.int32)
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("doc_id").cast(kind))
                one = lambda v, of: pa.array([v], type=pa.list_(of))
                yield pa.RecordBatch.from_arrays(
                    [ids, one(term[start], pa.int64()), one(count, pa.int32()), one(ends.astype(np.int32), pa.int32()), one(doc.astype(np.int32), pa.int32()), one(position.astype(np.int32), pa.int32())],
                    ["doc_ids", "terms", "doc_freq", "ends", "docs", "positions"],
                )

    return run


def build_index(docs: DataFrame, vocabulary: np.ndarray | None = None) -> DataFrame:
    """The written segments of docs (doc_id, text). vocabulary: sorted int64 term hashes, to hold only these terms."""
    base = texts(docs)
    kind = to_arrow_type(base.schema["doc_id"].dataType)
    return materialize(base.mapInArrow(_segments(vocabulary, kind), f"doc_ids array<{id_kind(docs)}>, {_SEGMENT}"), "positional-index")


class Item:
    """A test item: its term hashes, and for a search their document counts and order of rarity."""

    def __init__(self, item_id, terms: np.ndarray):
        self.item_id, self.terms = item_id, terms

    def rank(self, counts: dict[int, int], key_terms: int) -> None:
        self.count = np.array([counts.get(int(t), 0) for t in self.terms])
        order = sorted({int(t) for t in self.terms}, key=lambda t: (counts.get(t, 0), t))
        self.ranked = np.array(order, dtype=np.int64)
        self.keys = self.ranked[:key_terms]


def _items(benchmark: DataFrame) -> list[Item]:
    """A block of test items, of bounded size, on the driver."""
    rows = benchmark.orderBy("item_id", "text").toArrow()
    w = tk.words(rows.column("text"))
    edges = np.searchsorted(w.doc, np.arange(rows.num_rows + 1))
    ids = rows.column("item_id").to_pylist()
    return [Item(i, w.hash[a:b].view(np.int64)) for i, a, b in zip(ids, edges, edges[1:]) if b > a]


class Targets:
    """All items' terms end to end, so that one look at a segment tells which items can match there at all."""

    def __init__(self, items: list[Item], phrase: int, near_share: float, least_terms: int):
        self.terms = np.concatenate([i.terms for i in items])
        first = np.concatenate([[0], np.cumsum([len(i.terms) for i in items])])
        sizes = [min(phrase, len(i.terms)) for i in items]
        self.start = np.concatenate([f + np.arange(len(i.terms) - s + 1) for f, i, s in zip(first, items, sizes)])
        self.owner = np.repeat(np.arange(len(items)), [len(i.terms) - s + 1 for i, s in zip(items, sizes)])
        self.stop = self.start + np.array(sizes)[self.owner]
        self.keys = np.concatenate([i.keys for i in items])
        self.key_first = np.concatenate([[0], np.cumsum([len(i.keys) for i in items])])[:-1]
        self.ranked = np.concatenate([i.ranked for i in items])
        self.ranked_first = np.concatenate([[0], np.cumsum([len(i.ranked) for i in items])])[:-1]
        self.share = np.array([math.ceil(near_share * len(i.ranked)) if len(i.ranked) > max(len(i.keys), least_terms - 1) else len(i.ranked) + 1 for i in items])
        self.needed = np.array([math.ceil(near_share * len(i.keys)) if len(i.keys) >= least_terms else len(i.keys) + 1 for i in items])

    def phrases(self, terms: np.ndarray) -> list[int]:
        """Items of which the segment holds all terms of some window."""
        missing = np.concatenate([[0], np.cumsum(_places(self.terms, terms) < 0)])
        return np.unique(self.owner[missing[self.stop] == missing[self.start]]).tolist()

    def near(self, terms: np.ndarray) -> list[int]:
        """Items of which the segment holds enough key terms."""
        return np.flatnonzero(np.add.reduceat((_places(self.keys, terms) >= 0).astype(np.int64), self.key_first) >= self.needed).tolist()

    def edited(self, terms: np.ndarray) -> list[int]:
        """Items with more than the key terms of which the segment holds enough of all terms."""
        return np.flatnonzero(np.add.reduceat((_places(self.ranked, terms) >= 0).astype(np.int64), self.ranked_first) >= self.share).tolist()


def _search(items: list[Item], schema: pa.Schema, phrase: int, near_share: float, slack: float, least_terms: int):
    targets = Targets(items, phrase, near_share, least_terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for s in range(batch.num_rows):
                ids = batch.column(batch.schema.get_field_index("doc_ids"))[s].values.to_pylist()
                terms, ends, docs, positions = (batch.column(batch.schema.get_field_index(c))[s].values.to_numpy(zero_copy_only=False) for c in ("terms", "ends", "docs", "positions"))
                if len(terms):
                    starts = np.append(0, ends[:-1])
                    keys = docs.astype(np.int64) << 32 | positions
                    for i in targets.phrases(terms):
                        out += _phrases(items[i], ids, terms, starts, ends, keys, phrase)
                    near: dict[int, list] = {}
                    edited: dict[int, list] = {}
                    for i in targets.near(terms):
                        near[i] = _near(items[i], terms, starts, ends, docs, positions, near_share, slack, least_terms)
                    for i in targets.edited(terms):
                        done = [m[0] for m in near.get(i, [])]
                        edited[i] = _edited(items[i], len(ids), terms, starts, ends, docs, positions, near_share, slack, done)
                    for kind, found in (("proximity", near), ("edited", edited)):
                        out += [(ids[d], items[i].item_id, kind, at, None, n, len(items[i].terms)) for i, ms in found.items() for d, at, n in ms]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=schema)

    return run


_MATCH = "kind string, doc_start long, item_start long, n_terms long, item_terms long"


def _places(wanted: np.ndarray, terms: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
    return np.where(terms[at] == wanted, at, -1)


def _phrases(item: Item, ids, terms, starts, ends, keys, phrase: int) -> list[tuple]:
    n = len(item.terms)
    size = min(phrase, n)
    place = _places(item.terms, terms)
    missing = np.concatenate([[0], np.cumsum(place < 0)])
    windows = np.flatnonzero(missing[size:] == missing[: n - size + 1])
    if not len(windows):
        return []
    diagonals: dict[int, np.ndarray] = {}  # by offset: keys less the offset, in order; below 0 at a document's start
    hits: dict[int, list[int]] = {}
    for j in windows.tolist():
        left = None
        for k in sorted(range(j, j + size), key=lambda k: (item.count[k], item.terms[k])):
            if k not in diagonals:
                diagonals[k] = keys[starts[place[k]] : ends[place[k]]] - k
            other = diagonals[k]
            if left is None:
                left = other
            else:
                at = np.minimum(np.searchsorted(other, left), len(other) - 1)
                left = left[other[at] == left]
            if not len(left):
                break
        for d in left.tolist():
            hits.setdefault(d, []).append(j)
    out = []
    for d, js in hits.items():
        run = [js[0], js[0]]
        for j in js[1:] + [None]:
            if j is not None and j == run[1] + 1:
                run[1] = j
                continue
            first = d + run[0]  # the key of the match's first word
            out.append((ids[first >> 32], item.item_id, "phrase", first & 0xFFFFFFFF, run[0], run[1] - run[0] + size, n))
            run = [j, j]
    return out


def _near(item: Item, terms, starts, ends, docs, positions, share: float, slack: float, least: int) -> list[tuple]:
    """(document, position, key terms there)."""
    keys = item.keys
    needed = math.ceil(share * len(keys))
    place = _places(keys, terms)
    if len(keys) < least or (place >= 0).sum() < needed:
        return []
    held = [(k, slice(starts[p], ends[p])) for k, p in enumerate(place.tolist()) if p >= 0]
    per_doc = np.bincount(np.concatenate([np.unique(docs[s]) for _, s in held]), minlength=int(docs.max()) + 1)
    chosen = per_doc >= needed
    if not chosen.any():
        return []
    doc, pos, key = [], [], []
    for k, s in held:
        pick = chosen[docs[s]]
        doc.append(docs[s][pick])
        pos.append(positions[s][pick])
        key.append(np.full(int(pick.sum()), k))
    doc, pos, key = np.concatenate(doc), np.concatenate(pos), np.concatenate(key)
    return _windows(doc, pos, key, len(keys), int(slack * len(item.terms)), needed)


def _edited(item: Item, n_docs: int, terms, starts, ends, docs, positions, share: float, slack: float, done: list[int]) -> list[tuple]:
    """(document, position, distinct terms there) of documents that aren't done."""
    needed = math.ceil(share * len(item.ranked))
    spare = len(item.ranked) - needed
    lists = [(k, docs[starts[p] : ends[p]], positions[starts[p] : ends[p]]) if p >= 0 else (k, docs[:0], positions[:0]) for k, p in enumerate(_places(item.ranked, terms).tolist())]
    count = np.zeros(n_docs, dtype=np.int64)
    for _, d, _ in lists[: spare + 1]:
        count[d[np.append(True, d[1:] != d[:-1])[: len(d)]]] += 1
    count[done] = 0
    left = np.flatnonzero(count)
    for k, d, _ in lists[spare + 1 :]:
        if not len(left):
            return []
        if len(d):
            count[left[d[np.minimum(np.searchsorted(d, left), len(d) - 1)] == left]] += 1
        left = left[count[left] >= k + 1 - spare]
    if not len(left):
        return []
    doc, pos, key = [], [], []
    for k, d, p in lists:
        for x, a, b in zip(left.tolist(), np.searchsorted(d, left), np.searchsorted(d, left, side="right")):
            doc.append(np.full(b - a, x))
            pos.append(p[a:b])
            key.append(np.full(b - a, k))
    return _windows(np.concatenate(doc), np.concatenate(pos), np.concatenate(key), len(lists), int(slack * len(item.terms)), needed)


def _windows(doc: np.ndarray, pos: np.ndarray, key: np.ndarray, n_keys: int, width: int, needed: int) -> list[tuple]:
    """(document, position, terms) of the earliest of the best places of `width` words, where that has `needed` distinct terms."""
    order = np.lexsort((key, pos, doc))
    doc, pos, key = doc[order], pos[order], key[order]
    out = []
    edges = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    for a, b in zip(edges, np.append(edges[1:], len(doc))):
        p, q = pos[a:b].tolist(), key[a:b].tolist()
        counts, distinct, right, best = [0] * n_keys, 0, 0, (0, 0)
        for left in range(len(p)):
            while right < len(p) and p[right] < p[left] + width:
                distinct += counts[q[right]] == 0
                counts[q[right]] += 1
                right += 1
            if distinct > best[0]:
                best = (distinct, p[left])
            counts[q[left]] -= 1
            distinct -= counts[q[left]] == 0
        if best[0] >= needed:
            out.append((int(doc[a]), best[1], best[0]))
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, phrase: int = PHRASE, key_terms: int = KEY_TERMS, near_share: float = NEAR_SHARE, slack: float = SLACK, least_terms: int = LEAST_TERMS) -> DataFrame:
    """Matches of test items in docs: doc_id, item_id, kind, doc_start, item_start, n_terms, item_terms.

    kind 'phrase': words doc_start.. of the document equal words item_start.. of the item, n_terms of them, and no
    more on either side; each such maximal run of at least min(phrase, item_terms) words is a row. kind 'proximity': n_terms of the item's
    rarest distinct terms lie within slack * item_terms words from doc_start on (the earliest of the best
    such places); item_start is null; one row for a document and item; items of fewer than least_terms distinct terms have none.
    kind 'edited': the same, of all the item's distinct terms, for documents without a 'proximity' row; items of up to key_terms have none.

    Terms are compared in lower case, without punctuation. Rows with a null id or text, and texts without words, match
    nothing; an item without words matches nothing. Ties in rarity go to the lesser term hash. Repeated documents are
    matched each and reported once, as are repeated items; other columns are ignored; empty tables give no rows.
    Ids are as in `common.id_kind`. The corpus is indexed once, also for a benchmark that is searched in blocks.
    """
    tests = need(benchmark, ("item_id", "text")).where("item_id is not null and text is not null").select(own_id(benchmark, "item_id"), "text")
    with scratch(docs.sparkSession):
        tests = materialize(tests.distinct(), "leak-items")
        size = tests.agg(F.sum(F.octet_length("text") + 1).alias("n")).first()["n"] or 0
        schema = f"doc_id {id_kind(docs)}, item_id {id_kind(benchmark, 'item_id')}, {_MATCH}"
        blocks = math.ceil(size / ITEM_BYTES)
        if not blocks:
            return docs.sparkSession.createDataFrame([], schema)
        part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
        first = _items(tests) if blocks == 1 else []
        vocabulary = np.unique(np.concatenate([i.terms for i in first])) if first else np.zeros(0, np.int64)
        if blocks == 1 and not first:
            return docs.sparkSession.createDataFrame([], schema)
        index = build_index(docs, vocabulary if 0 < len(vocabulary) <= VOCABULARY_ROWS else None)
        found = []
        for k in range(blocks):
            items = first if blocks == 1 else _items(tests.where(part == k))
            if not items:
                continue
            _rank(items, index, key_terms)
            arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in docs.sparkSession.createDataFrame([], schema).schema.fields])
            found.append(materialize(index.mapInArrow(_search(items, arrow, phrase, near_share, slack, least_terms), schema), "leaks"))
        every = reduce(DataFrame.union, found) if found else docs.sparkSession.createDataFrame([], schema)
        return materialize(every.distinct(), "leaks", keep=True)


def _rank(items: list[Item], index: DataFrame, key_terms: int) -> None:
    """Gives each item the document counts of its terms; at most the terms of a block come to the driver."""
    terms = np.unique(np.concatenate([i.terms for i in items]))
    spark = index.sparkSession
    counted = index.select(F.inline(F.arrays_zip("terms", "doc_freq"))).groupBy("terms").agg(F.sum("doc_freq").alias("n"))
    asked = materialize(spark.createDataFrame(pa.table({"term": terms})), "leak-terms")
    counts = {r.terms: r.n for r in lookup_join(counted, asked.withColumnRenamed("term", "terms"), ["terms"], "left_semi").toLocalIterator()}
    for item in items:
        item.rank(counts, key_terms)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, least_words: int = 1, **options) -> DataFrame:
    """docs without the documents that find_leaks reports for items of at least `least_words` words; columns as given; rows with a null doc_id or text stay.

    find_leaks matches an item shorter than a phrase as a whole, so an item of one common word would delete every document that has it.
    """
    gone = materialize(find_leaks(docs, benchmark, **options).where(F.col("item_terms") >= least_words).select("doc_id").distinct(), "leaked", keep=True)
    return lookup_join(docs, gone, ["doc_id"], "left_anti")
