"""Line dedup by pairwise alignment.

A line is a piece of text up to and with a line break, or up to and with the end of a sentence (. ! ? and white space)
inside a longer line, so that a passage pasted into the middle of a paragraph is found too.  Lines are compared by the
hash of their words (case, punctuation and spacing don't count).

1. Documents with equal lines throughout are copies: the first stands for them all in what follows.
2. Keys are the shortest runs of consecutive lines, from each line on and back from each, that reach `block_words` words;
   lines without words don't count. A key's first holder is paired with each of its other holders. Any block two documents
   share is covered by such runs, however common its lines are, and pairs grow in proportion to the lines.
3. What moves is a row for each shared run and holder: the first holder, and where the run is in either; no lines. The rows
   of one later document, as many as its own runs, come together, and each of its pairs is aligned by patience diff over their
   shared runs: runs that both have once anchor the longest increasing chain, the gaps between anchors are aligned in the same way.
4. The lines of aligned runs are deleted from the later document, the one of greater (doc_id, text hash). So are those of
   shared runs that no alignment meets, since they stand in another order or more than once.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import lookup_join, materialize, scratch
from . import textkit as tk
from .common import free_name, id_kind, text_key, texts

BLOCK_WORDS = 30
_BASE = 0x9E3779B97F4A7C15
_END = np.zeros(256, dtype=bool)
_END[[46, 33, 63]] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 13, 32]] = True


def line_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions after each line; every row that has text ends with one."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    after = np.append(data[1:], 10)
    end = np.flatnonzero((data == 10) | (_END[data] & _SPACE[after] & (after != 10) & (after != 13))) + 1
    return np.unique(np.concatenate([end, offsets[1:][offsets[1:] > offsets[:-1]]]))


def lines(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, end byte in the row, hash, words) of each line in order; a line without words has hash 0."""
    w = tk.words(column)
    data, offsets = tk.utf8(column)
    end = line_ends(data, offsets)
    row = np.searchsorted(offsets, end, side="left") - 1
    if len(data) != len(w.data):  # lower-casing moved bytes: lines by their order of words instead
        return _slow_lines(column)
    line = np.searchsorted(end, w.start, side="right")
    count = np.bincount(line, minlength=len(end))
    first = np.searchsorted(line, np.arange(len(end)))
    with np.errstate(over="ignore"):
        place = (np.arange(len(line)) - first[line]).astype(np.uint64) if len(line) else np.zeros(0, np.uint64)
        mixed = tk.mix(w.hash + place * np.uint64(0x9E3779B97F4A7C15))
        sums = np.zeros(len(end), dtype=np.uint64)
        held = np.flatnonzero(count)
        if len(held):
            sums[held] = tk.mix(np.add.reduceat(mixed, first[held]))
    return row, end - offsets[row], sums.view(np.int64), count


def _slow_lines(column: pa.Array):
    out = []
    for r, text in enumerate(column.to_pylist()):
        raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
        ends = line_ends(raw, np.array([0, len(raw)])).tolist()
        pieces = [bytes(raw[a:b]).decode("utf-8", "ignore") for a, b in zip([0, *ends], ends)]
        w = tk.words(pa.array(pieces, pa.large_string()))
        count = np.bincount(w.doc, minlength=len(pieces)) if len(pieces) else np.zeros(0, np.int64)
        first = np.searchsorted(w.doc, np.arange(len(pieces)))
        for k, e in enumerate(ends):
            with np.errstate(over="ignore"):
                h = w.hash[first[k] : first[k] + count[k]]
                total = tk.mix(np.array([tk.mix(h + np.arange(len(h), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)], dtype=np.uint64)).view(np.int64)[0] if len(h) else 0
            out.append((r, e, total, count[k]))
    a = np.array(out, dtype=np.int64).reshape(-1, 4)
    return a[:, 0], a[:, 1], a[:, 2], a[:, 3]


def _lined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tk.chunks(batch, "text"):
            row, _, hashed, count = lines(part.column("text"))
            n = part.num_rows
            edge = np.searchsorted(row, np.arange(n + 1))
            same = [hashlib.md5(hashed[a:b].tobytes()).digest() for a, b in zip(edge, edge[1:])]
            total = np.bincount(row, weights=count, minlength=n).astype(np.int64)
            columns = [part.column("doc_id"), part.column("digest"), pa.array(same, pa.binary()), pa.array(total), pa.array(np.diff(edge).astype(np.int32)), tk.lists(hashed, row, n, pa.int64()), tk.lists(count.astype(np.int32), row, n, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "same", "total", "m", "lines", "words"])


def run_keys(hashed: np.ndarray, count: np.ndarray, row: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, first line, end line) of each shortest run of at least `least` words, from a line on or back from it; a run stays in its row, and lines count from the row's first."""
    own_line = np.arange(len(row)) - np.searchsorted(row, row)
    held = hashed != 0
    hashed, row, own_line = hashed[held].view(np.uint64), row[held].astype(np.int64), own_line[held]
    n = len(hashed)
    if not n:
        return (np.zeros(0, np.int64),) * 4
    total = np.concatenate([[0], np.cumsum(count[held], dtype=np.int64)])
    first, last = np.searchsorted(row, row, side="left"), np.searchsorted(row, row, side="right")
    at = np.arange(n)
    stop = np.searchsorted(total, total[:-1] + least)
    start = np.searchsorted(total, total[1:] - least, side="right") - 1
    on, back = stop <= last, start >= first
    both = np.unique(np.concatenate([at[on] * (n + 1) + stop[on], start[back] * (n + 1) + at[back] + 1]))
    start, stop = both // (n + 1), both % (n + 1)
    with np.errstate(over="ignore"):
        base, inverse = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
        power = lambda x: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x)]), dtype=np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tk.mix(hashed) * power(base)[:-1], dtype=np.uint64)])
        key = tk.mix((sums[stop] - sums[start]) * power(inverse)[start] + (stop - start).astype(np.uint64)).view(np.int64)
    return row[start], key, own_line[start], own_line[stop - 1] + 1


def _keyed(block_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, digest, hashed, count = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "digest", "lines", "words"))
            row = np.repeat(np.arange(batch.num_rows), hashed.value_lengths().to_numpy(zero_copy_only=False))
            own, key, start, stop = run_keys(hashed.flatten().to_numpy(zero_copy_only=False), count.flatten().to_numpy(zero_copy_only=False), row, block_words)
            at = pa.array(own)
            yield pa.RecordBatch.from_arrays([doc.take(at), digest.take(at), pa.array(key), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], ["doc_id", "digest", "run", "start", "stop"])

    return run


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned index pairs of two sequences, increasing in both; 0 aligns with nothing."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0] != 0:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1] != 0:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        ca, cb = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {x: i for i, x in enumerate(a[a0:a1], a0) if ca[x] == 1 and cb.get(x) == 1 and x}
        chain = _increasing([(at[x], j) for j, x in enumerate(b[b0:b1], b0) if x in at])
        if not chain:
            continue
        for i, j in chain:
            todo.append((a0, i, b0, j))
            found.append((i, j))
            a0, b0 = i + 1, j + 1
        todo.append((a0, a1, b0, b1))
    return sorted(found)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of pairs (given in order of the second) whose first members rise."""
    tops: list[int] = []
    last: list[int] = []
    back: list[int] = []
    for k, (i, _) in enumerate(pairs):
        p = bisect_left(tops, i)
        back.append(last[p - 1] if p else -1)
        if p == len(tops):
            tops.append(i)
            last.append(k)
        else:
            tops[p], last[p] = i, k
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(shared: list[tuple[int, int, int, int]]) -> tuple[set[int], set[int]]:
    """(aligned, moved): lines of the later document of a pair in runs both hold. shared: (run, place in the first, first line and end line in the later)."""
    rank = {run: k for k, run in enumerate(sorted({x[0] for x in shared}), 1)}
    first = sorted({(x[1], rank[x[0]]) for x in shared})
    later = sorted((x[2], x[3], rank[x[0]]) for x in shared)
    met = [later[j][:2] for _, j in patience([k for _, k in first], [k for *_, k in later])]
    aligned = {k for a, b in met for k in range(a, b)}
    return aligned, {k for a, b, _ in later for k in range(a, b)} - aligned


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = {c: batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "digest", "shared")}
        shared = at["shared"]
        edge = shared.offsets.to_numpy(zero_copy_only=False)
        inner = shared.values
        pair, run, place, start, stop = (inner.field(c).to_numpy(zero_copy_only=False) for c in ("pair", "run", "place", "start", "stop"))
        gone = []
        for a, b in zip(edge, edge[1:]):
            of: dict[int, list[tuple[int, int, int, int]]] = {}
            for p, *x in zip(pair[a:b].tolist(), run[a:b].tolist(), place[a:b].tolist(), start[a:b].tolist(), stop[a:b].tolist()):
                of.setdefault(p, []).append(tuple(x))
            gone.append(sorted(set().union(*(k for own in of.values() for k in align(own)))))
        yield pa.RecordBatch.from_arrays([at["doc_id"], at["digest"], pa.array(gone, type=pa.list_(pa.int32()))], ["doc_id", "digest", "gone"])


def find_repeats(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A written table (doc_id, digest, gone): the sorted indices of the lines to delete from each document that has any; digest is xxhash64 of its text."""
    kind = id_kind(docs)
    with scratch(docs.sparkSession):
        base = texts(docs).withColumn("digest", text_key())
        lined = materialize(base.mapInArrow(_lined, f"doc_id {kind}, digest long, same binary, total long, m int, lines array<long>, words array<int>"), "lines")
        whole = F.struct("doc_id", "digest")
        same = materialize(lined.groupBy("same").agg(F.min(whole).alias("first"), F.max(whole).alias("last")).where("first < last").drop("last"), "line-copies")
        marked = lookup_join(lined, same, ["same"])
        own = F.coalesce(F.col("first"), whole) == whole
        keys = marked.where(own).select("doc_id", "digest", "lines", "words").mapInArrow(_keyed(block_words), f"doc_id {kind}, digest long, run long, start int, stop int")
        keys = materialize(keys, "line-runs")
        copies = marked.where(~own).select("doc_id", "digest", "total", "m", F.col("first.doc_id").alias("first_id"), F.col("first.digest").alias("first_digest"))
        copies = materialize(copies.distinct(), "line-later")
        shared = keys.groupBy("run").agg(F.min(F.struct("doc_id", "digest", "start")).alias("head"), F.max(whole).alias("last"))
        shared = shared.where(F.struct("head.doc_id", "head.digest") < F.col("last")).select("run", F.struct("head.doc_id", "head.digest").alias("first"), F.col("head.start").alias("place"))
        held = keys.join(shared, "run").where(F.col("first") != whole)
        rows = F.struct(F.xxhash64("first").alias("pair"), "run", "place", "start", "stop")
        gone = held.groupBy("doc_id", "digest").agg(F.collect_list(rows).alias("shared")).mapInArrow(_aligned, f"doc_id {kind}, digest long, gone array<int>")
        gone = materialize(gone, "line-gone")
        # A later copy of a document of block_words words goes altogether; of a shorter one it loses what the first loses.
        every = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda x: x.cast("int")).alias("gone")
        entire = copies.where((F.col("total") >= block_words) & (F.col("m") > 0)).select("doc_id", "digest", every)
        short = lookup_join(copies.where(F.col("total") < block_words), gone.toDF("first_id", "first_digest", "gone"), ["first_id", "first_digest"], "inner").select("doc_id", "digest", "gone")
        return materialize(gone.union(entire).union(short), "line-repeats", keep=True)


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, last = batch.schema.get_field_index("text"), batch.num_columns - 1
        for part in tk.chunks(batch, "text"):
            texts = part.column(text)
            row, end, _, _ = lines(texts)
            first = np.searchsorted(row, np.arange(part.num_rows + 1))
            out = texts.to_pylist()
            for r, gone in enumerate(part.column(last).to_pylist()):
                if gone:
                    raw, ends = out[r].encode(), end[first[r] : first[r + 1]].tolist()
                    dead = set(gone)
                    out[r] = b"".join(raw[a:b] for k, (a, b) in enumerate(zip([0, *ends], ends)) if k not in dead).decode("utf-8", "replace")
            columns = [pa.array(out, type=texts.type) if i == text else c for i, c in enumerate(part.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=part.schema)


def dedup_lines(docs: DataFrame, drop_empty: bool = True, **options) -> DataFrame:
    """docs with the repeated blocks deleted from each later document's text; columns as given, n_chars (where there is one) counted anew.

    A document of which nothing but white space is left goes, unless drop_empty is False; one that was empty before stays.
    Rows with a null doc_id or text, and texts without words, stay as they are. Repeated rows are one document and get the same
    text each. Rows that share a doc_id are told apart by their text. Ties in order can't be: (doc_id, text hash) is total.
    Empty tables stay empty. doc_id may be of any ordered type.
    """
    cols = docs.columns
    digest, dead = free_name(docs, "__digest"), free_name(docs, "__gone")
    gone = find_repeats(docs, **options).toDF("doc_id", digest, dead)
    marked = lookup_join(docs.withColumn(digest, text_key()), gone, ["doc_id", digest])
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    changed = marked.where(F.col(dead).isNotNull()).select(*cols, dead)
    cleaned = changed.mapInArrow(_cleaned, changed.schema).drop(dead)
    if drop_empty:
        cleaned = cleaned.where("trim(both ' \\t\\r\\n' from text) <> ''")
    if "n_chars" in cols:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(kinds["n_chars"]))
    return marked.where(F.col(dead).isNull()).select(cols).unionByName(cleaned.select(cols))
