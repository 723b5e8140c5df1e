"""License scans: winnowed template fingerprints find candidates, banded alignment measures them.

1. Each template becomes the hashes of its runs of K words; of every WINDOW consecutive ones the least is kept
   (winnowing, Schleimer, Wilkerson and Aiken, 2003). They make an inverted index of (hash, template, position).
2. All runs of K words of each text are looked up, so any stretch of K + WINDOW - 1 words of a template is met.
3. Hits of a template whose diagonals (text position less template position) are no further than the band apart are one
   candidate. Of it, stretches stay that hold enough of the template's words, each word counted as often as the template has it at most.
4. A local alignment of words (match 1, substitution or gap -1) over the band, a template word at a time for all text words at
   once, gives the best stretch that ends at each word. A place whose matches cover at least the given share of the template's
   words is reported; what lies between places is aligned again.
5. In templates of fewer than EXACT words one word may tell two licenses apart, so these must stand in the text word for word.

The index grows with the templates, not with the texts; templates beyond BLOCK_TERMS words are scanned in blocks. A place is at
most twice as long as its template, so a long text costs a multiple of its length however often it repeats a notice.

The templates are the files of `templates/`: whole texts, the headers that stand in source files, and one-line notices.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from ..plans.storage import materialize
from . import textkit as tk
from .common import id_kind, texts

K, WINDOW, BAND, COVERAGE, EXACT = 3, 3, 6, 0.8, 20
BLOCK_TERMS = 1_000_000
_STRETCH, _CELLS = 256, 200_000


@cache
def _templates() -> dict[str, str]:
    """The template files, which only the driver reads: workers get an index."""
    folder = Path(__file__).parent / "templates"
    notes = [line.split("\t") for line in (folder / "notes.tsv").read_text(encoding="utf-8").splitlines()]
    return {f.stem: f.read_text(encoding="utf-8") for f in sorted(folder.glob("*.txt"))} | dict(notes)


def __getattr__(name: str) -> dict[str, str]:
    if name == "TEMPLATES":
        return _templates()
    raise AttributeError(name)


_FOUND = "template string, coverage double, matched int, template_words int, template_start int, template_end int, doc_start int, doc_end int, char_start int, char_end int"


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - k + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = (out + h[j : len(h) - k + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
    return tk.mix(out)


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions kept: of every window the least hash, the last one on a tie."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.int64)
    width = min(window, n)
    views = np.lib.stride_tricks.sliding_window_view(hashes, width)[:, ::-1]
    return np.unique(np.arange(n - width + 1) + width - 1 - np.argmin(views, axis=1))


class Index:
    """Templates and their fingerprints, sorted by hash."""

    def __init__(self, templates: dict[str, str], k: int, window: int, coverage: float, exact: int):
        self.names, self.k = sorted(templates), k
        w = tk.words(pa.array([templates[n] for n in self.names], pa.large_string()))
        edges = np.searchsorted(w.doc, np.arange(len(self.names) + 1))
        self.words = [w.hash[a:b] for a, b in zip(edges, edges[1:])]
        self.bag = [np.unique(x, return_counts=True) for x in self.words]
        self.exact = np.array([len(x) < exact for x in self.words], dtype=bool)
        self.need = np.array([len(x) if e else max(1, math.ceil(coverage * len(x) - 1e-9)) for x, e in zip(self.words, self.exact)], dtype=np.int64)
        found = [(r[p], t, p) for t, x in enumerate(self.words) if len(x) >= k for r in [runs(x, k)] for p in winnow(r, window).tolist()]
        found.sort()
        self.hash, self.template, self.position = (np.array([f[c] for f in found], dtype=kind) for c, kind in ((0, np.uint64), (1, np.int64), (2, np.int64)))

    def holds(self, t: int, b: np.ndarray) -> bool:
        """Whether b has enough of the template's words, in whatever order."""
        if len(b) < self.need[t]:
            return False
        words, most = self.bag[t]
        at = np.minimum(np.searchsorted(words, b), len(words) - 1)
        return int(np.minimum(np.bincount(at[words[at] == b], minlength=len(words)), most).sum()) >= self.need[t]

    def stretches(self, t: int, b: np.ndarray) -> list[tuple[int, int]]:
        """Parts of b outside of which no place can lie: windows of at least four template lengths that overlap by two, as a place is shorter than two."""
        m = len(self.words[t])
        size = max(4 * m, _STRETCH)
        if len(b) <= size:
            return [(0, len(b))] if self.holds(t, b) else []
        out: list[tuple[int, int]] = []
        for x in range(0, len(b) - 2 * m, size - 2 * m):
            if self.holds(t, b[x : x + size]):
                if out and x <= out[-1][1]:
                    out[-1] = (out[-1][0], min(len(b), x + size))
                else:
                    out.append((x, min(len(b), x + size)))
        return out


def ends(a: np.ndarray, b: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each word of each row of b the best local alignment with low <= j - i <= high that ends there: (score, matches, a from, a to, b from); ties go to the first end in a, then to the diagonal.

    A match scores 1, a substitution or gap -1; more matches are not sought at equal scores.
    """
    rows, n = b.shape
    score, match, a0, b0 = (np.zeros((rows, n + 1), dtype=np.int64) for _ in range(4))  # of the template word before, shifted by one
    best, hits, first, last, start = (np.zeros((rows, n), dtype=np.int64) for _ in range(5))
    every = np.arange(n)
    for i in range(len(a)):
        y0, y1 = max(0, i + low), min(n, i + high + 1)
        if y0 >= n:
            break
        if y1 <= y0:
            continue
        here, next_ = slice(y0, y1), slice(y0 + 1, y1 + 1)
        on, hit = score[:, here] > 0, b[:, here] == a[i]
        s = np.where(on, score[:, here], 0) + np.where(hit, 1, -1)
        m, f, g = np.where(on, match[:, here], 0) + hit, np.where(on, a0[:, here], i), np.where(on, b0[:, here], every[here])
        up = score[:, next_] - 1 > s
        if up.any():
            s, m, f, g = (np.where(up, x, y) for x, y in ((score[:, next_] - 1, s), (match[:, next_], m), (a0[:, next_], f), (b0[:, next_], g)))
        w, own = y1 - y0, every[: y1 - y0]
        far = np.maximum.accumulate((s + own) * w + own, axis=1)  # gaps in a: the nearest of the best cells to the left
        source = far % w
        s, m, f, g = far // w - own, *(np.take_along_axis(x, source, axis=1) for x in (m, f, g))
        s[s < 0] = 0
        score[:, next_], match[:, next_], a0[:, next_], b0[:, next_] = s, m, f, g
        more = s > best[:, here]
        if more.any():
            at = np.nonzero(more)
            to = (at[0], at[1] + y0)
            best[to], hits[to], first[to], last[to], start[to] = s[at], m[at], f[at], i + 1, g[at]
    return best, hits, first, last, start


def align(a: np.ndarray, b: np.ndarray, low: int, high: int) -> tuple[int, int, int, int, int]:
    """The best of `ends`: (matches, a from, a to, b from, b to)."""
    score, match, a0, a1, b0 = (x[0] for x in ends(a, b[None], low, high))
    if not len(score) or not score.max():
        return 0, 0, 0, 0, 0
    k = min(np.flatnonzero(score == score.max()).tolist(), key=lambda k: (a1[k], k))
    return int(match[k]), int(a0[k]), int(a1[k]), int(b0[k]), k + 1


def _chosen(found: tuple[np.ndarray, ...], need: int) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int]]]:
    """Of one row of `ends` the places that don't overlap, the highest score first, then the first end; and the stretches between them."""
    score, match, a0, a1, b0 = found
    able = np.flatnonzero(match >= need)
    if not len(able):
        return [], []
    out, taken = [], np.zeros(len(score), dtype=bool)
    for k in able[np.lexsort((able, a1[able], -score[able]))].tolist():
        if not taken[b0[k] : k + 1].any():
            taken[b0[k] : k + 1] = True
            out.append((int(match[k]), int(a0[k]), int(a1[k]), int(b0[k]), k + 1))
    free = np.flatnonzero(np.diff(np.concatenate([[1], taken.astype(np.int8), [1]]))).tolist()
    return out, list(zip(free[::2], free[1::2]))


def places(index: Index, t: int, b: np.ndarray, low: int, high: int, todo: list[tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(matches, a from, a to, b from, b to) of places within the stretches `todo` of b and in what they leave free."""
    out = []
    while todo:
        x, y = todo.pop()
        own, free = _chosen(tuple(v[0] for v in ends(index.words[t], b[None, x:y], low - x, high - x)), int(index.need[t]))
        out += [(n, a0, a1, x + b0, x + b1) for n, a0, a1, b0, b1 in own]
        todo += [(x + u + p, x + u + q) for u, v in free for p, q in index.stretches(t, b[x + u : x + v])]
    return out


def narrow_places(index: Index, t: int, hashes: np.ndarray, bands: list[tuple[int, int, int, int]]) -> list[list[tuple[int, int, int, int, int]]]:
    """`places` of many stretches at once, b counted in hashes. bands: (first and end word of the text, least and greatest diagonal)."""
    out: list = [[] for _ in bands]
    order = sorted(range(len(bands)), key=lambda k: bands[k][3] - bands[k][2])
    m, need = len(index.words[t]), int(index.need[t])
    odd = np.uint64(next(x for x in range(1, 1 << 62) if x not in set(index.words[t].tolist())))  # equals no word of the template
    while order:
        size = max(1, min(len(order), _CELLS // (m + bands[order[-1]][3] - bands[order[-1]][2] + 1)))
        part, order = order[:size], order[size:]
        wide = max(bands[k][3] - bands[k][2] for k in part)
        at = np.array([bands[k][2] for k in part])[:, None] + np.arange(m + wide)
        inside = (at >= np.array([bands[k][0] for k in part])[:, None]) & (at < np.array([bands[k][1] for k in part])[:, None])
        inside &= np.arange(m + wide) < np.array([m + bands[k][3] - bands[k][2] for k in part])[:, None]
        b = np.where(inside, hashes[np.clip(at, 0, len(hashes) - 1)], odd)
        found = ends(index.words[t], b, 0, wide)
        for r in np.flatnonzero((found[1] >= need).any(axis=1)).tolist():
            k, base = part[r], bands[part[r]][2]
            own, free = _chosen(tuple(v[r] for v in found), need)
            todo = [(u + p, u + q) for u, v in free for p, q in index.stretches(t, b[r, u:v])]
            own += places(index, t, b[r], 0, bands[k][3] - base, todo)
            out[k] = [(n, a0, a1, base + b0, base + b1) for n, a0, a1, b0, b1 in own]
    return out


def _scan(index: Index, band: int, kind: pa.DataType):
    types = {"string": pa.string(), "double": pa.float64(), "int": pa.int32()}
    schema = pa.schema([("doc_id", kind), *((f.split()[0], types[f.split()[1]]) for f in _FOUND.split(", "))])

    def found(part: pa.RecordBatch) -> list[tuple]:
        w = tk.words(part.column(part.schema.get_field_index("text")))
        ids = part.column(part.schema.get_field_index("doc_id"))
        h = runs(w.hash, index.k)
        if not len(h):
            return []
        low, high = np.searchsorted(index.hash, h), np.searchsorted(index.hash, h, side="right")
        n = np.where(w.doc[: len(h)] == w.doc[index.k - 1 :], high - low, 0)
        p = np.repeat(np.arange(len(h)), n)
        at = np.repeat(low, n) + np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n)
        doc, t, d = w.doc[p], index.template[at], p - index.position[at]
        keep = np.bincount(w.doc)[doc] >= index.need[t]
        doc, t, d = doc[keep], t[keep], d[keep]
        order = np.lexsort((d, t, doc))
        doc, t, d = doc[order], t[order], d[order]
        new = np.append(True, (doc[1:] != doc[:-1]) | (t[1:] != t[:-1]) | (d[1:] - d[:-1] > band))[: len(d)]
        edge = np.append(np.flatnonzero(new), len(d)).tolist()
        spans: dict[tuple[int, int], list[tuple[int, int, int, int, int]]] = {}
        slim: dict[int, list[tuple[int, int, int, int]]] = {}
        able: dict[tuple[int, int], bool] = {}
        for x, y in zip(edge, edge[1:]):
            own, k = int(doc[x]), int(t[x])
            first, last = np.searchsorted(w.doc, [own, own + 1]).tolist()
            a, spot = index.words[k], spans.setdefault((own, k), [])
            if index.exact[k]:
                for s in np.unique(d[x:y]).tolist():
                    if s >= first and s + len(a) <= last and np.array_equal(w.hash[s : s + len(a)], a):
                        spot.append((-len(a), s, s + len(a), 0, len(a)))
                continue
            if (own, k) not in able:
                able[own, k] = index.holds(k, w.hash[first:last])
            if not able[own, k]:
                continue
            low, high = int(d[x]) - band, int(d[y - 1]) + band
            start, stop = max(first, low), min(last, high + len(a))
            todo = index.stretches(k, w.hash[start:stop])
            if todo == [(0, stop - start)]:
                slim.setdefault(k, []).append((first, last, low, high))
            else:
                spot += [(-n, start + b0, start + b1, a0, a1) for n, a0, a1, b0, b1 in places(index, k, w.hash[start:stop], low - start, high - start, todo)]
        for k, bands in slim.items():
            for (first, *_), own in zip(bands, narrow_places(index, k, w.hash, bands)):
                spans[int(w.doc[first]), k] += [(-n, b0, b1, a0, a1) for n, a0, a1, b0, b1 in own]
        out = []
        lead = None
        for (own, k), spot in spans.items():
            first, last = np.searchsorted(w.doc, [own, own + 1]).tolist()
            taken = np.zeros(last - first, dtype=bool)
            for n, b0, b1, a0, a1 in sorted(spot):
                if taken[b0 - first : b1 - first].any():
                    continue
                taken[b0 - first : b1 - first] = True
                if lead is None:
                    lead = np.append(0, np.cumsum((w.data & 0xC0) != 0x80))
                chars = lead[[w.start[b0], w.end[b1 - 1]]] - lead[w.offsets[own]]
                size = len(index.words[k])
                out.append((ids[own].as_py(), index.names[k], -n / size, -n, size, a0, a1, b0 - first, b1 - first, int(chars[0]), int(chars[1])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.chunks(batch, "text"):
                rows = found(part)
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)

    return run


def scan(docs: DataFrame, templates: dict[str, str] | None = None, k: int = K, window: int = WINDOW, band: int = BAND, coverage: float = COVERAGE, exact: int = EXACT) -> DataFrame:
    """A row for each place where a text covers a template.

    doc_id (see `common.id_kind`), template, coverage (matched / template_words), matched, template_words, template_start and
    template_end, doc_start and doc_end (words, from 0, end exclusive), char_start and char_end (characters of the lower-cased text).

    Words are compared in lower case without punctuation. Rows with a null doc_id or text have no row; neither have
    texts or templates of fewer than k words. Places of one template in one text don't overlap: more matches come
    first, then the earlier. Templates of fewer than `exact` words have places that equal them only.
    Equal rows are reported once; rows that share a doc_id are scanned each. No templates give no rows.
    """
    given = sorted((_templates() if templates is None else templates).items())
    base = texts(docs)
    blocks: list[dict[str, str]] = []
    size = 0
    for name, text in given:
        size += len(text.split())
        if not blocks or size > BLOCK_TERMS:
            blocks.append({})
            size = len(text.split())
        blocks[-1][name] = text
    indexes = [x for x in (Index(b, k, window, coverage, exact) for b in blocks) if len(x.hash)]
    schema = f"doc_id {id_kind(docs)}, {_FOUND}"
    if not indexes:
        return docs.sparkSession.createDataFrame([], schema)
    kind = to_arrow_type(base.schema["doc_id"].dataType)
    found = reduce(DataFrame.union, [base.mapInArrow(_scan(x, band, kind), schema) for x in indexes])
    return materialize(found, "license-matches", keep=True).distinct()
