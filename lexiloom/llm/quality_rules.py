"""Quality rules with risk-controlled thresholds.

Five shares are measured on each whole text (see `measure`). A level is a joint cutoff on all of them, from lenient (0)
to strict (LEVELS - 1), and a document's own level is the most lenient one at which any rule rejects it.

Which level a stratum uses is learnt from labelled holdouts, here every document with quality = 1. Let n of them be in
the stratum and k of these have a level of at most j. Level j is accepted if k or fewer false rejections in n would
have a probability of at most delta / strata when the true rate were `risk` (an exact binomial, Clopper-Pearson bound).
Levels are tested from 0 on and the first failure ends the search, so no correction is due within a stratum (fixed
sequence testing); over the strata it is Bonferroni's. Hence with probability 1 - delta or more no stratum rejects more
than the share `risk` of its good documents. A stratum with too few labels accepts no level and rejects nothing.

Labels only meet the narrow table of levels; the texts are scanned twice and never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import lookup_join, materialize, scratch
from . import textkit as tk
from .common import free_name, id_kind, need, own_id, texts

RISK, DELTA = 0.025, 0.05
CUTOFFS = {
    "markup": (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.04, 0.03),
    "upper": (0.9, 0.8, 0.7, 0.65, 0.6, 0.55, 0.5, 0.45, 0.4, 0.37, 0.36, 0.35),
    "digits": (0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5, 0.47, 0.45, 0.43),
    "echo": (0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5, 0.45, 0.4),
    "relines": (0.98, 0.95, 0.92, 0.9, 0.87, 0.85, 0.82, 0.8, 0.75, 0.7, 0.65, 0.6),
}
"""Greatest shares that pass, by level."""
LEVELS = 12
OTHER = "?"
_MARKUP = np.zeros(256, dtype=bool)
_MARKUP[[ord(c) for c in "#$%&*|!<>{}[]\\^~`=+_@"]] = True
_SHARES = ", ".join(f"{c} double" for c in CUTOFFS)


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """The five shares of each text; 0 where a text is null or has nothing to count.

    markup, upper, digits: of the characters, those of #$%&*|!<>{}[]\\^~`=+_@, A to Z, 0 to 9.
    echo: of the words, those equal to the one before or to the one before that (case doesn't count).
    relines: of the lines that aren't empty, those equal to an earlier one (case doesn't count).
    """
    data, offsets = tk.utf8(column)
    chars = tk.row_sums((data & 0xC0) != 0x80, offsets)
    share = lambda part, whole: np.divide(part, whole, out=np.zeros(len(part)), where=whole > 0)
    out = {
        "markup": share(tk.row_sums(_MARKUP[data], offsets), chars),
        "upper": share(tk.row_sums((data >= 65) & (data <= 90), offsets), chars),
        "digits": share(tk.row_sums((data >= 48) & (data <= 57), offsets), chars),
    }
    n = len(chars)
    w = tk.words(column)
    again = np.zeros(len(w.hash), dtype=bool)
    for k in (1, 2):
        again[k:] |= (w.hash[k:] == w.hash[:-k]) & (w.doc[k:] == w.doc[:-k])
    out["echo"] = share(np.bincount(w.doc, weights=again, minlength=n), np.bincount(w.doc, minlength=n))
    cut = w.data == 10
    edge = np.unique(np.concatenate([np.flatnonzero(cut), w.offsets]))
    start, end = edge[:-1] + (cut[np.minimum(edge[:-1], max(len(cut) - 1, 0))] if len(cut) else 0), edge[1:]
    full = end > start
    start, end = start[full], end[full]
    row = np.searchsorted(w.offsets, start, side="right") - 1
    hashed = tk.span_hashes(w.data, start, end)
    order = np.lexsort((hashed, row))
    r, h = row[order], hashed[order]
    first = np.ones(len(r), dtype=bool)
    first[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    lines = np.bincount(row, minlength=n)
    out["relines"] = share(lines - np.bincount(r[first], minlength=n), lines)
    return out


def levels(shares: dict[str, np.ndarray]) -> np.ndarray:
    """The most lenient level that rejects each text; LEVELS if none does."""
    own = np.full(len(shares["markup"]), LEVELS)
    for rule, cutoffs in CUTOFFS.items():
        own = np.minimum(own, np.searchsorted(-np.array(cutoffs), -shares[rule], side="right"))
    return own


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tk.chunks(batch, "text"):
            shares = measure(part.column(part.schema.get_field_index("text")))
            columns = [part.column(part.schema.get_field_index(c)) for c in ("doc_id", "stratum")]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(v) for v in shares.values()), pa.array(levels(shares).astype(np.int32))], ["doc_id", "stratum", *shares, "level"])


def measured(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum, the five shares and the level of each row with a doc_id and a text."""
    base = texts(docs, stratum).toDF("doc_id", "text", "stratum")
    base = base.select("doc_id", "text", _stratum("stratum").alias("stratum"))
    return base.mapInArrow(_measured, f"doc_id {id_kind(docs)}, stratum string, {_SHARES}, level int")


def _stratum(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(OTHER))


def tail(n: int, k: int, p: float) -> float:
    """P(X <= k) for X binomial (n, p)."""
    if k >= n:
        return 1.0
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(log)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in log))


def choose(held: dict[str, list[int]], risk: float = RISK, delta: float = DELTA) -> dict[str, int]:
    """The strictest accepted level of each stratum, -1 if none. held: numbers of good holdouts by own level 0..LEVELS."""
    out = {}
    for stratum, counts in held.items():
        n, k, best = sum(counts), 0, -1
        for j in range(LEVELS):
            k += counts[j]
            if k > risk * n or tail(n, k, risk) > delta / len(held):
                break
            best = j
        out[stratum] = best
    return out


def calibrate(table: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> dict[str, int]:
    """Levels by stratum, from `measured` documents and labels (doc_id, quality).

    Good is a doc_id all of whose labels that aren't null are 1; each of its rows counts. No labels accept no level.
    """
    good = need(labels, ("doc_id", "quality")).where("doc_id is not null and quality is not null").groupBy(own_id(labels)).agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    counts = table.join(good, "doc_id", "left_semi").groupBy("stratum", "level").count().collect()  # one row a stratum and level
    held: dict[str, list[int]] = {}
    for r in counts:
        held.setdefault(r["stratum"], [0] * (LEVELS + 1))[r["level"]] += r["count"]
    return choose(held, risk, delta)


def _cutoffs(docs: DataFrame, chosen: dict[str, int]) -> DataFrame:
    return docs.sparkSession.createDataFrame(sorted(chosen.items()), "stratum string, cutoff int")


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """A row for each document row: doc_id, stratum, the shares, level, cutoff (the stratum's level, -1: rejects nothing) and keep.

    keep is false where level <= cutoff. Rows with a null doc_id or text aren't judged and have no row; a null stratum is '?'.
    Empty texts have shares of 0 and are kept. Repeated rows are judged alike, a row each. A share equal to a cutoff passes.
    Empty tables give no rows; columns other than doc_id, text and the stratum play no part. doc_id is as in `common.id_kind`.
    """
    table = materialize(measured(docs, stratum), "rule-levels", keep=True)
    chosen = calibrate(table, labels, risk, delta)
    out = lookup_join(table, _cutoffs(docs, chosen), ["stratum"]).withColumn("cutoff", F.coalesce("cutoff", F.lit(-1)))
    return out.withColumn("keep", F.col("level") > F.col("cutoff"))


def _passing(chosen: dict[str, int], mark: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.chunks(batch, "text"):
                at = {c: part.schema.get_field_index(c) for c in ("doc_id", "text", mark)}
                own = levels(measure(part.column(at["text"])))
                limit = np.array([chosen.get(s, -1) for s in part.column(at[mark]).to_pylist()], dtype=np.int64)
                judged = np.array(part.column(at["doc_id"]).is_valid()) & np.array(part.column(at["text"]).is_valid())
                yield part.filter(pa.array((own > limit) | ~judged)).select([n for n in part.schema.names if n != mark])

    return run


def drop_rejected(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """docs without the documents that `judge` rejects; columns as given; rows with a null doc_id or text stay. The stratum may be of any type."""
    with scratch(docs.sparkSession):
        chosen = calibrate(materialize(measured(docs, stratum).select("doc_id", "stratum", "level"), "rule-levels"), labels, risk, delta)
    mark = free_name(docs, "__stratum")
    return docs.withColumn(mark, _stratum(stratum)).mapInArrow(_passing(chosen, mark), docs.schema)


def _sql() -> str:
    least = "least(" + ", ".join(f"case {' '.join(f'when {rule} > {c}::double then {j}' for j, c in enumerate(cutoffs))} else {LEVELS} end" for rule, cutoffs in CUTOFFS.items()) + ")"
    word = r"[0-9a-z\x{80}-\x{9F}\x{C0}-\x{1FFF}\x{2080}-\x{2FFF}\x{3040}-\x{3FFF}\x{A000}-\x{10FFFF}]+|[\x{4000}-\x{9FFF}]"
    count = lambda chars: f"(n - length(regexp_replace(text, '[{chars}]', '', 'g')))"
    return rf"""
with t as (
  select row_number() over () as rid, doc_id, coalesce(lang, '?') as stratum, text, length(text)::double as n, regexp_extract_all(lower(text), '{word}') as w,
    list_filter(string_split(lower(text), chr(10)), lambda x: x <> '') as l from documents where doc_id is not null and text is not null),
e as (select rid, count(*) filter (x = y or x = z)::double as again from (select rid, x, lag(x) over (partition by rid order by i) as y, lag(x, 2) over (partition by rid order by i) as z
  from (select rid, unnest(w) as x, unnest(range(len(w))) as i from t)) group by rid),
s as (select rid, doc_id, stratum, coalesce({count(r"#$%&*|!<>{}\[\]\\^~`=+_@")} / nullif(n, 0), 0) as markup, coalesce({count("A-Z")} / nullif(n, 0), 0) as upper, coalesce({count("0-9")} / nullif(n, 0), 0) as digits,
  coalesce(again / nullif(len(w), 0), 0) as echo, coalesce((len(l) - len(list_distinct(l)))::double / nullif(len(l), 0), 0) as relines from t left join e using (rid)),
j as (select *, {least}::int as level from s),
g as (select doc_id from labels where quality is not null group by doc_id having min(quality) = 1),
c as (select stratum, level, count(*) as c from j where doc_id in (select doc_id from g) group by all),
x as (select f.stratum, i as level, sum(coalesce(c, 0)) over (partition by f.stratum order by i) as k, sum(coalesce(c, 0)) over (partition by f.stratum) as m, count(*) over (partition by i) as strata
  from (select stratum, i::int as i from (select distinct stratum from c) cross join range({LEVELS + 1}) r(i)) f left join c on c.stratum = f.stratum and c.level = f.i),
p as (select *, list_sum(list_transform(range((k + 1)::bigint), lambda i: exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) + i * ln({RISK}::double) + (m - i) * ln(1 - {RISK}::double)))) > {DELTA}::double / strata or k > {RISK}::double * m as fails
  from (select stratum, level, k::double as k, m::double as m, strata from x) where level < {LEVELS}),
o as (select stratum, coalesce(min(level) filter (fails), {LEVELS}) - 1 as cutoff from p group by stratum)
select doc_id, j.stratum, markup, upper, digits, echo, relines, level, coalesce(cutoff, -1)::int as cutoff, level > coalesce(cutoff, -1) as keep from j left join o on o.stratum = j.stratum
"""


SQL = _sql()
