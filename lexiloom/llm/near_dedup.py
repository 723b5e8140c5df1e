"""MinHash near-duplicate removal by fast similarity sketching (Dahlgaard, Knudsen and Thorup, 2017).

1. Texts that are equal byte for byte are one document from here on (an exact group, however large).
2. Each text becomes the set of its shingles, runs of `shingle` words, over the whole text.
3. A sketch of t = bands * rows coordinates: in round i < t every shingle falls into one hashed bin with a hashed
   value, and a bin keeps the least (round, value) that reaches it; a text whose bins are all filled stops. In rounds
   t to 2t - 1 every shingle falls into bin i - t, so every coordinate is filled for any text that has a shingle.
   Coordinates agree with probability J(A, B), concentrated as if they were independent.
4. Texts that agree on all `rows` coordinates of a band share a bucket. Within a bucket each text is compared with the
   one of least doc_id, and those that fail with the least of them. So a bucket of thousands of copies costs a comparison
   each. Comparing means the exact Jaccard similarity of the two shingle sets.
5. What lies in one bucket but in different groups so far is joined on prefixes: with shingles in order of rarity, two sets of
   similarity t or more share one among the first |x| - ceil(t |x|) + 1 of each, and their sizes differ by a factor of 1 / t at
   most. So unlike texts that meet in a bucket over boilerplate are not compared, and no pair that could join two groups is left out.
6. Verified pairs are edges; connected components are the groups, named by their least doc_id.

A hot bucket, copy group or hub of the graph is counted by partial sums and joined; no window or task holds one whole.

Recall at similarity s is 1 - (1 - s**rows)**bands for a pair: 0.92 at 0.5, 0.99 at 0.6 with 40 bands of 4.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import lookup_join, materialize, scratch
from . import textkit as tk
from .common import DOC, free_name, id_kind, need, text_key, texts

SHINGLE, BANDS, ROWS, THRESHOLD = 3, 40, 4, 0.5
_FREE = np.uint64(2**64 - 1)


def sketch(rows: np.ndarray, hashes: np.ndarray, n: int, t: int) -> np.ndarray:
    """n x t coordinates (uint64) of the sets given as (row, hash) pairs; a row without hashes keeps 2**64 - 1 throughout."""
    table = np.full(n * t, _FREE, dtype=np.uint64)
    some = np.bincount(rows, minlength=n) > 0
    low = np.uint64((1 << 52) - 1)
    with np.errstate(over="ignore"):
        for i in range(2 * t):
            salt = tk.mix(np.array([i + 1], dtype=np.uint64))[0]
            if i >= t:  # only rows that still miss bin i - t
                live = some & (table.reshape(n, t)[:, i - t] == _FREE)
                pick = live[rows]
                x, r = hashes[pick], rows[pick]
                if not len(x):
                    continue
                y = tk.mix(x ^ salt)
                at = r * t + (i - t)
            else:
                y = tk.mix(hashes ^ salt)
                at = rows * t + ((y >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64)
            value = (np.uint64(i) << np.uint64(52)) | (y * np.uint64(0x9FB21C651E98DF25) >> np.uint64(12) & low)
            np.minimum.at(table, at, value)
            if i < t:
                open_rows = (table.reshape(n, t) == _FREE).any(axis=1)
                keep = open_rows[rows]
                rows, hashes = rows[keep], hashes[keep]
                if not len(rows):
                    break
    return table.reshape(n, t)


def band_keys(table: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each row and band, the band's number included."""
    n = len(table)
    keys = np.empty((n, bands), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            h = np.full(n, b + 1, dtype=np.uint64)
            for c in range(b * rows, (b + 1) * rows):
                h = tk.mix(h * np.uint64(0x9E3779B97F4A7C15) + table[:, c])
            keys[:, b] = h
    return keys


def _sketches(shingle: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.chunks(batch, "text"):
                n = part.num_rows
                r, h = tk.shingles(tk.words(part.column("text")), shingle)
                keys = band_keys(sketch(r, h, n, bands * rows), bands, rows).view(np.int64)
                some = np.bincount(r, minlength=n) > 0
                at = np.repeat(np.arange(n)[some], bands)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("digest"), tk.lists(keys[some].ravel(), at, n, pa.int64())], ["doc_id", "digest", "bands"])

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.chunks(batch, "text"):
                n = part.num_rows
                r, h = tk.shingles(tk.words(part.column("text")), shingle)
                order = np.lexsort((h, r))
                r, h = r[order], h[order]
                first = np.ones(len(r), dtype=bool)
                first[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), tk.lists(h[first].view(np.int64), r[first], n, pa.int64())], ["node", "items"])

    return run


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): root is the least node of the connected component; edges (a, b) of any ordered type.

    Alternates large-star and small-star (Kiveris et al., 2014), writing the edges after each round, until nothing moves.
    Least neighbours are partial sums that are joined back, so a hub of many edges is in no task whole.
    """
    digest = (F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    state = now.agg(*digest).first()
    while state["n"]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        now = materialize(small, name)
        after = now.agg(*digest).first()
        if after == state:
            break
        state = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) with near: whether the exact Jaccard similarity of their sets reaches the threshold; written."""
    left, right = sets.toDF("a", "x"), sets.toDF("b", "y")
    both = F.size(F.array_intersect("x", "y"))
    return materialize(pairs.join(right, "b").join(left, "a").select("a", "b", (both / (F.size("x") + F.size("y") - both) >= threshold).alias("near")), "near-pairs")


def _least(rows: DataFrame, by: str) -> DataFrame:
    """rows (by, doc_id) of the groups of more than one, with `least`, the least doc_id of the group."""
    groups = rows.groupBy(by).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select(by, "least")
    return rows.join(groups, by)


def _across(apart: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of apart (doc_id, root) with different roots that share a shingle of their prefixes and fit in size: all that can reach the threshold are among them."""
    own = materialize(sets.withColumnRenamed("node", "doc_id").join(apart, "doc_id"), "near-apart-sets")
    each = own.select("doc_id", "root", F.size("items").alias("n"), F.explode("items").alias("item"))
    often = each.groupBy("item").agg(F.count("*").alias("often")).where("often > 1")
    rare = F.struct(F.col("often"), F.col("item"))
    shared = each.join(often, "item").groupBy("doc_id", "root", "n").agg(F.array_sort(F.collect_list(rare)).alias("items"))  # a document's own shingles
    # Shingles that no other set has come first of all and match nothing, so they only shorten the prefix.
    prefix = (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1 - (F.col("n") - F.size("items"))).cast("int")
    keyed = shared.where(prefix > 0).select("doc_id", "root", "n", F.explode(F.slice("items", F.lit(1), prefix)).alias("i")).select("doc_id", "root", "n", "i.item")
    left, right = keyed.toDF("a", "x", "m", "item"), keyed.toDF("b", "y", "n", "item")
    fits = (F.col("a") < F.col("b")) & (F.col("x") != F.col("y")) & (F.least("m", "n") >= F.greatest("m", "n") * threshold - 1e-9)
    return left.join(right, "item").where(fits).select("a", "b").distinct()


def near_duplicate_groups(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """One row (doc_id, group_id, exact, keep, links) for each doc_id with a text, sorted in no way.

    group_id is the least doc_id of the group, keep says doc_id = group_id, exact that the text equals, byte for byte,
    that of a lesser doc_id. links: how many verified pairs of different texts its text is in (those that settle the groups,
    not all pairs of a group). A document like no other is a group of its own.

    Rows with a null doc_id or text are left out. Texts without any word are near to none, but equal ones (empty ones
    too) are exact copies. Repeated rows and rows that share a doc_id count as one document, the least text standing for
    it. Ties go to the least doc_id. No rows give no rows. Other columns are ignored. doc_id is as in `common.id_kind`.
    """
    kind = id_kind(docs)
    with scratch(docs.sparkSession):
        base = texts(docs)
        raw = materialize(base.withColumn("digest", F.md5("text")).mapInArrow(_sketches(shingle, bands, rows), f"doc_id {kind}, digest string, bands array<long>"), "near-sketches")
        own = raw.groupBy("doc_id").agg(F.min("digest").alias("digest"))
        copied = own.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("most")).where("rep < most").drop("most")
        least = lookup_join(own, materialize(copied, "near-copied"), ["digest"])
        least = materialize(least.select("doc_id", "digest", F.coalesce("rep", "doc_id").alias("rep")), "near-copies")
        reps = least.where("doc_id = rep").select("doc_id", "digest")
        # A row for each sketch, or several of one document: the first of its reps only.
        repeated = raw.count() != least.count()
        unique = raw.dropDuplicates(["doc_id", "digest"]) if repeated else raw
        if repeated or least.where("doc_id <> rep").limit(1).count():
            unique = lookup_join(unique, materialize(reps, "near-reps"), ["doc_id", "digest"], "left_semi") if repeated else lookup_join(unique, materialize(least.where("doc_id <> rep").select("doc_id"), "near-later"), ["doc_id"], "left_anti")
        keyed = unique.select("doc_id", F.explode("bands").alias("band"))
        linked = materialize(_least(keyed, "band"), "near-buckets")
        # Only texts that share a bucket are read again, and turned into sets once for all rounds of comparing.
        ended = lookup_join(base, materialize(linked.select("doc_id").distinct(), "near-ends"), ["doc_id"], "left_semi")
        if repeated:
            ended = lookup_join(ended.withColumn("digest", F.md5("text")), materialize(reps, "near-reps"), ["doc_id", "digest"], "left_semi").select(*DOC).dropDuplicates(["doc_id"])
        sets = materialize(ended.mapInArrow(_sets(shingle), f"node {kind}, items array<long>"), "near-sets")
        first = _verified(linked.where("doc_id > least").select(F.col("least").alias("a"), F.col("doc_id").alias("b")).distinct(), sets, threshold)
        failed = linked.join(first.where("not near").select(F.col("a").alias("least"), F.col("b").alias("doc_id")), ["least", "doc_id"], "left_semi").select("band", "doc_id")
        again = _least(materialize(failed, "near-failed"), "band").where("doc_id > least").select(F.col("least").alias("a"), F.col("doc_id").alias("b")).distinct()
        compared = first.union(_verified(again.join(first, ["a", "b"], "left_anti"), sets, threshold))
        roots = materialize(components(compared.where("near").select("a", "b"), "near-components"), "near-roots")
        placed = materialize(linked.select("band", "doc_id").join(roots.toDF("doc_id", "root"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id")), "near-placed")
        mixed = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band")
        apart = materialize(placed.join(mixed, "band", "left_semi").select("doc_id", "root").distinct(), "near-apart")
        near = compared.where("near").select("a", "b")
        if apart.limit(1).count():
            last = _verified(_across(apart, sets, threshold).join(compared.select("a", "b"), ["a", "b"], "left_anti"), sets, threshold).where("near").select("a", "b")
            near = near.union(last)
            if last.limit(1).count():
                roots = components(roots.toDF("a", "b").union(last), "near-components")
        links = near.select(F.col("a").alias("rep")).unionAll(near.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("links"))
        out = least.join(roots.toDF("rep", "root").join(links, "rep", "full_outer"), "rep", "left")
        out = out.select("doc_id", F.coalesce("root", "rep").alias("group_id"), (F.col("doc_id") > F.col("rep")).alias("exact"), F.coalesce("links", F.lit(0)).alias("links"))
        return materialize(out.select("doc_id", "group_id", "exact", (F.col("doc_id") == F.col("group_id")).alias("keep"), "links"), "near-groups", keep=True)


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs without all but the document of least doc_id of each group; columns as given.

    Rows with a null doc_id or text stay. Of rows that share the doc_id that stays, those with its least text stay, once.
    """
    groups = near_duplicate_groups(docs, **options).where("not keep").select("doc_id")
    kept = lookup_join(docs, groups, ["doc_id"], "left_anti")
    again = need(docs, DOC).where("doc_id is not null and text is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    again = materialize(again, "near-repeated", keep=True)
    if again.limit(1).count() == 0:
        return kept
    text, mark = F.struct(F.md5("text"), text_key()), free_name(docs, "__text")
    told = kept.where("doc_id is not null and text is not null")
    several = lookup_join(told, again, ["doc_id"], "left_semi").withColumn(mark, text)
    best = several.groupBy(F.col("doc_id").alias("__id")).agg(F.min(mark).alias("__best"))
    single = several.join(best, (F.col("doc_id") == F.col("__id")) & (F.col(mark) == F.col("__best"))).select(docs.columns).dropDuplicates(["doc_id"])
    return lookup_join(told, again, ["doc_id"], "left_anti").unionByName(single).unionByName(kept.where("doc_id is null or text is null"))
