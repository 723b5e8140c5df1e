"""Codes for atoms and labels, and training tables over spans and graphs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.atoms import number_pieces
from ..plans.storage import running, ship
from . import kernel
from .ngram import BigramModel

SHARD = 65_536
"""Consecutive ids that one sequential task takes."""
ROWS = 1_000
"""Texts whose tokens are projected at a time."""
SPECIAL = tuple(f"[{x}]" for x in "PAD UNK CLS SEP MASK SPACE".split())


def vocabulary(tokens: DataFrame) -> DataFrame:
    """(token, code): distinct non-empty tokens in byte order, coded after the special ones; numbered by ranges, so no task sees them all."""
    one = tokens.where("token <> ''").select("token").distinct().withColumn("__one", F.lit(1).cast("long"))
    # Spark orders strings by their bytes, so the token itself is the order.
    return running(one, [], ["token"], {"code": "__one"}, "vocabulary").select("token", (F.col("code") + len(SPECIAL)).alias("code"))


def pieces(images: Column, kinds: Column) -> Column:
    """The pieces of each atom: numbers of more than three digits in groups of three, English words as a whole with a leading mark, all else as it is."""
    one = lambda x, k: F.when((k == "NUM") & x.rlike("^[0-9]+$"), number_pieces(x)).when(k == "ENG", F.array(F.concat(F.lit("▁"), F.lower(x)))).otherwise(F.array(x))
    return F.zip_with(images, kinds, one)


class Subwords:
    """Parts of English words by the cheapest path over pieces of a vocabulary, with the costs of a bigram model of pieces."""

    def __init__(self, model: BigramModel, shortest: int = 4, longest: int = 50):
        self.model, self.shortest, self.longest = model, shortest, longest
        self.widest = max((len(w) for w in model.words), default=0)

    def parts(self, word: str) -> list[str]:
        """Words of fewer than `shortest` or more than `longest` bytes, and those the vocabulary can't spell, stay whole; all are in lower case with a leading mark."""
        whole = "▁" + word.lower()
        if not self.shortest <= len(whole.encode()) <= self.longest:
            return [whole]
        spans = [(s, e) for s in range(len(whole)) for e in range(s + 1, min(len(whole), s + self.widest) + 1) if whole[s:e] in self.model.words]
        text = lambda i: whole[slice(*spans[i])] if 0 <= i < len(spans) else None
        cost = lambda u, v: 0.0 if v == len(spans) else self.model.distance(text(u), text(v))
        return [text(i) for i in kernel.viterbi(len(whole), spans, cost)] or [whole]


def subwords(words: DataFrame, model: BigramModel) -> DataFrame:
    """(word, pieces) of distinct words (word)."""
    engine = Subwords(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([engine.parts(w) for w in batch.column(0).to_pylist()], pa.list_(pa.string()))], ["word", "pieces"])

    ship(words.sparkSession)
    return words.select("word").where("word is not null").distinct().mapInArrow(run, "word string, pieces array<string>")


def encode(atoms: DataFrame, codes: DataFrame, english: DataFrame | None = None) -> DataFrame:
    """(doc_id, idx, code, atom_pos) of atom arrays (doc_id, images, ctypes and, if given, masked): [SEP] first at -1, [CLS] last at -2.

    Masked atoms are [MASK], white space is [SPACE]. English words have the parts that english (word, pieces) gives, or are one piece. A piece that
    codes (token, code) lacks takes the code of its first character if it is punctuation, else that of its type, else [UNK].
    """
    masked = F.col("masked") if "masked" in atoms.columns else F.transform("images", lambda x: F.lit(False))
    zipped = F.arrays_zip(pieces(F.col("images"), F.col("ctypes")).alias("p"), F.col("ctypes").alias("k"), F.col("images").alias("i"), masked.alias("m"))
    rows = atoms.select("doc_id", F.posexplode(zipped).alias("atom_pos", "x"))
    rows = rows.select("doc_id", "atom_pos", F.col("x.k").alias("kind"), F.col("x.m").alias("m"), F.col("x.i").alias("image"), F.when(F.col("x.m") | (F.col("x.k") == "EMPTY"), F.array(F.lit(""))).otherwise(F.col("x.p")).alias("p"))
    if english is not None:
        parts = english.select(F.col("word").alias("__w"), F.col("pieces").alias("__p"))
        rows = rows.join(parts, (rows["kind"] == "ENG") & (rows["image"] == parts["__w"]), "left").withColumn("p", F.when(F.col("m"), F.col("p")).otherwise(F.coalesce("__p", "p")))
    rows = rows.select("doc_id", "atom_pos", "kind", "m", F.posexplode("p").alias("sub", "piece"))
    short = F.when(F.col("kind") == "POS", F.substr(F.trim("piece"), F.lit(1), F.lit(1)))
    typed = codes.where("token like '[%]'").select(F.col("token").alias("tt"), F.col("code").alias("tc"))
    marks = codes.where("length(token) = 1").select(F.col("token").alias("mt"), F.col("code").alias("mc"))
    coded = rows.withColumn("short", short).join(codes, F.col("piece") == codes["token"], "left").join(marks, F.col("short") == F.col("mt"), "left")
    coded = coded.join(typed, F.concat(F.lit("["), F.col("kind"), F.lit("]")) == F.col("tt"), "left")
    code = F.when(F.col("m"), 4).when(F.col("kind") == "EMPTY", 5).otherwise(F.coalesce("code", "mc", "tc", F.lit(1)))
    body = coded.select("doc_id", "atom_pos", "sub", code.alias("code"))
    ends = atoms.select("doc_id", F.explode(F.array(F.struct(F.lit(-1).alias("atom_pos"), F.lit(3).alias("code"), F.lit(0).alias("o")), F.struct(F.lit(-2).alias("atom_pos"), F.lit(2).alias("code"), F.lit(2).alias("o")))).alias("e"))
    every = body.select("doc_id", "atom_pos", "sub", "code", F.lit(1).alias("o")).unionByName(ends.select("doc_id", "e.atom_pos", F.lit(0).alias("sub"), "e.code", "e.o"))
    order = Window.partitionBy("doc_id").orderBy("o", "atom_pos", "sub")
    return every.select("doc_id", (F.row_number().over(order) - 1).alias("idx"), "code", "atom_pos")


def syllable_codes(chars: DataFrame) -> DataFrame:
    """(syllable, code): the distinct syllables of character readings (ch, syllables) in order, coded from 4; 3 is an unknown one."""
    rows = chars.select(F.explode("syllables").alias("syllable")).where("syllable <> ''").distinct()
    return rows.withColumn("code", F.row_number().over(Window.orderBy("syllable")) + 3)  # a language has some thousand syllables


def reading_code(words: DataFrame, codes: DataFrame) -> DataFrame:
    """words (id, feat, reading) with code: feat if it isn't negative, else that of the reading, else 3."""
    known = codes.select(F.col("syllable").alias("__s"), F.col("code").alias("__c"))
    return words.join(known, words["reading"] == known["__s"], "left").withColumn("code", F.when(F.col("feat") >= 0, F.col("feat")).otherwise(F.coalesce("__c", F.lit(3)))).drop("__s", "__c")


def decode(codes: DataFrame, table: DataFrame) -> DataFrame:
    """codes with token; '' for what isn't in the table."""
    special = table.sparkSession.createDataFrame(list(enumerate(SPECIAL)), "code int, token string")
    known = special.unionByName(table.select(F.col("code").cast("int").alias("code"), "token"))
    return codes.join(known, "code", "left").withColumn("token", F.coalesce("token", F.lit("")))


def label_code(labels: DataFrame, info: DataFrame) -> DataFrame:
    """(id, code) of (id, labels): the place in info (label, idx, info) of the label of most information, after the special codes; the first by name on a tie, 1 if unknown."""
    rows = labels.select("id", F.explode_outer("labels").alias("label")).join(info, "label", "left")
    best = rows.groupBy("id").agg(F.min_by(F.struct("idx"), F.struct(-F.coalesce("info", F.lit(0.0)), F.col("label"))).alias("b"))
    return best.select("id", F.coalesce(F.col("b.idx") + len(SPECIAL), F.lit(1)).alias("code"))


def piece_bounds(encoded: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(doc_id, atom_pos, first, last): the inclusive piece range of each atom. With sizes (doc_id, n_atoms) an atom without a piece is an error."""
    found = encoded.where("atom_pos >= 0").groupBy("doc_id", "atom_pos").agg(F.min("idx").alias("first"), F.max("idx").alias("last"))
    if sizes is None:
        return found
    every = sizes.where("n_atoms > 0").select("doc_id", F.explode(F.sequence(F.lit(0), F.col("n_atoms") - 1)).alias("atom_pos"))
    checked = F.coalesce("first", F.raise_error(F.concat(F.lit("no piece for atom "), F.col("atom_pos").cast("string"), F.lit(" of "), F.col("doc_id").cast("string"))).cast("int"))
    return every.join(found, ["doc_id", "atom_pos"], "left").select("doc_id", "atom_pos", checked.alias("first"), "last")


def spans(atoms: DataFrame, shortest: int, longest: int) -> DataFrame:
    """(doc_id, st, et): every span of `shortest` to `longest` atoms of (doc_id, n_atoms), made in place."""
    starts = atoms.where(F.col("n_atoms") >= shortest).select("doc_id", "n_atoms", F.explode(F.sequence(F.lit(0), F.col("n_atoms") - shortest)).alias("st"))
    return starts.select("doc_id", "st", F.explode(F.sequence(F.col("st") + shortest, F.least(F.col("n_atoms"), F.col("st") + longest))).alias("et"))


def span_samples(every: DataFrame, gold: DataFrame, known: DataFrame) -> DataFrame:
    """every span with label (it is gold) and valid (gold or a dictionary candidate)."""
    key = ["doc_id", "st", "et"]
    marked = every.join(gold.select(*key, F.lit(True).alias("g")), key, "left").join(known.select(*key, F.lit(True).alias("k")), key, "left")
    return marked.select(*key, F.col("g").isNotNull().alias("label"), (F.col("g").isNotNull() | F.col("k").isNotNull()).alias("valid"))


def span_classes(every: DataFrame, gold: DataFrame, classes: Sequence[str]) -> DataFrame:
    """every span (doc_id, st, et) with class: 0 for no word, else the place of gold's label (doc_id, st, et, label) in classes, from 1; labels that aren't listed are no word."""
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label"))
    best = gold.groupBy("doc_id", "st", "et").agg(F.min("label").alias("label"))
    return every.join(best, ["doc_id", "st", "et"], "left").select("doc_id", "st", "et", F.coalesce(place, F.lit(0)).cast("long").alias("class"))


def graph_samples(candidates: DataFrame, sizes: DataFrame, gold: DataFrame, longest: int, filler: int = 0, shortest: int = 2) -> tuple[DataFrame, DataFrame]:
    """Nodes (doc_id, node, st, et, type) and edges (doc_id, src, dst, gold) for training a decider.

    Nodes are candidates (doc_id, st, et, type), every span of `shortest` to `longest` atoms that none has, typed `filler`, and gold words
    (doc_id, st, et, type; a null type takes the least one of the span). Node 0 is the head (type 3), the last one the tail (type 2); the others go in order of
    (st, et, type). An edge joins what follows each other, and is gold if it joins neighbours of the gold path. sizes: (doc_id, n_atoms).
    """
    key = ["doc_id", "st", "et"]
    known = candidates.select(*key, "type").distinct()
    missing = spans(sizes, shortest, longest).join(known.select(*key).distinct(), key, "left_anti").withColumn("type", F.lit(filler))
    base = known.unionByName(missing.select(*key, "type"))
    least = base.groupBy(*key).agg(F.min("type").alias("least"))
    told = gold.select(*key, "type").join(least, key, "left").select(*key, F.coalesce("type", "least", F.lit(filler)).alias("type"))
    inner = base.unionByName(told).distinct()
    held = sizes.where("n_atoms > 0")
    ends = held.select("doc_id", F.lit(0).alias("st"), F.lit(0).alias("et"), F.lit(3).alias("type"), F.lit(-1).alias("o")).unionByName(held.select("doc_id", F.col("n_atoms").alias("st"), (F.col("n_atoms") + 1).alias("et"), F.lit(2).alias("type"), F.lit(1).alias("o")))
    every = inner.withColumn("o", F.lit(0)).unionByName(ends)
    nodes = every.withColumn("node", (F.row_number().over(Window.partitionBy("doc_id").orderBy("o", "st", "et", "type")) - 1).cast("long"))
    path = told.withColumn("o", F.lit(0)).unionByName(ends).join(nodes.select(*key, "type", "o", "node"), [*key, "type", "o"])
    after = Window.partitionBy("doc_id").orderBy("o", "st", "et")
    steps = path.select("doc_id", F.col("node").alias("src"), F.lead("node").over(after).alias("dst")).where("dst is not null").withColumn("gold", F.lit(True))
    left = nodes.where("o < 1").select("doc_id", F.col("node").alias("src"), F.when(F.col("o") < 0, 0).otherwise(F.col("et")).alias("at"))
    right = nodes.where("o >= 0").select("doc_id", F.col("node").alias("dst"), F.col("st").alias("at"))
    edges = left.join(right, ["doc_id", "at"]).join(steps, ["doc_id", "src", "dst"], "left").select("doc_id", "src", "dst", F.coalesce("gold", F.lit(False)).alias("gold"))
    return nodes.select("doc_id", "node", "st", "et", "type"), edges


def within_length(items: DataFrame, length: Column, most: int, order: Sequence[str], first: int | None = None) -> DataFrame:
    """items of at most `most` pieces, then the first ones in order, if a number is given."""
    kept = items.where(length <= most)
    return kept if first is None else kept.orderBy(*order).limit(first)


def _ends(parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, code points up to and with the part) of each part of lists."""
    row = np.repeat(np.arange(len(parts)), pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False))
    total = np.cumsum(pc.fill_null(pc.utf8_length(parts.flatten()), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = np.searchsorted(row, np.arange(len(parts)))
    return row, total - np.append(0, total)[first][row]


def _projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
        ids, tokens, images = (batch.column(batch.schema.get_field_index(c)) for c in ("text_id", "tokens", "images"))
        (row, end), (atom_row, atom_end) = _ends(tokens), _ends(images)
        width = max(end.max(initial=0), atom_end.max(initial=0)) + 1  # rows lie end to end, so one search does for all
        wanted, known = row * width + end, atom_row * width + atom_end
        at = np.searchsorted(known, wanted)
        if (np.append(known, -1)[at] != wanted).any():
            raise ValueError("a token ends inside an atom")
        stop = at - np.searchsorted(atom_row, row) + 1
        start = np.append(0, stop[:-1])[: len(stop)]
        start[np.append(True, row[1:] != row[:-1])[: len(row)]] = 0
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(start), pa.array(stop)], ["text_id", "st", "et"])


def gold_projection(rows: DataFrame) -> DataFrame:
    """(text_id, st, et): the atom spans of gold tokens (text_id, tokens: array of strings, images: the atoms of the joined text); a token end inside an atom is an error.

    Null or empty tokens give no rows. Ends are running lengths within a row, found by one sorted search a batch, so nothing is joined.
    """
    ship(rows.sparkSession)
    kind = rows.schema["text_id"].dataType.simpleString()
    return rows.select("text_id", "tokens", "images").mapInArrow(_projected, f"text_id {kind}, st long, et long")


def padded(values: Column, width: Column, filler: Column) -> Column:
    """An array filled up to a width."""
    return F.slice(F.concat(values, F.array_repeat(filler, F.greatest(width - F.size(values), F.lit(0)).cast("int"))), 1, width)


def edge_batches(graphs: DataFrame, target: int, size: int, least: int = 0, most: int | None = None, shard: Column | None = None) -> DataFrame:
    """(shard, graph_id, batch): graphs (graph_id, n_edges, ...) in order of graph_id, a batch closing before the graph that would take it
    beyond `target` edges or `size` graphs; graphs of fewer than `least` or more than `most` edges are dropped.

    The rule is sequential, so each shard runs in one task, over two narrow columns. Without a shard column SHARD consecutive ids are one.
    """
    kept = graphs.where(F.col("n_edges") >= least)
    kept = kept.where(F.col("n_edges") <= most) if most else kept

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("graph_id", kind="stable", ignore_index=True)
        batch, edges, held, out = 0, 0, 0, []
        for n in rows["n_edges"].tolist():
            if held and (edges + n > target or held >= size):
                batch, edges, held = batch + 1, 0, 0
            edges, held = edges + n, held + 1
            out.append(batch)
        rows["batch"] = out
        return rows[["shard", "graph_id", "batch"]]

    narrow = kept.select((F.floor(F.col("graph_id") / SHARD) if shard is None else shard).cast("long").alias("shard"), F.col("graph_id").cast("long").alias("graph_id"), F.col("n_edges").cast("long").alias("n_edges"))
    return narrow.groupBy("shard").applyInPandas(run, "shard long, graph_id long, batch long")


def byte_shards(lines: DataFrame, limit: int) -> DataFrame:
    """(id, part, shard) of lines (id, line): a new shard begins where the next line and its line break would pass `limit` bytes, whole lines over the limit having
    one of their own; SHARD consecutive ids are a part, whose shards are numbered from 0."""
    sized = lines.select(F.col("id").alias("graph_id"), (F.octet_length("line") + 1).alias("n_edges"))
    return edge_batches(sized, limit, 1 << 62).select(F.col("graph_id").alias("id"), F.col("shard").alias("part"), F.col("batch").alias("shard"))
