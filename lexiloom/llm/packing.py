"""Packing of training examples into bins under several limits at once (vector bin packing, dot-product heuristic).

An example has three sizes: tokens, segments (1, or the number of pieces that end up in the same bin) and loss-bearing
tokens. Bins are opened one at a time. Of the examples that still fit under every limit the one whose sizes, weighted by
the mean demand in each dimension, have the greatest dot product with the bin's free room goes in; when none fits the
bin is closed (Panigrahy, Talwar, Uyeda and Wieder, 2011). Examples of equal sizes are one class, so a step costs as much as there are classes.

The examples are spread by the hash of their identity over groups of about GROUP examples; the number of groups comes
from the count, so any amount is packed with the same waste (at most about one part-filled bin a group) and no worker
holds more than a group. Only identities and sizes are shuffled, never text.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import lookup_join, materialize, running, scratch
from . import textkit as tk
from .common import id_kind, need, own_id, text_key, texts

TOKENS, SEGMENTS, LOSS = 8192, 16, 6144
"""Limits of a bin: tokens (of the tokenizer that is named, or words if none is), pieces, loss-bearing tokens."""
GROUP = 4096
_PLACED = "bin long, slot int, doc_id long, digest long, piece int, start long, tokens long, loss_tokens long"


PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
"""How byte-level BPE with ranks parts a text before it merges (Radford et al., 2019)."""


def token_counter(name: str | None, content: str):
    """A function from a string column to counts: of words without a name, else of the tokens of a file of that name and content.

    A name that ends in .tiktoken holds ranks of byte sequences, merged within PATTERN; any other is a `tokenizers` file.
    """
    if name is None:
        return lambda column: np.bincount(tk.words(column).doc, minlength=len(column))
    if name.endswith(".tiktoken"):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}
        own = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda column: np.array([len(own.encode_ordinary(x or "")) for x in column.to_pylist()], dtype=np.int64)
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(content)
    t.encode_special_tokens = True
    t.no_truncation()
    return lambda column: np.array([len(e.ids) for e in t.encode_batch_fast([x or "" for x in column.to_pylist()], add_special_tokens=False)], dtype=np.int64)


def _count(tokenizer: str | None):
    """A kernel that puts a column tokens in the place of text. The driver reads the tokenizer's file, some MB, so workers need none."""
    content = "" if tokenizer is None else Path(tokenizer).read_text(encoding="utf-8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        counter = token_counter(tokenizer, content)
        for batch in batches:
            for part in tk.chunks(batch, "text"):
                at = part.schema.get_field_index("text")
                columns = [c for i, c in enumerate(part.columns) if i != at]
                names = [n for n in part.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counter(part.column(at)).astype(np.int64))], [*names, "tokens"])

    return run


def pack(sizes: np.ndarray, limits: np.ndarray) -> list[list[int]]:
    """Bins of indices. sizes: n x d, each row within the limits; ties go to the least sizes, then to the least index."""
    if not len(sizes):
        return []
    kinds, which = np.unique(sizes, axis=0, return_inverse=True)
    which = which.ravel()
    waiting = [[] for _ in kinds]
    for i in range(len(sizes) - 1, -1, -1):
        waiting[which[i]].append(i)
    left = np.array([len(w) for w in waiting])
    scaled = kinds / limits
    weight = scaled[which].mean(axis=0)
    pull = scaled * weight
    bins = []
    while left.any():
        live = np.flatnonzero(left)
        kinds, pull, left, waiting = kinds[live], pull[live], left[live], [waiting[i] for i in live]
        room, own = limits.astype(np.int64).copy(), []
        while True:
            fits = (kinds <= room).all(axis=1) & (left > 0)
            if not fits.any():
                break
            best = int(np.argmax(np.where(fits, pull @ (room / limits), -1.0)))
            own.append(waiting[best].pop())
            left[best] -= 1
            room -= kinds[best]
        bins.append(own)
    return bins


def _pack_group(limits: tuple[int, int, int]):
    cap = np.array(limits)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "digest", "copy", "piece"], kind="stable", ignore_index=True)
        sizes = np.stack([rows["tokens"], np.ones(len(rows), dtype=np.int64), rows["loss_tokens"]], axis=1)
        place = np.empty((len(rows), 2), dtype=np.int64)
        for b, own in enumerate(pack(sizes, cap)):
            for k, i in enumerate(own):
                place[i] = b, k
        rows["bin"], rows["slot"] = (key[0] << 32) + place[:, 0], place[:, 1].astype(np.int32)
        return rows[["bin", "slot", "doc_id", "digest", "piece", "start", "tokens", "loss_tokens"]]

    return run


def _place(pieces: DataFrame, tokens: int, segments: int, loss: int, group: int, name: str = "packed") -> DataFrame:
    """Bins for written pieces (doc_id, digest, copy, piece, start, tokens, loss_tokens), all within the limits."""
    groups = max(1, math.ceil(pieces.count() / group))
    at = F.pmod(F.xxhash64("doc_id", "digest", "copy", "piece"), F.lit(groups)).alias("group")
    packed = pieces.select(at, "*").groupBy("group").applyInPandas(_pack_group((tokens, segments, loss)), _PLACED.replace("doc_id long", f"doc_id {id_kind(pieces)}"))
    return materialize(packed, name, keep=True)


def _checked(*limits: int) -> None:
    if min(limits) < 1:
        raise ValueError("limits must be positive")


def pack_examples(examples: DataFrame, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, group: int = GROUP) -> DataFrame:
    """Placements of examples (doc_id, digest, tokens, loss_tokens): bin, slot, doc_id, digest, piece, start, tokens, loss_tokens.

    Each bin holds at most `tokens` tokens, `segments` rows and `loss` loss-bearing tokens. An example beyond a limit is
    cut into equal pieces, numbered from 0, start being a piece's first token; as it isn't known where its loss tokens are, they are
    spread over the pieces as evenly as can be (`pack_conversations` knows, and counts them where they are).
    Examples whose tokens are 0 or null are not placed; null or negative loss_tokens count as 0, excess ones as all tokens.
    Repeated rows are placed each. Bin numbers are unique, not consecutive. No examples give no rows. The result doesn't depend on the order of rows.
    """
    _checked(tokens, segments, loss)
    with scratch(examples.sparkSession):
        size = examples.where("tokens > 0").withColumn("loss_tokens", F.greatest(F.lit(0), F.least(F.coalesce("loss_tokens", F.lit(0)), "tokens")))
        size = size.groupBy("doc_id", "digest", "tokens", "loss_tokens").agg(F.count("*").alias("copies"))
        return _place(materialize(_even_pieces(size, tokens, loss), "pack-sizes"), tokens, segments, loss, group)


def _even_pieces(size: DataFrame, tokens: int, loss: int) -> DataFrame:
    n = F.greatest(F.ceil(F.col("tokens") / tokens), F.ceil(F.col("loss_tokens") / loss))
    cut = lambda of, k: F.floor(F.col(of) * k / F.col("n"))
    pieces = size.withColumn("n", n).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).withColumn("piece", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    span = lambda of: cut(of, F.col("piece") + 1) - cut(of, F.col("piece"))
    return pieces.select("doc_id", "digest", "copy", "piece", cut("tokens", F.col("piece")).alias("start"), span("tokens").alias("tokens"), span("loss_tokens").alias("loss_tokens"))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, **limits) -> DataFrame:
    """pack_examples over documents (doc_id, text): every token bears loss, so limit loss like tokens unless given.

    Tokens are those of a tokenizer's file at a path (see `token_counter`), or words without one. Rows with a null doc_id or text, and texts without tokens,
    are not placed. Rows that share a doc_id are told apart by digest, the hash of the text; equal rows are placed each. Other columns play no part.
    """
    base = texts(docs).select("doc_id", text_key().alias("digest"), "text")
    counted = base.mapInArrow(_count(tokenizer), f"doc_id {id_kind(docs)}, digest long, tokens long")
    limits.setdefault("loss", limits.get("tokens", TOKENS))
    return pack_examples(counted.withColumn("loss_tokens", F.col("tokens")), **limits)


def _cuts(tokens: int, loss: int):
    """Turns with their sums before (t0 tokens, l0 loss-bearing ones) to parts: a cut lies wherever the tokens, or those that bear loss, are a multiple of their limit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, bears, n, t0, l0 in zip(batch["doc_id"], batch["bears"], batch["tokens"].tolist(), batch["t0"].tolist(), batch["l0"].tolist()):
                at = t0
                while at < t0 + n:
                    borne = l0 + (at - t0) if bears else l0
                    step = min(t0 + n - at, tokens - at % tokens, loss - borne % loss if bears else n)
                    # A full count of loss tokens ends a piece where the next one that bears loss begins.
                    out.append((doc, at // tokens, borne // loss if bears else -1, borne, at, step, step if bears else 0))
                    at += step
            yield pd.DataFrame(out, columns=["doc_id", "g", "h", "borne", "start", "tokens", "loss_tokens"])

    return run


def pack_conversations(turns: DataFrame, tokenizer: str | None = None, loss_role: str = "assistant", tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, group: int = GROUP) -> DataFrame:
    """Placements, as of pack_examples, of conversations (conv_id, turn, role, text): one example each, doc_id being conv_id; the tokens of turns by loss_role bear loss.

    A conversation beyond a limit is cut where its tokens or its loss-bearing tokens, in order of turn, reach a multiple of the limit,
    so a piece's start and loss tokens are those of its own stretch. Turns with a null conv_id or text are left out, those with a null
    role bear no loss, a null turn (or a table without that column) comes first; equal turns count each.
    """
    _checked(tokens, segments, loss)
    named = need(turns, ("conv_id", "role", "text"))
    order = F.col("turn").cast("long") if "turn" in turns.columns else F.lit(None).cast("long")
    base = turns.select(own_id(turns, "conv_id").alias("doc_id"), order.alias("turn"), (F.coalesce("role", F.lit("")) == loss_role).alias("bears"), "text").where("doc_id is not null and text is not null")
    kind = id_kind(named, "conv_id")
    with scratch(turns.sparkSession):
        counted = materialize(base.withColumn("key", text_key()).mapInArrow(_count(tokenizer), f"doc_id {kind}, turn long, bears boolean, key long, tokens long").where("tokens > 0"), "pack-turns")
        borne: Column = F.when(F.col("bears"), F.col("tokens")).otherwise(0)
        sums = materialize(counted.groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.sum(borne).alias("loss_tokens")), "pack-conversations")
        fits = (F.col("tokens") <= tokens) & (F.col("loss_tokens") <= loss)
        one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
        pieces = sums.where(fits).select("doc_id", none.alias("digest"), one.alias("copy"), F.lit(0).alias("piece"), none.alias("start"), "tokens", "loss_tokens")
        large = materialize(sums.where(~fits).select("doc_id"), "pack-large")
        if large.limit(1).count():
            own = lookup_join(counted, large, ["doc_id"], "left_semi").withColumn("borne", borne)
            placed = running(own, ["doc_id"], ["turn", "bears", "key", "tokens"], {"t0": "tokens", "l0": "borne"}, "pack-sums")
            parts = placed.mapInPandas(_cuts(tokens, loss), f"doc_id {kind}, g long, h long, borne long, start long, tokens long, loss_tokens long")
            # A part without loss goes with the loss-bearing ones before it, or to the first piece of its stretch of tokens.
            parts = parts.withColumn("h", F.when(F.col("h") >= 0, F.col("h")).otherwise(F.greatest(none, F.floor((F.col("borne") - 1) / loss))))
            whole = materialize(parts.groupBy("doc_id", "g", "h").agg(F.min("start").alias("start"), F.sum("tokens").alias("tokens"), F.sum("loss_tokens").alias("loss_tokens")).withColumn("one", one), "pack-parts")
            numbered = running(whole, ["doc_id"], ["start"], {"piece": "one"}, "pack-pieces")
            pieces = pieces.unionByName(numbered.select("doc_id", none.alias("digest"), one.alias("copy"), F.col("piece").cast("int").alias("piece"), "start", "tokens", "loss_tokens"))
        return _place(materialize(pieces, "pack-pieces"), tokens, segments, loss, group)
