"""Evaluation: boundaries, spans, thresholds, grids, annotator consensus and answers to parse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .corpus import FROM_SHORT, lookup


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where there is nothing."""
    return F.coalesce(part / F.nullif(whole.cast("double"), F.lit(0.0)), F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))


def boundary_scores(rows: DataFrame) -> DataFrame:
    """One row p, r, f1, exact, n over (gold, predicted), arrays of inner boundaries of a text; both sides stay in their row."""
    hit = F.sum(F.size(F.array_intersect("gold", "predicted")))
    p, r = ratio(hit, F.sum(F.size(F.array_distinct("predicted")))), ratio(hit, F.sum(F.size(F.array_distinct("gold"))))
    same = F.sum((F.array_sort(F.array_distinct("gold")) == F.array_sort(F.array_distinct("predicted"))).cast("long"))
    return rows.agg(p.alias("p"), r.alias("r"), ratio(same, F.count("*")).alias("exact"), F.count("*").alias("n")).withColumn("f1", f1(F.col("p"), F.col("r")))


def mode_agreement(rows: DataFrame) -> DataFrame:
    """(l, r, agree): the share of texts on which two modes have equal boundaries, over (doc_id, mode, boundaries)."""
    a, b = rows.toDF("doc_id", "l", "x"), rows.toDF("doc_id", "r", "y")
    return a.join(b, "doc_id").groupBy("l", "r").agg(F.avg((F.col("x") == F.col("y")).cast("double")).alias("agree"))


def span_scores(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row p, r, f1, pos_accuracy over spans (sent, st, et, pos): precision, recall, and how many shared spans have the same tag."""
    a, b = gold.withColumnRenamed("pos", "gold_pos"), predicted.withColumnRenamed("pos", "predicted_pos")
    both = a.join(b, ["sent", "st", "et"], "full_outer").agg(
        F.count("gold_pos").alias("g"), F.count("predicted_pos").alias("q"), F.count(F.when(F.col("gold_pos").isNotNull() & F.col("predicted_pos").isNotNull(), 1)).alias("hit"), F.count(F.when(F.col("gold_pos") == F.col("predicted_pos"), 1)).alias("same")
    )
    p, r = ratio(F.col("hit"), F.col("q")), ratio(F.col("hit"), F.col("g"))
    return both.select(p.alias("p"), r.alias("r"), f1(p, r).alias("f1"), ratio(F.col("same"), F.col("hit")).alias("pos_accuracy"))


def threshold_grid(scored: DataFrame, low: int = 10, high: int = 95, step: int = 5) -> DataFrame:
    """(length, threshold, f1): the threshold of the best F1 for each span length over (length, score, positive); the higher one on a tie, 0.95 without positives.

    A row goes into one counter a threshold in place: no cross join is shuffled, only length x threshold sums.
    """
    grid = F.array(*[F.lit(t) for t in range(low, high + 1, step)])
    rows = scored.select("length", "score", "positive", F.explode(grid).alias("t")).withColumn("said", F.col("score") >= F.col("t") / 100)
    sums = rows.groupBy("length", "t").agg(F.sum((F.col("said") & F.col("positive")).cast("long")).alias("hit"), F.sum(F.col("said").cast("long")).alias("q"), F.sum(F.col("positive").cast("long")).alias("g"))
    scores = sums.withColumn("f1", F.round(f1(ratio(F.col("hit"), F.col("q")), ratio(F.col("hit"), F.col("g"))), 9))
    best = scores.withColumn("k", F.row_number().over(Window.partitionBy("length").orderBy(F.desc("f1"), F.desc("t")))).where("k = 1")
    return best.select("length", F.when(F.col("g") == 0, 0.95).otherwise(F.col("t") / 100).alias("threshold"), "f1")


def top_of_grid(scores: DataFrame, top: int) -> DataFrame:
    """The `top` settings by (f1, exact), then by the other columns."""
    rest = [c for c in scores.columns if c not in ("f1", "exact")]
    return scores.orderBy(F.desc("f1"), F.desc("exact"), *rest).limit(top)


def consensus(left: DataFrame, right: DataFrame) -> DataFrame:
    """(sequence, class) of two annotators' tables (sequence, digest, tokens: array of word, pos): accepted, pos_disagreement or hard; a sequence that only one has, or digests that differ, is an error."""
    a, b = left.toDF("sequence", "a_digest", "a"), right.toDF("sequence", "b_digest", "b")
    joined = a.join(b, "sequence", "full_outer")
    words = lambda c: F.transform(c, lambda t: t["word"])
    verdict = F.when(F.col("a") == F.col("b"), "accepted").when(words(F.col("a")) == words(F.col("b")), "pos_disagreement").otherwise("hard")
    aligned = F.coalesce(F.col("a_digest") == F.col("b_digest"), F.lit(False))
    return joined.select("sequence", F.when(aligned, verdict).otherwise(F.raise_error(F.concat(F.lit("misaligned at "), F.col("sequence").cast("string")))).alias("class"))


def by_priority(*tables: DataFrame) -> DataFrame:
    """(sequence, tokens, place): of tables (sequence, tokens) the first that has a sequence."""
    every = tables[0].select("sequence", "tokens", F.lit(0).alias("place"))
    for k, t in enumerate(tables[1:], 1):
        every = every.unionByName(t.select("sequence", "tokens", F.lit(k).alias("place")))
    return every.groupBy("sequence").agg(F.min_by("tokens", "place").alias("tokens"), F.min("place").alias("place"))


def route(rows: DataFrame, least: float = 0.65, margin: float = 0.02) -> DataFrame:
    """rows (sequence, a_f1, a_typed, b_f1, b_typed) with choice: the better of two annotators by 0.8 F1 + 0.2 typed F1; reject if neither reaches `least`, ambiguous if they are closer than `margin`."""
    score = lambda x: 0.8 * F.col(f"{x}_f1") + 0.2 * F.col(f"{x}_typed")
    gap = F.round(score("a") - score("b"), 9)
    choice = F.when(F.greatest("a_f1", "b_f1") < least, "reject").when(F.abs(gap) < margin, "ambiguous").when(gap > 0, "a").otherwise("b")
    return rows.withColumn("choice", choice)


def identity_sample(rows: DataFrame, share: float = 0.2, seed: int = 17) -> DataFrame:
    """rows (sequence, same, ...) without all but a share of those with same, drawn by a hash of the sequence, so alike on every run."""
    draw = F.pmod(F.xxhash64("sequence", F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    return rows.where(~F.col("same") | (draw < share))


def parse_answer(answer: Column, choices: tuple[str, ...]) -> Column:
    """struct(choice, reason) of an answer's first {...}: reason is json if there is none that parses and has one, choice if it isn't one of the choices, else null."""
    found = F.regexp_extract(answer, r"(?s)(\{[^{}]*\})", 1)
    choice = F.get_json_object(found, "$.choice")
    valid = F.try_parse_json(F.nullif(found, F.lit(""))).isNotNull()
    reason = F.when(~valid | choice.isNull(), "json").when(~F.coalesce(choice.isin(*choices), F.lit(False)), "choice")
    return F.struct(F.when(reason.isNull(), choice).alias("choice"), reason.alias("reason"))


def search_listing(candidates: DataFrame, top: int) -> DataFrame:
    """Candidates (doc_id, st, et, text) of each text in search order: by start, the longest first, then by text; `top` a text."""
    order = Window.partitionBy("doc_id").orderBy("st", (F.col("st") - F.col("et")), "text")
    return candidates.withColumn("k", F.row_number().over(order)).where(F.col("k") <= top)


def parse_flat(answer: Column) -> Column:
    """struct(tokens, reason) of an answer of word/tag fields: tokens (word, pos), or the reason format if a field has no word or no known tag."""
    fields = F.filter(F.split(F.trim(answer), r"[ \t\n]+"), lambda x: x != "")
    split = F.transform(fields, lambda x: F.struct(F.regexp_extract(x, "^(.*)/([^/]*)$", 1).alias("word"), lookup(FROM_SHORT, F.regexp_extract(x, "^(.*)/([^/]*)$", 2)).alias("pos")))
    good = F.forall(split, lambda t: (t["word"] != "") & t["pos"].isNotNull())
    return F.struct(F.when(good, split).alias("tokens"), F.when(~good, "format").alias("reason"))


def path_faults(rows: DataFrame, tokens: str = "tokens") -> DataFrame:
    """rows (images, tokens: text, atom_s, atom_e, ...) whose path isn't one, with fault: empty, incomplete, discontinuous or surface, the first that holds; sound rows are left out."""
    t, n = F.col(tokens), F.size("images")
    first, last = F.element_at(t, 1), F.element_at(t, -1)
    gap = F.exists(F.zip_with(F.slice(t, 1, F.size(t) - 1), F.slice(t, 2, F.size(t) - 1), lambda a, b: a["atom_e"] != b["atom_s"]), lambda x: x)
    surface = F.array_join(F.transform(t, lambda x: x["text"]), "") != F.array_join("images", "")
    fault = F.when(F.size(t) == 0, F.when(n > 0, "empty")).when((first["atom_s"] != 0) | (last["atom_e"] != n), "incomplete").when(gap, "discontinuous").when(surface, "surface")
    return rows.withColumn("fault", fault).where("fault is not null")


def changed_paths(left: DataFrame, right: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key) of texts whose boundaries differ between two runs or modes (key, tokens), or that only one has."""
    ends = lambda: F.transform("tokens", lambda t: t["atom_e"])
    a, b = left.select(key, ends().alias("a")), right.select(key, ends().alias("b"))
    return a.join(b, key, "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select(key)


def span_thresholds(scored: DataFrame, low: int = 10, high: int = 95, step: int = 5) -> DataFrame:
    """(length, threshold, f1) by two standards, over (length, score, gold, valid): precision counts spans that are valid (listed or gold), recall gold ones. Ties as in `threshold_grid`."""
    grid = F.array(*[F.lit(t) for t in range(low, high + 1, step)])
    rows = scored.select("length", "score", "gold", "valid", F.explode(grid).alias("t")).withColumn("said", F.col("score") >= F.col("t") / 100)
    count = lambda c: F.sum(c.cast("long"))
    sums = rows.groupBy("length", "t").agg(count(F.col("said") & F.col("valid")).alias("good"), count(F.col("said") & F.col("gold")).alias("hit"), count(F.col("said")).alias("q"), count(F.col("gold")).alias("g"))
    scores = sums.withColumn("f1", F.round(f1(ratio(F.col("good"), F.col("q")), ratio(F.col("hit"), F.col("g"))), 9))
    best = scores.groupBy("length").agg(F.max(F.struct("f1", "t")).alias("b"), F.max("g").alias("g"))
    return best.select("length", F.when(F.col("g") == 0, 0.95).otherwise(F.col("b.t") / 100).alias("threshold"), F.col("b.f1").alias("f1"))


def fixed_thresholds(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    """One row p, r, f1 over (length, score, gold, valid) at given thresholds (length, threshold); a length without one is an error."""
    joined = scored.join(thresholds.select("length", "threshold"), "length", "left")
    told = F.coalesce("threshold", F.raise_error(F.concat(F.lit("no threshold for length "), F.col("length").cast("string"))).cast("double"))
    rows = joined.withColumn("said", F.col("score") >= told)
    count = lambda c: F.sum(c.cast("long"))
    p, r = ratio(count(F.col("said") & F.col("valid")), count(F.col("said"))), ratio(count(F.col("said") & F.col("gold")), count(F.col("gold")))
    return rows.agg(p.alias("p"), r.alias("r")).withColumn("f1", f1(F.col("p"), F.col("r")))


def type_scores(spans: DataFrame, threshold: float) -> DataFrame:
    """One row over spans (score, predicted, label; label 0: no word): on_gold, the share of words whose type is right, and on_found, the same of words that score at the threshold."""
    word, right = F.col("label") > 0, F.col("predicted") == F.col("label")
    found = word & (F.col("score") >= threshold)
    count = lambda c: F.sum(c.cast("long"))
    return spans.agg(ratio(count(word & right), count(word)).alias("on_gold"), ratio(count(found & right), count(found)).alias("on_found"))


def covering(merged: DataFrame, gold: DataFrame) -> DataFrame:
    """merged (sequence, ...), checked to have just the sequences of gold (sequence): a missing or an extra one is an error."""
    a, b = merged.withColumn("__a", F.lit(True)), gold.select("sequence").distinct().withColumn("__b", F.lit(True))
    both = a.join(b, "sequence", "full_outer")
    bad = F.raise_error(F.concat(F.lit("not in both: "), F.col("sequence").cast("string"))).cast("boolean")
    return both.where(F.coalesce(F.col("__a") & F.col("__b"), bad)).drop("__a", "__b")


def distinct_paths(sampled: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, paths) of sampled token texts (key, words: array of strings), several rows a text: the different ones, sorted."""
    return sampled.groupBy(key).agg(F.sort_array(F.collect_set(F.array_join("words", " "))).alias("paths"))
