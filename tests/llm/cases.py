"""Hard cases that every operator meets."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("digest", "bands", "level", "stratum", "group", "bin", "tokens", "lines", "words", "gone", "__gone", "terms", "node", "band", "rep", "cutoff", "keep", "good", "predicted", "kind", "rank", "first", "row")
"""Names that the operators use within."""


def prose(seed: int, words: int, vocabulary: int = 4000) -> str:
    """Sentences of made-up words, a line each."""
    rng = random.Random(seed)
    out, left = [], words
    while left > 0:
        n = min(left, rng.randint(6, 14))
        out.append(" ".join("".join(rng.choice("aeioulnrstmk") for _ in range(2 + w % 6)) + str(w % 7) for w in (rng.randrange(vocabulary) for _ in range(n))).capitalize() + ".")
        left -= n
    return "\n".join(out)


def hard(seed: int = 1) -> list[tuple]:
    """Null ids, texts and languages, empty and wordless texts, copies, repeated rows, one id with two texts, a very long text."""
    a, b = prose(seed, 80), prose(seed + 1, 80)
    return [
        (1, a, "en", "s", 0), (2, b, "en", None, None), (3, a, None, "s", 0), (4, None, "en", "s", 0), (None, a, "en", "s", 0), (None, None, None, None, None),
        (5, "", "en", "s", 0), (6, "", "fr", "s", 0), (7, " \n\t ", "en", "s", 0), (8, "!!! ...", "en", "s", 0), (9, b, "en", "s", 0), (9, b, "en", "s", 0),
        (10, a + "\nMore.", "en", "s", 0), (10, prose(seed + 2, 60), "en", "s", 0), (11, "word", "en", "s", 0), (12, "word", "en", "s", 0),
        (13, prose(seed + 3, 60_000, 30_000), "en", "s", 0), (14, "中文 \U0001f600 İstanbul ß é", "zh", "s", 0), (-(2**62), prose(seed + 4, 30), "en", "s", 0),
    ]


def frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, DOCS)


def clashing(docs: DataFrame) -> DataFrame:
    """docs with extra columns whose names the operators use within."""
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit(f"x-{c}").alias(c) for c in CLASH if c not in docs.columns])


def rows(df: DataFrame) -> list[tuple]:
    """The rows as plain tuples, sorted."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
