"""Column functions over tokens and labels: part of speech, readings, address parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .charmap import CJK, char_class

_TAGS = {
    "a": "ADJ", "d": "ADV", "n": "NOUN", "m": "NUM", "v": "VERB", "p": "ADP", "u": "AUX PART", "c": "CCONJ SCONJ", "r": "DET PRON", "nz": "PROPN", "w": "PUNCT SYM", "xc": "X",
}
SHORT = {f"POS_{long}": short for short, names in _TAGS.items() for long in names.split()} | {f"POS_{t}": t for t in "f s t nr ns nt nw nz vd vn ad an q xc n v a d m r p c u w".split()}
FALLBACK = (("DATE", "t"), ("DIGIT", "m"), ("NUM", "m"), ("POS", "w"), ("SYMBOLS", "w"), ("ENG", "xc"), ("CJK", "xc"))
TONED = "üêāáǎàēéěèīíǐìōóǒòūúǔùǖǘǚǜńňǹḿ"
READING = f"^[a-z{TONED}]+([ \\t\\n]+[a-z{TONED}]+)*$"
KINDS = tuple("province city district street road component poi division".split())


def _lookup(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def select_pos(labels: Column) -> Column:
    """One short tag for a set of labels: that of the first POS label, else one by type of character, else xc."""
    first = F.array_min(F.filter(labels, lambda x: x.startswith("POS_")))
    out = F.when(first.isNotNull(), F.coalesce(F.try_element_at(_lookup(SHORT), first), F.lower(F.substr(first, F.lit(5)))))
    for label, tag in FALLBACK:
        out = out.when(F.array_contains(labels, label), tag)
    return out.otherwise("xc")


def reading(labels: Column) -> Column:
    """The first label that is a reading with tone marks; null if none is."""
    return F.array_min(F.filter(labels, lambda x: x.rlike(READING)))


def readings(words: DataFrame, phrases: DataFrame, chars: DataFrame, non_cjk: str | None = None) -> DataFrame:
    """words (text_id, pos, word) with reading: the phrase's if it has one syllable a character, else the first of each character if all have one, else non_cjk.

    phrases (word, syllables) and chars (ch, syllables) are joined by equality; words are grouped back by (text_id, pos).
    """
    size = F.length("word")
    whole = phrases.where(F.size("syllables") == F.length("word")).select(F.col("word").alias("phrase"), F.array_join("syllables", " ").alias("whole"))
    first = chars.where(F.size("syllables") > 0).select("ch", F.col("syllables")[0].alias("syllable"))
    singles = words.select("text_id", "pos", F.posexplode(F.filter(F.split("word", ""), lambda c: c != "")).alias("i", "ch")).where(F.col("ch").rlike(f"^[{char_class(CJK)}]"))
    spelt = singles.join(first, "ch").groupBy("text_id", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "syllable"))), lambda x: x["syllable"]), " ").alias("spelt"), F.count("*").alias("known"))
    joined = words.join(whole, (words["word"] == whole["phrase"]) & (size > 1), "left").join(spelt, ["text_id", "pos"], "left")
    chosen = F.coalesce("whole", F.when(F.col("known") == size, F.col("spelt")), F.lit(non_cjk))
    return joined.select("text_id", "pos", "word", chosen.alias("reading"))


def reading_line(tokens: Column, separator: str = " ", keep_others: bool = True, other: str | None = None) -> Column:
    """The readings of tokens (text, labels) as one line; a token without one gives `other`, or if that is null its text, or nothing unless keep_others."""
    told = F.transform(tokens, lambda t: F.coalesce(reading(t["labels"]), F.lit(other), t["text"] if keep_others else F.lit(None)))
    return F.array_join(F.filter(told, lambda x: x.isNotNull()), separator)


def reading_tokens(tokens: Column, other: str | None = None) -> Column:
    """tokens as structs text, reading (or `other`), st, et, labels."""
    return F.transform(tokens, lambda t: F.struct(t["text"].alias("text"), F.coalesce(reading(t["labels"]), F.lit(other)).alias("reading"), t["st"].alias("st"), t["et"].alias("et"), t["labels"].alias("labels")))


def address_kind(labels: Column) -> Column:
    """The display kind of an address token, by priority."""
    out = F.when(F.lit(False), None)
    for kind in KINDS:
        out = out.when(F.array_contains(labels, f"ADDR_{kind.upper()}"), kind)
    return out.otherwise("unknown")


def address_parts(tokens: Column) -> Column:
    """kind -> texts in order, from an array of tokens (text, labels)."""
    kinds = F.array_distinct(F.transform(tokens, lambda t: address_kind(t["labels"])))
    return F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.transform(F.filter(tokens, lambda t: address_kind(t["labels"]) == k), lambda t: t["text"])))


def last_place(tokens: Column) -> Column:
    """The last point of interest of an address; null without one."""
    return F.try_element_at(F.transform(F.filter(tokens, lambda t: address_kind(t["labels"]) == "poi"), lambda t: t["text"]), F.lit(-1))


def texts_of(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: t["text"])


def register_functions(spark: SparkSession) -> None:
    """normalize, squeeze and fold as SQL functions (Python ones are for SQL text only; use the columns elsewhere)."""
    from .charmap import normal_map

    table = str.maketrans(normal_map())
    spark.udf.register("lexi_normalize", lambda s: None if s is None else s.translate(table), StringType())
