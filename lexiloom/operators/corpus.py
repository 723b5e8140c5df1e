"""Corpus preparation as joins, windows and aggregates: deduplication, leakage, validation, lexicons, divisions, label statistics."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import islice
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.atoms import BREAKS, CORPUS_ATOM, ENDS, squeeze
from ..plans.storage import running
from . import kernel

SPLIT_BYTES = 1 << 18
"""Text that is split at a time."""
LEVELS = ("ADDR_PROVINCE", "ADDR_CITY", "ADDR_DISTRICT", "ADDR_STREET")
TOWNS = "(办事处|民族乡|苏木|街道|镇|乡)$"
POI_TAGS = tuple("amenity shop tourism leisure office craft healthcare".split())
_BASE_TAGS = {
    "ADJ": "a b z", "ADP": "p", "ADV": "ad d", "CCONJ": "c", "NOUN": "n s nl", "NUM": "m q", "PART": "u", "PRON": "r", "PUNCT": "w wp", "VERB": "v vd vn", "X": "xc ws e o",
    "nr": "PER nr nh", "ns": "LOC ns", "nt": "ORG nt ni", "nz": "nz j i", "t": "TIME t", "f": "f nd",
}
TAGS = {tag: f"POS_{long}" for long, tags in _BASE_TAGS.items() for tag in tags.split()}
_SHORT = "NOUN n|VERB v|ADJ a|ADV d|PRON r|DET det|ADP p|CCONJ cc|SCONJ sc|PART u|AUX aux|NUM m|PUNCT w|SYM sym|INTJ e|PROPN prop|X x"
TO_SHORT = {f"POS_{a}": b for a, b in (x.split() for x in _SHORT.split("|"))} | {f"POS_{t}": t for t in ("nr", "ns", "nt", "nz", "t", "f")}
FROM_SHORT = {v: k for k, v in TO_SHORT.items()}


def lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(pairs.items()) for x in kv]), key)


def map_tag(tag: Column, dates_are_nt: bool = False) -> Column:
    """A teacher's part-of-speech tag as ours; unknown ones are POS_X."""
    return F.coalesce(lookup(TAGS | ({"nt": "POS_t"} if dates_are_nt else {}), tag), F.lit("POS_X"))


def namespaced(pos: Column, empty: str = "X") -> Column:
    """POS_ and the tag without angle brackets; an empty one is `empty`."""
    bare = F.regexp_replace(F.trim(pos), "^<|>$", "")
    bare = F.when(F.coalesce(bare, F.lit("")) == "", empty).otherwise(bare)
    return F.when(bare.startswith("POS_"), bare).otherwise(F.concat(F.lit("POS_"), bare))


def keep_first(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """rows with `first`: whether a row is the first of its key in order, which tells rows apart; null keys are equal.

    The least place of each key is a partial sum that is joined back, so a key that most rows share is in no task whole.
    """
    least = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in key]).agg(F.min(F.struct(*order)).alias("__least"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]
    joined = rows.join(least, reduce(and_, same))
    return joined.withColumn("first", F.struct(*order).eqNullSafe(F.col("__least"))).select(*rows.columns, "first")


def digest(text: Column) -> Column:
    """What texts are compared by: equal but for white space."""
    return F.md5(F.regexp_replace(text, r"[\t\n\r\f\x{0B} ]+", ""))


def leak_filter(rows: DataFrame, held_out: DataFrame, order: Sequence[str]) -> DataFrame:
    """rows (digest, ...) with reason: evaluation_leak if the digest is held out, duplicate if it came before in order, else null.

    The held-out digests are joined by equality (Catalyst broadcasts them when small); order tells rows apart, as in `keep_first`.
    """
    known = held_out.select(F.col("digest").alias("held")).distinct()
    marked = keep_first(rows, ["digest"], order)
    joined = marked.join(known, marked["digest"] == known["held"], "left")
    return joined.withColumn("reason", F.when(F.col("held").isNotNull(), "evaluation_leak").when(~F.col("first"), "duplicate")).drop("held", "first")


def canonical(annotation: Column) -> Column:
    """word/pos pairs with the white space taken out of words and empty words dropped."""
    return F.filter(F.transform(annotation, lambda a: F.struct(F.regexp_replace(a["word"], r"[\t\n\r\f\x{0B} ]+", "").alias("word"), a["pos"].alias("pos"))), lambda a: a["word"] != "")


def rejection(text: Column, annotation: Column, least: int, most: int) -> Column:
    """The first rule that an annotation breaks: alignment, too_short, too_long, invalid_word; null if none."""
    plain = lambda c: F.regexp_replace(c, r"[\t\n\r\f\x{0B} ]+", "")
    said = F.array_join(F.transform(annotation, lambda a: a["word"]), "")
    size = F.regexp_count(text, F.lit(CORPUS_ATOM))
    bad = F.exists(annotation, lambda a: (a["word"] == "") | a["word"].contains("/") | a["word"].contains("\n"))
    return F.when(plain(said) != plain(text), "alignment").when(size < least, "too_short").when(size > most, "too_long").when(bad, "invalid_word")


def split_long(texts: DataFrame, most: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, part, piece): sentences of at most `most` corpus atoms, cut at inner marks and then anywhere between atoms, in a vectorised worker."""
    atom, end, inner = re.compile(_python(CORPUS_ATOM)), re.compile(f"(?<=[{ENDS}])|\n+"), re.compile(f"(?<=[{BREAKS}])")

    first = lambda s: list(islice(atom.finditer(s), most + 1))  # noqa: E731  no more than tell whether it is too long

    def pieces(value: str) -> Iterator[str]:
        for sentence in filter(None, (s.strip() for s in end.split(value))):
            current = ""
            if len(first(sentence)) <= most:
                yield sentence
                continue
            for part in filter(None, inner.split(sentence)):
                if current and len(first(current + part)) > most:
                    yield current.strip()
                    current = ""
                current += part
                while len(found := first(current)) > most:
                    at = found[most].start()
                    yield current[:at].strip()
                    current = current[at:].strip()
            if current.strip():
                yield current.strip()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernel.chunks(batch, text, SPLIT_BYTES):
                told = [list(pieces(v)) for v in part.column(1).to_pylist()]
                size = np.array([len(x) for x in told], dtype=np.int64)
                row = np.repeat(np.arange(len(size)), size)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array((np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)), pa.array([p for x in told for p in x], pa.string())], [key, "part", "piece"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.where(F.col(text).isNotNull()).select(key, squeeze(F.col(text)).alias(text)).mapInArrow(run, f"{key} {kind}, part int, piece string")


def _python(pattern: str) -> str:
    """A pattern with x{...} escapes as Python's re has them."""
    return re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", pattern)


def merge_lexicons(counted: DataFrame, listed: DataFrame, longest: int = 8, least: int = 10) -> DataFrame:
    """(word, freq, pos): the greater frequency of (word, freq, pos) in either table; kept if counted in the corpus or listed at least `least` times, up to `longest` characters.

    A missing frequency is 1, a missing part of speech X; the corpus's comes first. One full outer join by word.
    """
    a = counted.select("word", F.col("freq").alias("a"), F.col("pos").alias("pa"), F.lit(True).alias("seen"))
    b = listed.select("word", F.coalesce("freq", F.lit(1)).alias("b"), F.col("pos").alias("pb"))
    joined = a.join(b, "word", "full_outer")
    freq = F.greatest(F.coalesce("a", F.lit(1)), F.coalesce("b", F.lit(1)))
    rows = joined.where((F.col("word") != "") & (F.length("word") <= longest) & (F.col("seen") | (F.col("b") >= least)))
    return rows.select("word", freq.cast("long").alias("freq"), F.coalesce("pa", "pb", F.lit("X")).alias("pos"))


def fitting_phrases(phrases: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Phrases (word, syllables) that the lexicon holds and that have a syllable for each character."""
    return phrases.where(F.length("word") == F.size("syllables")).join(lexicon.select("word").distinct(), "word", "left_semi")


def division_level(name: Column, city: Column, area: Column, town: Column) -> Column:
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(given(town) | name.rlike(TOWNS), 4).when(given(area), 3).when(given(city), 2).otherwise(1)


def division_paths(rows: DataFrame) -> DataFrame:
    """rows (id, name, province, city, area, town) with level and path: the names of the divisions above and, for a town, its own; the last row of a code gives its name.

    Three keyed lookups, each on an aggregate of the same small table.
    """
    levelled = rows.where("name <> '' and name not like '%-%'").withColumn("level", division_level(F.col("name"), F.col("city"), F.col("area"), F.col("town")))
    name = F.trim("name")
    out = levelled
    for level, codes in ((1, ["province"]), (2, ["province", "city"]), (3, ["province", "city", "area"])):
        names = levelled.where(F.col("level") == level).groupBy(*[F.coalesce(c, F.lit("")).alias(f"k_{c}") for c in codes]).agg(F.max_by(name, "id").alias(f"n{level}"))
        on = [F.coalesce(out[c], F.lit("")) == names[f"k_{c}"] for c in codes]
        out = out.join(names, on, "left").drop(*[f"k_{c}" for c in codes])
    own = F.when(F.col("level") == 4, name)
    path = F.array_distinct(F.array_compact(F.array("n1", "n2", "n3", own)))
    return out.select("id", "name", "level", path.alias("path"))


def location_counts(paths: DataFrame, terms: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Weighted words and bigrams: 10 a division (of its path's pairs too), 5 an address term, 3 a place."""
    words = paths.select("name", F.lit(10).alias("w")).unionAll(terms.select("name", F.lit(5))).unionAll(places.select("name", F.lit(3)))
    n = F.size("path")
    pairs = paths.where(n > 1).select(F.explode(F.arrays_zip(F.slice("path", 1, n - 1).alias("l"), F.slice("path", 2, n - 1).alias("r"))).alias("p"))
    return words.groupBy(F.col("name").alias("word")).agg(F.sum("w").alias("freq")), pairs.groupBy(F.col("p.l").alias("l"), F.col("p.r").alias("r")).agg((F.count("*") * 10).alias("freq"))


def label_dictionary(rows: DataFrame) -> DataFrame:
    """(word, labels): all labels of each word, sorted."""
    return rows.groupBy("word").agg(F.array_sort(F.collect_set("label")).alias("labels"))


def label_information(labels: DataFrame, events: DataFrame, smoothing: float = 1.0) -> DataFrame:
    """(label, info): -ln of each label's smoothed share of the events (label, n) that are labels; without any, old values (info) stay."""
    counts = events.groupBy("label").agg(F.sum("n").alias("n"))
    joined = labels.join(counts, "label", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    whole = Window.partitionBy()  # one row a label
    total, size = F.sum("n").over(whole), F.count("*").over(whole)
    fresh = -F.ln((F.col("n") + smoothing) / (total + smoothing * size))
    return joined.select("label", F.when(total > 0, fresh).otherwise(F.col("info")).alias("info"))


def ranked_characters(counts: DataFrame, known: DataFrame, least: int, top: int) -> DataFrame:
    """(ch, freq, kind, place): single characters (ch, freq, kind) that known (ch) lacks, by their greatest frequency, then by code point; `top` of them."""
    rows = counts.where((F.length("ch") == 1) & (F.col("freq") >= least) & F.col("kind").isNotNull()).groupBy("ch").agg(F.max("freq").alias("freq"), F.max_by("kind", "freq").alias("kind"))
    fresh = rows.join(known.select("ch"), "ch", "left_anti")
    best = fresh.orderBy(F.desc("freq"), F.asc("ch")).limit(top)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("freq"), F.asc("ch"))))  # top rows


def places_of_tags(items: DataFrame) -> DataFrame:
    """(name, category) of map items (id, tags): the Chinese name or else the name, of two characters or more; the first tag that counts; the first item of a name."""
    name = F.trim(F.coalesce(F.nullif(F.try_element_at("tags", F.lit("name:zh")), F.lit("")), F.try_element_at("tags", F.lit("name"))))
    category = F.coalesce(*[F.when(F.map_contains_key("tags", k), F.concat(F.lit(f"{k}="), F.try_element_at("tags", F.lit(k)))) for k in POI_TAGS])
    rows = items.select("id", name.alias("name"), category.alias("category")).where((F.length("name") >= 2) & F.col("category").isNotNull())
    return rows.groupBy("name").agg(F.min_by("category", "id").alias("category"))


def gold_of_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """lines with tokens: word/pos fields split at the last slash; a field without one is an error."""
    fields = F.filter(F.split(F.trim(F.col(value)), r"[\t ]+"), lambda x: x != "")
    bad = F.concat(F.lit("no slash in: "), F.col(value))
    checked = F.when(F.forall(fields, lambda x: x.contains("/")), fields).otherwise(F.raise_error(bad).cast("array<string>"))
    return lines.withColumn("tokens", F.transform(checked, lambda x: F.struct(F.regexp_extract(x, "^(.*)/([^/]*)$", 1).alias("word"), F.regexp_extract(x, "^(.*)/([^/]*)$", 2).alias("pos"))))


def text_of(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: t["word"]), "")


def split_sets(rows: DataFrame, held: dict[str, Sequence[str]]) -> DataFrame:
    """rows (source, digest, ...) with part: that of held (part -> sources) which has the source, else train; rows of train whose digest a held part has are leaks (part null)."""
    part = F.lit(None).cast("string")
    for name, sources in held.items():
        part = F.when(F.col("source").isin(*sources), name).otherwise(part)
    named = rows.withColumn("part", F.coalesce(part, F.lit("train")))
    kept = named.where("part <> 'train'").select(F.col("digest").alias("__held")).distinct()
    joined = named.join(kept, named["digest"] == kept["__held"], "left")
    return joined.withColumn("part", F.when((F.col("part") == "train") & F.col("__held").isNotNull(), F.lit(None)).otherwise(F.col("part"))).drop("__held")


def first_tags(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, pos): the tag of a word's first place in the corpus (word, pos, and an order column `at`), else that of the lexicon (word, pos); null tags don't count."""
    seen = words.where("pos is not null and word <> ''").groupBy("word").agg(F.min_by("pos", "at").alias("a"))
    known = lexicon.where("pos is not null and word <> ''").groupBy("word").agg(F.min("pos").alias("b"))
    return seen.join(known, "word", "full_outer").select("word", F.coalesce("a", "b").alias("pos"))


def frequency_export(words: DataFrame) -> DataFrame:
    """(word, freq) in order of word, without words that hold a hyphen, as the bigram format can't tell it from its own."""
    return words.where("word <> '' and not contains(word, '-')").select("word", "freq").orderBy("word")


def corpus_summary(tokens: DataFrame) -> DataFrame:
    """One row: sentences, words, distinct words, characters of (sent, word)."""
    return tokens.agg(F.count_distinct("sent").alias("sentences"), F.count("*").alias("words"), F.count_distinct("word").alias("types"), F.coalesce(F.sum(F.length("word")), F.lit(0)).alias("chars"))


def merge_types(counted: DataFrame, known: DataFrame) -> DataFrame:
    """(ch, kind) of a type map known (ch, kind) and typed characters (ch, kind): what is known stays, but RUSH gives way to ENG."""
    fresh = counted.where("kind is not null").groupBy("ch").agg(F.min("kind").alias("fresh"))
    joined = known.groupBy("ch").agg(F.max("kind").alias("old")).join(fresh, "ch", "full_outer")
    return joined.select("ch", F.when((F.col("old") == "RUSH") & (F.col("fresh") == "ENG"), "ENG").otherwise(F.coalesce("old", "fresh")).alias("kind"))


Teacher = Callable[[Sequence[str]], Sequence[Sequence[tuple[str, str]]]]
"""Texts to (word, tag) lists, a batch at a time."""
_SAID = "array<struct<word:string,pos:string>>"


def annotated(texts: DataFrame, teacher: Teacher, text: str = "text", out: str = "annotation") -> DataFrame:
    """texts with a column of a teacher's annotations, canonical (see `canonical`); the teacher sees a batch of texts at a time, and null texts get null."""
    kind = pa.list_(pa.struct([("word", pa.string()), ("pos", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(text)).to_pylist()
            told = iter(teacher([v for v in values if v is not None]))
            said = [None if v is None else [{"word": w, "pos": p} for w, p in next(told)] for v in values]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, kind)], [*batch.schema.names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields)
    return texts.mapInArrow(run, f"{schema}, `{out}` {_SAID}").withColumn(out, canonical(F.col(out)))


def pseudo_corpus(texts: DataFrame, held_out: DataFrame, teacher: Teacher, least: int = 3, most: int = 108, key: str = "doc_id") -> DataFrame:
    """(key, part, text, annotation, reason) of every sentence of texts (key, text): split to `most` atoms, annotated by the teacher, checked (see `rejection`),
    and rejected as a leak if its digest is among held_out (digest), as a duplicate if an accepted one came before. reason is null for what is kept.

    One plan: both views (words; word/tag), the rejects and the counts are selections of its written result.
    """
    parts = split_long(texts, most, key).withColumnRenamed("piece", "text")
    told = annotated(parts, teacher).withColumn("reason", rejection(F.col("text"), F.col("annotation"), least, most)).withColumn("digest", digest(F.col("text")))
    sound = told.where("reason is null")
    checked = leak_filter(sound.drop("reason"), held_out, [key, "part"])
    return told.where("reason is not null").select(key, "part", "text", "annotation", "reason").unionByName(checked.select(key, "part", "text", "annotation", "reason"))


def word_view(annotation: Column) -> Column:
    return F.array_join(F.transform(annotation, lambda a: a["word"]), " ")


def tagged_view(annotation: Column) -> Column:
    return F.array_join(F.transform(annotation, lambda a: F.concat(a["word"], F.lit("/"), a["pos"])), " ")


def ordered_export(rows: DataFrame, order: Sequence[str], teacher: str, most: int) -> DataFrame:
    """(sequence, digest, text, teacher, annotation, error) of rows (order columns, text, annotation): numbered from 0 in order, by ranges; annotation or error is null."""
    checked = rows.withColumn("error", rejection(F.col("text"), F.col("annotation"), 1, most)).withColumn("__one", F.lit(1).cast("long"))
    numbered = running(checked, [], list(order), {"sequence": "__one"}, "export")
    return numbered.select("sequence", digest(F.col("text")).alias("digest"), "text", F.lit(teacher).alias("teacher"), F.when(F.col("error").isNull(), F.col("annotation")).alias("annotation"), "error")


def converted(text: Column, table: dict[str, str]) -> Column:
    """Text with characters replaced one to one, as between scripts."""
    keys = sorted(k for k in table if len(k) == 1 and len(table[k]) == 1)
    return F.translate(text, "".join(keys), "".join(table[k] for k in keys))
