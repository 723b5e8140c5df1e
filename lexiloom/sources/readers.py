"""Readers and writers of the text formats of lexicons, corpora and maps."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import charmap
from ..functions.atoms import clean_wikitext
from ..operators import corpus
from ..plans.storage import running

_LINES = 4 << 20
"""Bytes of unpacked lines that a worker hands on at once."""
BLANK = r"[\t\n\r\f\x{0B} ]+"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, value): the lines of text files, numbered in each file from 0; for lexicon files, each read by one task."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))
    return whole


def char_types(spark: SparkSession, path: str) -> DataFrame:
    """(ch, kind) of a type map: `-%TYPE` lines head the characters that follow; the last assignment of a character counts."""
    rows = lines(spark, path).where("value <> ''")
    head = F.when(F.col("value").startswith("-%"), F.trim(F.substr("value", F.lit(3))))
    typed = rows.withColumn("kind", F.last(head, ignorenulls=True).over(Window.partitionBy("path").orderBy("line_no"))).where(~F.col("value").startswith("-%"))
    chars = typed.select("line_no", "kind", F.posexplode(F.split("value", "")).alias("i", "ch")).where("ch <> '' and kind is not null")
    return chars.groupBy("ch").agg(F.max_by("kind", F.struct("line_no", "i")).alias("kind"))


def write_char_types(rows: DataFrame, width: int = 96) -> str:
    """The text of a type map of (ch, kind): types in a fixed order, characters by code point, lines of `width`; a driver-side file of some thousand characters."""
    by: dict[str, list[str]] = {}
    for r in rows.select("ch", "kind").collect():
        by.setdefault(r["kind"], []).append(r["ch"])
    order = [t for t in charmap.TYPES if t in by] + sorted(set(by) - set(charmap.TYPES))
    body = {t: "".join(sorted(by[t])) for t in order}
    return "".join(f"-%{t}\n" + "".join(body[t][i : i + width] + "\n" for i in range(0, len(body[t]), width)) for t in order)


def confusables(spark: SparkSession, path: str) -> DataFrame:
    """(variant, canonical) of a JSON object canonical -> [variants]; a value that isn't an array is an error."""
    pairs = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("canonical", "listed"))
    parsed = F.from_json("listed", "array<string>")
    checked = F.when(parsed.isNotNull() & F.col("listed").startswith("["), parsed).otherwise(F.raise_error(F.concat(F.lit("not an array: "), "canonical")).cast("array<string>"))
    return pairs.select(F.explode(checked).alias("variant"), "canonical")


def char_readings(spark: SparkSession, path: str) -> DataFrame:
    """(ch, syllables) of lines `U+HEX: a,b #comment`; blanks and repeats go, code points that aren't characters are skipped."""
    rows = lines(spark, path).select(F.regexp_extract("value", r"^\s*U\+([0-9A-Fa-f]+)\s*:([^#]*)", 1).alias("hex"), F.regexp_extract("value", r"^\s*U\+([0-9A-Fa-f]+)\s*:([^#]*)", 2).alias("listed")).where("hex <> ''")
    code = F.conv("hex", 16, 10).cast("long")
    ok = (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    spelt = F.array_distinct(F.filter(F.transform(F.split("listed", ","), lambda x: F.trim(x)), lambda x: x != ""))
    return rows.where(ok).select(char.alias("ch"), spelt.alias("syllables")).where(F.size("syllables") > 0)


def phrase_readings(spark: SparkSession, path: str) -> DataFrame:
    """(word, syllables) of lines `WORD: syl syl`; a later line of a word counts."""
    rows = lines(spark, path).where(F.col("value").contains(":"))
    word = F.trim(F.substring_index("value", ":", 1))
    spelt = F.filter(F.split(F.regexp_extract("value", "^[^:]*:(.*)$", 1), BLANK), lambda x: x != "")
    return rows.select(word.alias("word"), spelt.alias("syllables"), "line_no").where("word <> ''").groupBy("word").agg(F.max_by("syllables", "line_no").alias("syllables"))


def label_infos(spark: SparkSession, path: str) -> DataFrame:
    """(label, idx, info) of lines `LABEL#float`; others are skipped; a repeated label has the index and number of its last line."""
    rows = lines(spark, path).where(F.col("value").contains("#")).select("line_no", F.trim(F.substring_index("value", "#", 1)).alias("label"), F.trim(F.substring_index("value", "#", -1)).try_cast("double").alias("info")).where("info is not null")
    numbered = rows.withColumn("idx", F.row_number().over(Window.orderBy("line_no")) - 1)
    return numbered.groupBy("label").agg(F.max("idx").alias("idx"), F.max_by("info", "line_no").alias("info"))


def vocabulary_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(token): the first field of each line."""
    return lines(spark, path).select(F.split(F.trim("value"), r"[\t ]")[0].alias("token")).where("token <> ''").distinct()


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(word, labels) of lines `<L>,<L>:WORD`; # lines and blank ones are skipped, one without a colon is an error; a word's labels unite."""
    rows = lines(spark, path).withColumn("value", F.trim("value")).where("value <> '' and value not like '#%'")
    word = F.when(F.col("value").contains(":"), F.regexp_extract("value", "^[^:]*:(.*)$", 1)).otherwise(F.raise_error(F.concat(F.lit("no colon: "), "value")))
    labels = F.transform(F.split(F.substring_index("value", ":", 1), ","), lambda x: F.regexp_replace(F.trim(x), "^<|>$", ""))
    return corpus.label_dictionary(rows.select(F.trim(word).alias("word"), F.explode(labels).alias("label")).where("label <> ''"))


def bigram_files(spark: SparkSession, single: str, union: str) -> tuple[DataFrame, DataFrame]:
    """Valid unigrams and bigrams of the two tab-separated files."""
    from ..operators.ngram import valid_bigrams, valid_unigrams

    words = valid_unigrams(lines(spark, single))
    return words, valid_bigrams(lines(spark, union), words)


def conllu(spark: SparkSession, path: str) -> DataFrame:
    """(path, sent, tokens): sentences of ten-column files as arrays of (word, pos); comments, ranges and empty nodes are skipped."""
    blocks = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split(F.regexp_replace("value", "\r\n", "\n"), "\n[ \t]*\n")).alias("sent", "block"))
    rows = F.transform(F.filter(F.split("block", "\n"), lambda x: x.rlike("^[0-9]+\t")), lambda x: F.split(x, "\t"))
    tokens = F.transform(F.filter(rows, lambda x: F.size(x) == 10), lambda x: F.struct(x[1].alias("word"), x[3].alias("pos")))
    return blocks.select("path", "sent", tokens.alias("tokens")).where(F.size("tokens") > 0)


def tagged_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, tokens) of lines of word/tag fields."""
    return corpus.gold_of_lines(lines(spark, path).where(F.trim("value") != "")).select("path", "line_no", "tokens")


def _text_of(value: Column, field: str) -> Column:
    whole = F.trim(value)
    told = F.get_json_object(whole, f"$['{field}']")
    parsed = F.try_parse_json(whole)
    kind = F.schema_of_variant(parsed)
    inner = F.schema_of_variant(F.try_variant_get(parsed, f"$.{field}", "variant"))
    return F.when(kind == "STRING", F.try_variant_get(parsed, "$", "string")).when(inner == "STRING", told)


def _unpacked(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import zstandard

    for batch in rows:
        for path, content in zip(batch["path"], batch["content"]):
            stream = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True), "utf-8", "replace", newline="\n")
            while lines_ := stream.readlines(_LINES):
                yield pd.DataFrame({"path": path, "value": lines_})


def input_texts(spark: SparkSession, paths: Sequence[str], field: str = "text", kind: str = "text") -> DataFrame:
    """(path, text) of lines of text or JSON (kind json): bare strings, or a field of objects; blank, malformed and other lines are skipped. Paths may end in .zst."""
    parts = []
    for path in paths:
        if path.endswith(".zst"):
            parts.append(spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_unpacked, "path string, value string"))
        else:
            parts.append(spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    text = _text_of(F.col("value"), field) if kind == "json" else F.trim(F.regexp_replace("value", r"[\r\n]+$", ""))
    return every.where(F.trim("value") != "").select("path", text.alias("text")).where("text <> ''")


def wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    """(title, ns, text) of the pages of an XML dump that are articles and no redirects."""
    pages = spark.read.format("xml").option("rowTag", "page").schema("title string, ns int, redirect struct<_title:string>, revision struct<text:struct<_VALUE:string>>").load(path)
    return pages.where("ns = 0 and redirect is null").select("title", "ns", F.col("revision.text._VALUE").alias("text")).where("text <> ''")


def wiki_texts(spark: SparkSession, path: str, least: int = 1, most: int = 1 << 30) -> DataFrame:
    """(title, part, text): the visible paragraphs of a dump's articles that have from `least` to `most` characters; write them with the option compression."""
    parts = wiki_pages(spark, path).select("title", F.posexplode(clean_wikitext(F.col("text"))).alias("part", "text"))
    return parts.where(F.length("text").between(least, most))


def map_items(spark: SparkSession, path: str) -> DataFrame:
    """(id, tags) of the nodes of a map in XML, for `places_of_tags`; nodes without tags are left out."""
    nodes = spark.read.format("xml").option("rowTag", "node").schema("_id long, tag array<struct<_k:string,_v:string>>").load(path)
    known = F.filter("tag", lambda t: t["_k"].isNotNull())
    return nodes.where("size(tag) > 0").select(F.col("_id").alias("id"), F.map_from_entries(F.array_distinct(F.transform(known, lambda t: F.struct(t["_k"].alias("k"), t["_v"].alias("v"))))).alias("tags"))


def divisions(spark: SparkSession, path: str) -> DataFrame:
    """Rows (name, province, city, area, town) of a CSV with a header, with or without a byte order mark; names that are empty or have a hyphen go."""
    rows = spark.read.csv(path, header=True, encoding="UTF-8")
    rows = rows.toDF(*[c.lstrip("﻿") for c in rows.columns])
    return rows.where("name <> '' and name not like '%-%'")


def place_names(spark: SparkSession, path: str) -> DataFrame:
    """(name): the first tab field of lines, of two characters or more."""
    return lines(spark, path).where("value not like '#%'").select(F.trim(F.split("value", "\t")[0]).alias("name")).where(F.length("name") >= 2)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def write_shards(rows: DataFrame, path: str, records: int) -> None:
    """Compressed JSON lines, at most `records` a file."""
    rows.write.option("maxRecordsPerFile", records).option("compression", "gzip").json(path)


def write_byte_shards(lines: DataFrame, path: str, limit: int, order: Sequence[str]) -> None:
    """Lines (line, order columns) as compressed text in folders part=..., a new one where the next line and its line break would pass `limit` bytes, by the
    running sum of bytes in order: a folder holds the lines that begin within its stretch of `limit` bytes."""
    sized = lines.withColumn("__bytes", (F.octet_length("line") + 1).cast("long"))
    placed = running(sized, [], list(order), {"__before": "__bytes"}, "shards")
    parts = placed.select(F.floor(F.col("__before") / limit).alias("part"), F.col("line").alias("value"), *[F.col(c).alias(f"__o_{c}") for c in order])
    parts.repartition("part").sortWithinPartitions("part", *[f"__o_{c}" for c in order]).select("part", "value").write.partitionBy("part").option("compression", "gzip").text(path)


def save_dictionary(entries: DataFrame, path: str) -> None:
    """A dictionary (word, labels) as Parquet, sorted by word within files, so that files say which words they can hold."""
    entries.select("word", "labels").repartitionByRange("word").sortWithinPartitions("word").write.mode("errorifexists").option("compression", "zstd").parquet(path)


def load_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(word, labels) as saved."""
    return spark.read.schema("word string, labels array<string>").parquet(path)


def repack(spark: SparkSession, source: str, goal: str, files: int) -> None:
    """A saved table rewritten into so many files; source and goal must differ."""
    if source.rstrip("/") == goal.rstrip("/"):
        raise ValueError("source and goal are the same")
    spark.read.parquet(source).repartition(files).write.option("compression", "zstd").parquet(goal)


def save_model(words: DataFrame, pairs: DataFrame, path: str) -> None:
    """A bigram model's counts (word, freq) and (l, r, freq) as Parquet."""
    words.select("word", "freq").write.option("compression", "zstd").parquet(f"{path}/words")
    pairs.select("l", "r", "freq").write.option("compression", "zstd").parquet(f"{path}/pairs")


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema("word string, freq long").parquet(f"{path}/words"), spark.read.schema("l string, r string, freq long").parquet(f"{path}/pairs")


def manifest(rows: DataFrame) -> DataFrame:
    """(reason, n) of kept (null reason) and rejected rows, the most first."""
    return rows.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def tag_counts(rows: DataFrame) -> DataFrame:
    """(pos, n) of the annotations of kept rows (annotation, reason), the most first."""
    return rows.where("reason is null").select(F.explode("annotation").alias("a")).groupBy(F.col("a.pos").alias("pos")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pos")
