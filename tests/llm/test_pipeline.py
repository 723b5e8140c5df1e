"""The pipeline against brute force, and every stage on hard cases."""

from itertools import combinations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexiloom.llm import decontaminate, line_dedup, near_dedup, queries

from .cases import DOCS, clashing, frame, hard, prose, rows
from .test_dedup import lcs_blocks, shingle_set
from .test_search import ITEMS, matches_by_hand, near_by_hand


def write(spark, folder, docs, labels=(), items=()):
    spark.createDataFrame(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(items), ITEMS).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def corpus():
    docs = {i: prose(i, 40 + i % 30) for i in range(260)}
    for i in range(200, 220):
        docs[i] = " ".join(f"{w}###" for w in docs[i].split())
    passage = prose(900, 60)
    for i in (30, 40, 50):
        head, *rest = docs[i].split("\n")
        docs[i] = "\n".join([head, passage, *rest])
    docs[60] = docs[20]
    changed = docs[21].split(" ")
    for k in range(0, len(changed), 12):
        changed[k] = f"Z{k}"
    docs[61] = " ".join(changed)
    items = [(1, prose(700, 18)), (2, prose(701, 18)), (3, docs[200][:40])]
    docs[70] += "\n" + items[0][1]
    docs[71] += "\n" + items[1][1].replace("\n", " ")
    return docs, items


def by_hand(docs, items):
    left = {i: t for i, t in docs.items() if "###" not in t}
    seen, cleaned = [], {}
    for i, t in left.items():
        own = t.split("\n")
        words = [len(x.split()) for x in own]
        gone = set(range(len(own))) if own in seen else {k for other in seen for k in lcs_blocks(other, own, words, line_dedup.BLOCK_WORDS)}
        seen.append(own)
        text = "\n".join(x for k, x in enumerate(own) if k not in gone)
        if text.strip():
            cleaned[i] = text
    sets = {i: shingle_set(t) for i, t in cleaned.items()}
    root = {i: i for i in cleaned}
    for a, b in combinations(sorted(cleaned), 2):
        if len(sets[a] & sets[b]) >= near_dedup.THRESHOLD * len(sets[a] | sets[b]):
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = {k: new if v == old else v for k, v in root.items()}
    kept = [(i, t) for i, t in cleaned.items() if root[i] == i]
    leaked = {m[0] for m in matches_by_hand(kept, items, decontaminate.PHRASE)} | {k[0] for k in near_by_hand(kept, items)}
    from pathlib import Path

    from lexiloom.llm import packing

    size = packing.token_counter(corpus_pipeline.TOKENIZER, Path(corpus_pipeline.TOKENIZER).read_text(encoding="utf-8"))
    return {i: int(size(pa.array([t]))[0]) for i, t in kept if i not in leaked}


def test_pipeline_against_brute_force(spark, tmp_path):
    docs, items = corpus()
    labels = [(i, int(not 200 <= i < 220), 0) for i in docs]
    folder = write(spark, tmp_path, [(i, t, "en", "s", len(t)) for i, t in docs.items()], labels, items)
    out = corpus_pipeline.run(spark, folder)
    got = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.sum("tokens").alias("n")).collect()}
    want = by_hand(docs, items)
    assert got == want and not {60, 61, 70, 71, 200} & set(want) and {20, 21, 30, 40, 50} <= set(want) and want[40] < want[30]
    assert out.count() == len(want)


def test_stages_are_the_ones_asked_for():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{n}" for n in range(1, 11)]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_each_stage_on_hard_cases(spark, tmp_path, name, stage):
    folder = write(spark, tmp_path, hard(), [(1, 1, 0), (None, None, None)], [(1, None), (None, "x")])
    docs = frame(spark, hard())
    out = stage(spark, docs, folder)
    if name != "packing":
        assert out.dtypes == docs.dtypes
        assert {1, 2, 4, 5, 11, 13} <= {r["doc_id"] for r in out.collect()}
        more = stage(spark, clashing(docs), folder)
        assert rows(more.select(docs.columns)) == rows(out) and more.columns == clashing(docs).columns
    else:
        assert {r["doc_id"] for r in out.collect()} == {1, 2, 3, 7, 8, 9, 10, 11, 12, 13, 14, -(2**62)}  # white space and marks are tokens
    assert stage(spark, docs.limit(0), folder).count() == 0


def test_empty_pipeline(spark, tmp_path):
    assert corpus_pipeline.run(spark, write(spark, tmp_path, [])).count() == 0


def test_stages_repeat_themselves(spark, tmp_path):
    docs, items = corpus()
    folder = write(spark, tmp_path, [(i, t, "en", "s", len(t)) for i, t in list(docs.items())[:80]], [(1, 1, 0)], items)
    first, second = (rows(corpus_pipeline.run(spark, folder)) for _ in range(2))
    assert first == second
