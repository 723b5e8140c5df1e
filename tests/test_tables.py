"""Statistics, corpus tools, evaluation, encoders, readers, the stream and the registered queries."""

import math
import zipfile

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import annotate
from lexiloom.operators import corpus, encoders, evaluate, ngram
from lexiloom.plans import storage
from lexiloom.sources import readers
from lexiloom.streaming import ingest


def test_model_by_hand():
    m = ngram.BigramModel({"ab": 3, "c": 1}, {("ab", "c"): 2, ("c", "ab"): 1, ("zz", "c"): 9})
    assert m.d == 1 / 3 and m.h == {"ab": 2, "c": 1} and m.k == {"c": 1, "ab": 1}
    assert m.unigram("ab") == 4 / 6 and m.unigram(None) == 1 / 6
    assert m.given("ab", "c") == pytest.approx((2 - 1 / 3) / 2 + 1 / 3 * 1 / 2 * 0.5)
    kept = 0.8 * 0.5 + 0.2 * m.char_given("b", "a")
    assert m.given("ab", "ab") == pytest.approx(1 / 3 * 1 / 2 * kept)
    assert m.unknown("777") == 0.02 * 0.55**2 and m.unknown("") == 1e-15
    assert m.distance(None, None) == 0 and m.distance(None, "ab") == -math.log(4 / 6)


def test_score_table_agrees_with_the_model(spark):
    pairs = [("a", "b", 3), ("a", "c", 1), ("b", "c", 2), ("c", "a", 1)]
    got = {(r["l"], r["r"]): r["nll"] for r in ngram.score_pairs(*[spark.createDataFrame(pairs, "l string, r string, freq long")] * 2).collect()}
    m = ngram.BigramModel({"a": 5, "b": 5, "c": 5}, {(a, b): n for a, b, n in pairs})
    assert got == {(a, b): pytest.approx(m.distance(a, b)) for a, b, _ in pairs}


def test_count_files(spark, tmp_path):
    (tmp_path / "u").write_text("ab\t3\tX\nc\t1\n\nz\t0\nbad\n")
    (tmp_path / "b").write_text("ab-c\t2\nab-c\t5\nc-zz\t1\na-b-c\t1\nc-ab\t1\tx\n")
    words, pairs = readers.bigram_files(spark, str(tmp_path / "u"), str(tmp_path / "b"))
    assert dict(words.collect()) == {"ab": 3, "c": 1} and [tuple(r) for r in pairs.collect()] == [("ab", "c", 5)]
    (tmp_path / "u").write_text("ab\t3\nab\t1\n")
    with pytest.raises(Exception, match="repeated word"):
        ngram.valid_unigrams(readers.lines(spark, str(tmp_path / "u"))).collect()


def test_formats(spark, tmp_path):
    def file(name, text):
        (tmp_path / name).write_text(text, encoding="utf-8")
        return str(tmp_path / name)

    assert {r["ch"]: r["kind"] for r in readers.char_types(spark, file("t", "-%A\nxy\n\n-%B\nyz\n")).collect()} == {"x": "A", "y": "B", "z": "B"}
    assert readers.write_char_types(spark.createDataFrame([("b", "POS"), ("a", "POS"), ("1", "ENG")], "ch string, kind string"), 1) == "-%POS\na\nb\n-%ENG\n1\n"
    assert {tuple(r) for r in readers.confusables(spark, file("c.json", '{"a": ["á", "à"]}')).collect()} == {("á", "a"), ("à", "a")}
    with pytest.raises(Exception, match="not an array"):
        readers.confusables(spark, file("d.json", '{"a": "á"}')).collect()
    assert {r["ch"]: r["syllables"] for r in readers.char_readings(spark, file("p", "U+91CD: zhòng, chóng,zhòng,  #重\nU+D800: x\nU+1F600: y\n")).collect()} == {"重": ["zhòng", "chóng"], "😀": ["y"]}
    assert {r["word"]: r["syllables"] for r in readers.phrase_readings(spark, file("q", "重庆: x y\n重庆: chóng  qìng\n")).collect()} == {"重庆": ["chóng", "qìng"]}
    assert {r["label"]: (r["idx"], r["info"]) for r in readers.label_infos(spark, file("l", "A#1.5\nskip\nB#2\nA#3\n")).collect()} == {"A": (2, 3.0), "B": (1, 2.0)}
    assert {r["word"]: r["labels"] for r in readers.dictionary(spark, file("e", "# c\n<A>,<B>:x y\n\n<C>:x y\n")).collect()} == {"x y": ["A", "B", "C"]}
    with pytest.raises(Exception, match="no colon"):
        readers.dictionary(spark, file("f", "oops\n")).collect()
    assert [[tuple(t) for t in r["tokens"]] for r in readers.conllu(spark, file("g", "# c\n1-2\tx\n1\ta\ta\tN\t_\t_\t_\t_\t_\t_\n2.1\tq\tq\tN\t_\t_\t_\t_\t_\t_\n2\tb\tb\tV\t_\t_\t_\t_\t_\t_\n\n1\tc\tc\tN\t_\t_\t_\t_\t_\t_\n")).orderBy("sent").collect()] == [[("a", "N"), ("b", "V")], [("c", "N")]]
    assert [tuple(t) for t in readers.tagged_lines(spark, file("h", "a/b/N c/V\n")).first()["tokens"]] == [("a/b", "N"), ("c", "V")]
    with pytest.raises(Exception, match="no slash"):
        readers.tagged_lines(spark, file("i", "abc\n")).collect()
    assert [r["text"] for r in readers.input_texts(spark, [file("j.jsonl", '{"text": "a"}\n"b"\n{"text": 3}\n{bad\n\n{"other": "x"}\n')], kind="json").collect()] == ["a", "b"]
    assert {tuple(r) for r in readers.divisions(spark, file("k.csv", "﻿name,province,city,area,town\nX,1,,,\nA-B,1,,,\n,2,,,\n")).select("name", "province").collect()} == {("X", "1")}
    wiki = "<mediawiki><page><title>T</title><ns>0</ns><revision><text>hi</text></revision></page><page><title>R</title><ns>0</ns><redirect title=\"T\"/><revision><text>r</text></revision></page><page><title>U</title><ns>1</ns><revision><text>u</text></revision></page></mediawiki>"
    assert [r["title"] for r in readers.wiki_pages(spark, file("w.xml", wiki)).collect()] == ["T"]
    assert [r["name"] for r in readers.place_names(spark, file("m", "# c\n公园\tx\n园\n")).collect()] == ["公园"]


def test_compressed_texts(spark, tmp_path):
    zstandard = pytest.importorskip("zstandard")
    (tmp_path / "x.zst").write_bytes(zstandard.ZstdCompressor().compress("one\n\ntwo\n".encode()))
    assert [r["text"] for r in readers.input_texts(spark, [str(tmp_path / "x.zst")]).collect()] == ["one", "two"]


def test_annotation_rules(spark):
    kind = "id int, text string, a array<struct<word:string,pos:string>>"
    rows = spark.createDataFrame([(1, "ab c", [("ab", "n"), ("c", "v")]), (2, "ab c", [("ab", "n")]), (3, "a", [("a", "n")]), (4, "a b c d e f", [("abcdef", "n")]), (5, "a / c", [("a", "n"), ("/c", "v")])], kind)
    assert [r[0] for r in rows.orderBy("id").select(corpus.rejection(F.col("text"), F.col("a"), 2, 5)).collect()] == [None, "alignment", "too_short", "too_long", "invalid_word"]
    cleaned = rows.limit(1).select(corpus.canonical(F.array(F.struct(F.lit(" a\tb ").alias("word"), F.lit("n").alias("pos")), F.struct(F.lit(" ").alias("word"), F.lit("x").alias("pos")))).alias("c")).first()["c"]
    assert [tuple(c) for c in cleaned] == [("ab", "n")]


def test_long_sentences_are_cut_between_atoms(spark):
    out = corpus.split_long(spark.createDataFrame([(1, "aa bb, cc dd ee ff gg. Next one! 一二三四五"), (2, None), (3, "")], "doc_id long, text string"), 4)
    pieces = [r["piece"] for r in out.orderBy("doc_id", "part").collect()]
    assert pieces[:2] == ["aa bb,", "cc dd ee ff"] and all(len(p.replace(",", " ,").split()) <= 5 for p in pieces) and "一二三四" in pieces


def test_first_wins_and_leaks(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (4, "z"), (5, "z")], "id int, digest string")
    held = spark.createDataFrame([("y",), ("z",), ("z",)], "digest string")
    assert {r["id"]: r["reason"] for r in corpus.leak_filter(rows, held, ["id"]).collect()} == {1: None, 2: "evaluation_leak", 3: "duplicate", 4: "evaluation_leak", 5: "evaluation_leak"}
    assert corpus.leak_filter(rows.limit(0), held, ["id"]).count() == 0


def test_tags_and_labels(spark):
    row = spark.range(1).select(corpus.map_tag(F.lit("LOC")), corpus.map_tag(F.lit("??")), corpus.map_tag(F.lit("nt"), True), corpus.namespaced(F.lit("<n>")), corpus.namespaced(F.lit("")), annotate.reading(F.array(F.lit("ma3"), F.lit("mā"), F.lit("N")))).first()
    assert tuple(row) == ("POS_ns", "POS_X", "POS_t", "POS_n", "POS_X", "mā")
    assert corpus.FROM_SHORT == {v: k for k, v in corpus.TO_SHORT.items()}
    info = corpus.label_information(spark.createDataFrame([("a", 1.0), ("b", 2.0)], "label string, info double"), spark.createDataFrame([("a", 3), ("q", 9)], "label string, n long"))
    assert dict(info.collect()) == {"a": pytest.approx(-math.log(4 / 5)), "b": pytest.approx(-math.log(1 / 5))}
    old = corpus.label_information(spark.createDataFrame([("a", 1.0)], "label string, info double"), spark.createDataFrame([], "label string, n long"))
    assert dict(old.collect()) == {"a": 1.0}


def test_divisions_and_places(spark):
    rows = spark.createDataFrame([(1, "浙江", "33", "", "", ""), (2, "杭州", "33", "01", "", ""), (3, "西湖", "33", "01", "06", ""), (4, "三墩镇", "33", "01", "06", ""), (5, "a-b", "33", "", "", "")], "id int, name string, province string, city string, area string, town string")
    paths = corpus.division_paths(rows)
    assert {r["name"]: (r["level"], r["path"]) for r in paths.collect()}["三墩镇"] == (4, ["浙江", "杭州", "西湖", "三墩镇"])
    words, pairs = corpus.location_counts(paths, spark.createDataFrame([("街道",)], "name string"), spark.createDataFrame([("公园",), ("公园",)], "name string"))
    assert dict(words.collect())["公园"] == 6 and {(r["l"], r["r"]): r["freq"] for r in pairs.collect()}["浙江", "杭州"] == 30
    items = spark.createDataFrame([(1, {"name": "Park", "name:zh": "公园", "leisure": "park"}), (2, {"name": "公园", "shop": "x"}), (3, {"name": "x", "shop": "y"}), (4, {"name": "Road"})], "id int, tags map<string,string>")
    assert [tuple(r) for r in corpus.places_of_tags(items).collect()] == [("公园", "leisure=park")]


def test_evaluation_edges(spark):
    none = spark.createDataFrame([], "gold array<int>, predicted array<int>")
    assert tuple(evaluate.boundary_scores(none).select("p", "r", "f1", "exact", "n").first()) == (0, 0, 0, 0, 0)
    two = spark.createDataFrame([(1, "d", [("a", "n")]), (2, "e", [("b", "n")])], "sequence int, digest string, tokens array<struct<word:string,pos:string>>")
    with pytest.raises(Exception, match="misaligned"):
        evaluate.consensus(two, two.where("sequence = 1")).collect()
    routed = evaluate.route(spark.createDataFrame([(1, 0.5, 1.0, 0.6, 1.0), (2, 0.9, 0.5, 0.9, 0.55), (3, 0.9, 0.9, 0.7, 0.7), (4, 0.7, 0.1, 0.9, 0.9)], "sequence int, a_f1 double, a_typed double, b_f1 double, b_typed double"))
    assert [r["choice"] for r in routed.orderBy("sequence").collect()] == ["reject", "ambiguous", "a", "b"]
    flat = spark.createDataFrame([(1, "a/n b/v"), (2, "a/zzz"), (3, "/n"), (4, "word")], "id int, t string").select("id", evaluate.parse_flat(F.col("t")).alias("x")).orderBy("id").collect()
    assert [tuple(t) for t in flat[0]["x"]["tokens"]] == [("a", "POS_NOUN"), ("b", "POS_VERB")] and [f["x"]["reason"] for f in flat] == [None, "format", "format", "format"]
    same = spark.range(2000).select(F.col("id").alias("sequence"), F.lit(True).alias("same"))
    assert 300 < evaluate.identity_sample(same).count() < 500


def test_codes(spark):
    rows = spark.createDataFrame([(1, ["Hello", "1234567", "中", "?"], ["ENG", "NUM", "CJK", "POS"])], "doc_id long, images array<string>, ctypes array<string>")
    codes = spark.createDataFrame([("▁hello", 6), ("567", 7), ("[NUM]", 8), ("中", 9)], "token string, code int")
    out = encoders.encode(rows, codes).orderBy("idx").collect()
    assert [(r["code"], r["atom_pos"]) for r in out] == [(3, -1), (6, 0), (8, 1), (8, 1), (7, 1), (9, 2), (1, 3), (2, -2)]
    bounds = encoders.piece_bounds(encoders.encode(rows, codes))
    assert {r["atom_pos"]: (r["first"], r["last"]) for r in bounds.collect()} == {0: (1, 1), 1: (2, 4), 2: (5, 5), 3: (6, 6)}
    assert [r["token"] for r in encoders.decode(spark.createDataFrame([(3,), (9,), (77,)], "code int"), codes).orderBy("code").collect()] == ["[SEP]", "中", ""]
    info = spark.createDataFrame([("A", 0, 1.0), ("B", 1, 2.0), ("C", 2, 2.0)], "label string, idx int, info double")
    got = encoders.label_code(spark.createDataFrame([(1, ["A", "C", "B"]), (2, ["Q"]), (3, [])], "id int, labels array<string>"), info)
    assert dict(got.collect()) == {1: 7, 2: 1, 3: 1}
    graphs = spark.createDataFrame(list(enumerate([2, 4, 6, 7, 11])), "graph_id long, n_edges long")
    assert [(r["graph_id"], r["batch"]) for r in encoders.edge_batches(graphs, 10, 4, 3, 10).orderBy("graph_id").collect()] == [(1, 0), (2, 0), (3, 1)]
    assert [r["shard"] for r in encoders.byte_shards(spark.createDataFrame([(1, "aaa"), (2, "b"), (3, "cccccccc"), (4, "d")], "id long, line string"), 6).orderBy("id").collect()] == [0, 0, 1, 2]
    with pytest.raises(Exception, match="inside an atom"):
        encoders.gold_projection(spark.createDataFrame([(1, ["a", "bc"], ["ab", "c"])], "text_id long, tokens array<string>, images array<string>")).collect()
    assert spark.range(1).select(encoders.padded(F.array(F.lit(1)), F.lit(3), F.lit(0)).alias("p")).first()["p"] == [1, 0, 0]


def test_stream(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "one two three"), ("2024-01-01 00:01:00", "one  two three"), ("2024-01-01 00:02:00", "held out text"), ("2024-01-01 00:30:00", "a b c d"), ("2024-01-01 00:31:00", "x")]
    spark.createDataFrame(rows, "at string, text string").select(F.to_timestamp("at").alias("at"), "text").write.parquet(str(tmp_path / "in"))
    held = spark.createDataFrame([("held out text",)], "t string").select(corpus.digest(F.col("t")).alias("digest"))
    out = ingest.clean_stream(ingest.read_texts(spark, str(tmp_path / "in")), held, 2, 10)
    job = out.writeStream.format("memory").queryName("cleaned").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    job.awaitTermination(120)
    assert {r["text"] for r in spark.table("cleaned").collect()} == {"one two three", "a b c d"}


def test_lookup_join_beyond_broadcast(spark, monkeypatch):
    big = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "k int, __r_k string")
    small = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string")
    want = {(1, "a", "x"), (None, "b", "y"), (3, "c", None)}
    assert {tuple(r) for r in storage.lookup_join(big, small, ["k"]).collect()} == want
    monkeypatch.setattr(storage, "BROADCAST_BYTES", -1)
    assert {tuple(r) for r in storage.lookup_join(big, small, ["k"]).collect()} == want


def test_scratch_tables_go(spark):
    with storage.scratch(spark):
        gone = storage.materialize(spark.range(3), "gone")
        kept = storage.materialize(spark.range(3), "kept", keep=True)
        assert gone.count() == 3
    assert kept.count() == 3 and storage.materialize(spark.range(2), "free").count() == 2
    with pytest.raises(Exception):
        gone.count()


def test_package_travels(spark):
    storage.ship(spark)
    assert storage._shipped[spark.sparkContext] and zipfile.is_zipfile(storage._shipped[spark.sparkContext])


DATA = "/root/testdata/sf0.001"


def test_registered_queries_match_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from pathlib import Path

    from lexiloom.plans import catalog

    if not Path(DATA).exists():
        pytest.skip("no tables")
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    clean = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    for name, sql in catalog.SQL.items():
        df = catalog.QUERIES[name](spark, DATA)
        columns = sorted(df.columns)
        listed = ", ".join(columns)
        assert clean(tuple(r) for r in df.select(*columns).collect()) == clean(con.execute(f"select {listed} from ({sql})").fetchall()), name
    for name in set(catalog.QUERIES) - set(catalog.SQL):
        df = catalog.QUERIES[name](spark, DATA)
        assert sorted(map(repr, df.collect())) == sorted(map(repr, catalog.QUERIES[name](spark, DATA).collect())), name


def test_gold_projection_against_running_lengths(spark):
    import random

    draw, given, want = random.Random(7), [], []
    for k in range(40):
        atoms = ["é" * draw.randint(1, 3) for _ in range(draw.randint(0, 30))]
        cuts = sorted(draw.sample(range(1, len(atoms)), draw.randint(0, len(atoms) - 1))) if len(atoms) > 1 else []
        spans = list(zip([0, *cuts], [*cuts, len(atoms)])) if atoms else []
        given.append((k, ["".join(atoms[a:b]) for a, b in spans], atoms))
        want += [(k, a, b) for a, b in spans]
    given += [(40, None, ["a"]), (41, None, None), (42, [], []), (43, ["中文" * 40_000, "x"], [*("中文" * 40_000), "x"])]
    want += [(43, 0, 80_000), (43, 80_000, 80_001)]
    kinds = "text_id long, tokens array<string>, images array<string>"
    assert sorted(tuple(r) for r in encoders.gold_projection(spark.createDataFrame(given, kinds).repartition(3)).collect()) == sorted(want)
    assert encoders.gold_projection(spark.createDataFrame([], kinds)).count() == 0
    with pytest.raises(Exception, match="inside an atom"):
        encoders.gold_projection(spark.createDataFrame([(1, ["a"], None)], kinds)).collect()


def test_results_are_deleted_on_demand(spark):
    from pathlib import Path

    with storage.scratch(spark):
        inner = storage.materialize(spark.range(3), "inner")
        outer = storage.materialize(spark.range(4), "outer", keep=True)
        folders = [Path(df.inputFiles()[0].removeprefix("file://")).parent for df in (inner, outer)]
        assert all(f.exists() for f in folders)
    assert [f.exists() for f in folders] == [False, True] and outer.count() == 4
    kept = list(storage._left)
    storage._left[:] = [x for x in kept if x[1].endswith(folders[1].name)]
    storage.clear()
    assert not folders[1].exists()
    storage._left[:] = [x for x in kept if not x[1].endswith(folders[1].name)]
