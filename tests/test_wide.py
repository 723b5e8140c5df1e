"""Lattices over arrays, modes and their configuration, codes, graph samples, wiki text, corpora, evaluation, saved tables."""

import random
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexiloom.functions import annotate, atoms, charmap
from lexiloom.operators import corpus, encoders, evaluate, kernel, lattice, modes, ngram
from lexiloom.operators.tokenizer import Tokenizer
from lexiloom.plans import config, storage
from lexiloom.sources import readers

KEYS = [("new york", ["A"]), ("york big", ["B"]), ("北京", ["C", "D"]), ("京大学", ["E"]), ("big apple the", ["F"]), ("the", ["T"]), ("x - y", ["H"])]


def random_texts(n=60):
    rng = random.Random(1)
    words = "new york big apple 北 京 大 学 12 7 ab Zed x-y 2026 年 3 月 km the".split()
    return [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 20, 150, 260]))) + rng.choice(["", ".", " ;"]) for _ in range(n)] + [None, ""]


def counts(texts):
    uni, bi = Counter({"newyork": 3, "北京": 3}), Counter({("newyork", "big"): 2})
    for t in texts:
        a = kernel.atomize(pa.array([t]))
        images = [t[x:y] for x, y in zip(a.st, a.et)]
        uni.update(images)
        bi.update(zip(images, images[1:]))
    return dict(uni), dict(bi)


def tables(spark, uni, bi):
    return ngram.fit(spark.createDataFrame(list(uni.items()), "word string, freq long"), spark.createDataFrame([(*k, n) for k, n in bi.items()], "l string, r string, freq long"))


@pytest.fixture(scope="module")
def model(spark):
    uni, bi = counts(random_texts()[:40])
    return ngram.BigramModel(uni, bi), tables(spark, uni, bi)


@pytest.mark.parametrize("mode", ["faster", "fast", "hybrid"])
def test_array_paths_are_those_of_the_scalar_model(mode, model):
    column, lexicon = pa.array(random_texts()), kernel.Lexicon(*zip(*KEYS))
    one = modes.Segmenter(modes.MODES[mode], lexicon, model[1].arrays(), True, 0.0, 0).tokens(column)
    assert one == modes.Segmenter(modes.MODES[mode], lexicon, model[0], True, 0.0, 0).each_tokens(column) and sum(len(x or ()) for x in one) > 3000


def test_array_costs_are_those_of_the_scalar_model(model):
    words = ["new", "newyork", "big", "unseen", "北京", "2026", "x", "é", "the", "Zq9"]
    arrays = model[1].arrays()
    text = pa.array([" ".join(words)])
    a = kernel.atomize(text)
    letters, edge = lattice.letters_of(text, a)
    n = np.arange(len(a.row))
    nodes = lattice.Nodes(n * 0, n, n + 1, letters.hash(edge[:-1], edge[1:]), edge[:-1], edge[1:], letters)
    images = [text[0].as_py()[x:y] for x, y in zip(a.st, a.et)]
    u, v = (np.array(x) for x in zip(*[p for p in product(range(-1, len(n)), repeat=2) if p != (-1, -1)]))
    want = [model[0].distance(images[i] if i >= 0 else None, images[j] if j >= 0 else None) for i, j in zip(u, v)]
    assert np.allclose(lattice.Costs(arrays, nodes).pairs(u, v), want, atol=1e-9)


@pytest.mark.parametrize("mode", ["faster", "hybrid"])
def test_joined_segmentation_gives_the_same_tokens(spark, model, monkeypatch, mode):
    rows = spark.createDataFrame(list(enumerate(random_texts())), "doc_id long, text string")
    entries = storage.materialize(modes.entries_of(spark.createDataFrame(KEYS, "word string, labels array<string>")), "entries")
    run = lambda: {r["doc_id"]: r["tokens"] for r in modes.segment(rows, mode, lexicon=entries, model=model[1] if mode == "hybrid" else None).collect()}
    cover = lambda: sorted(map(tuple, modes.cover_stats(rows, entries).collect()))
    hits = lambda: sorted((r["doc_id"], r["st"], r["et"], *r["labels"]) for r in modes.hits(rows, entries).collect())
    drawn = lambda: {r["doc_id"]: r["tokens"] for r in modes.segment(rows, "faster", lexicon=entries, temperature=100.0, seed=3).collect()}
    small, sampled = (run(), cover(), hits()), drawn()
    monkeypatch.setattr(modes, "LEXICON_BYTES", -1)
    monkeypatch.setattr(ngram, "MODEL_BYTES", -1)
    assert (run(), cover(), hits()) == small and small[2] and drawn() == sampled != small[0]


def test_lac_readings_and_neural_modes(monkeypatch):
    uni = ngram.BigramModel({"重庆": 9, "音乐": 9}, {})
    lexicon = kernel.Lexicon(["重庆", "音乐"], [["POS_ns", "POS_n", "X"], ["POS_n"]])
    lac = Tokenizer("lac", lexicon, uni, {"POS_ns": 3.0, "POS_n": 1.0})
    assert lac.lac("重庆音乐ABC,3") == [("重庆", "ns"), ("音乐", "n"), ("ABC", "xc"), (",", "w"), ("3", "m")] and lac.tokens("重庆")[0]["labels"] == ["POS_ns"]
    said = modes.Readings({"重庆": ["chóng", "qìng"], "音乐": ["yīn"]}, {"音": ["yīn"], "乐": ["lè", "yuè"], "重": ["zhòng"]})
    told = Tokenizer("pinyin", lexicon, uni, readings=said).tokens("重庆音乐重ABC")
    assert [next((x for x in t["labels"] if x.islower()), None) for t in told] == ["chóng qìng", "yīn lè", "zhòng", None]
    assert Tokenizer("pinyin", lexicon, uni, readings=said).lcut("重庆音乐") == Tokenizer("hybrid", lexicon, uni).lcut("重庆音乐")
    with pytest.raises(ValueError, match="neural.span"):
        modes.resolve("neural")
    monkeypatch.setattr(modes, "RECOGNIZERS", dict(modes.RECOGNIZERS))
    monkeypatch.setattr(modes, "DECIDERS", dict(modes.DECIDERS))
    calls = []

    def score(left, right):
        calls.append(len(left))
        return np.array([0.0 if (a is None or a.size == 2) and (b is None or b.size == 2) else 1.0 for a, b in zip(left, right)])

    modes.register("neural", decider=modes.EdgeScorer(score))
    modes.register("neural.span", recognizer=modes.span_scorer(lambda images: 0.99 if "".join(images) == "庆音" else float("nan"), threshold=0.96))
    assert Tokenizer("neural", lexicon).lcut("重庆音乐") == ["重庆", "音乐"] and len(calls) == 1
    assert "庆音" in Tokenizer("neural", lexicon).lcut("重庆音乐", every=True)
    modes.register("neural.syntax", recognizer=modes.syntax_scorer(lambda spans: [[0.05, 0.95] if "".join(s) == "音乐" else [0.9, 0.1] for s in spans], ["", "POS_n"], threshold=0.9), decider=modes.EdgeScorer(lambda left, right: [None] * len(left)))
    assert "音乐" in Tokenizer("lac-nural", None).lcut("重音乐", every=True)
    with pytest.raises(ValueError):
        modes.span_scorer(score, longest=40)


def test_tokenizer_facade():
    t = Tokenizer("faster", kernel.Lexicon(["ab cd", "cd ef"], [["P"], ["Q"]]))
    assert t.lcut("ab cd ef") == ["ab", "cdef"] and list(t.cut("")) == [] and t.tokens(None) is None and list(t.batch_cut(["x", "y z"])) == [["x"], ["y", "z"]]
    assert t.tokenize("ab cd", "search") == [("abcd", 0, 5), ("ab", 0, 2), ("cd", 3, 5)] and t.tokenize("ab") == [("ab", 0, 2)]
    assert "".join(t.sample("ab cd ef")) == "abcdef"
    for bad, error in ((lambda: t.tokenize("x", "odd"), ValueError), (lambda: t.lcut(3), TypeError), (lambda: t.lcut("x", temperature=-1), ValueError), (lambda: t.lcut(None), TypeError)):
        with pytest.raises(error):
            bad()


CONFIG = """{ // a comment
  "dservices": {"codes": {"type": "LabelEncoder", "file": "http://x/y"}},
  "recognizers": {"d": {"type": "DictWordRecognizer", "atom.mode": "true", "topn": "2", "deps": {"label.encoder": "codes"}}, "t": {"type": "TemporalRecognizer"},
     "a": {"type": "X", "deps": {"b": "b"}}, "b": {"type": "X", "deps": {"a": "a"}}, "untyped": {}, "own": {"type": "Mine"}},
  "deciders": {"h": {"type": "HybridStatDecider", "bigram.weight": "4", "length.weight": "-1", "token.penalty": "no"} /* c */},
  "modes": {"good": {"decider": "h", "recognizers": ["d", "t"]}, "circle": {"decider": "h", "recognizers": ["a"]}, "gone": {"decider": "none"}, "bad": {"recognizers": ["untyped"]}, "mine": {"recognizers": ["own"]}},
  "default.mode": "good"}"""


def test_configurations(tmp_path):
    told = config.parse(CONFIG)
    assert list(config.closure(told)) == ["h", "codes", "d", "t"] and told["dservices"]["codes"]["file"] == "http://x/y"
    assert config.mode_of(told) == modes.Mode("hybrid", ("temporal",), {"bigram": 4.0}, 2, False) and config.mode_of(told, "mine").recognizers == ("own",)
    for mode, message in (("circle", "circle"), ("gone", "no usable"), ("bad", "no usable"), ("odd", "unknown")):
        with pytest.raises(ValueError, match=message):
            config.closure(told, mode)
    with pytest.raises(ValueError):
        config.parse("[]")
    (tmp_path / "f.json").write_text("{}")
    assert config.locate("f.json", [tmp_path / "a" / "b"]) == "f.json" and config.locate("f.json", [tmp_path / "a"]) == config.locate("f.json", [tmp_path]) == str(tmp_path / "f.json")


def test_codes_of_masked_space_and_english(spark):
    rows = spark.createDataFrame([(1, ["unhappy", " ", "9", "..", "x"], ["ENG", "EMPTY", "NUM", "POS", "ENG"], [False, False, True, False, False])], "doc_id long, images array<string>, ctypes array<string>, masked array<boolean>")
    pieces = ngram.BigramModel({p: 5 for p in ("▁un", "happy", "▁unh", "appy")}, {("▁un", "happy"): 5})
    english = encoders.subwords(rows.select(F.explode("images").alias("word")), pieces)
    assert {r["word"]: r["pieces"] for r in english.collect()}["unhappy"] == ["▁un", "happy"] and encoders.Subwords(pieces).parts("Xyzq") == ["▁xyzq"]
    codes = spark.createDataFrame([("▁un", 7), ("happy", 8), (".", 9), ("[ENG]", 6)], "token string, code int")
    out = encoders.encode(rows, codes, english).orderBy("idx").collect()
    assert [(r["code"], r["atom_pos"]) for r in out] == [(3, -1), (7, 0), (8, 0), (5, 1), (4, 2), (9, 3), (6, 4), (2, -2)]
    bounds = encoders.piece_bounds(encoders.encode(rows, codes, english), rows.select("doc_id", F.size("images").alias("n_atoms")))
    assert sorted(tuple(r) for r in bounds.collect())[0] == (1, 0, 1, 2)
    with pytest.raises(Exception, match="no piece"):
        encoders.piece_bounds(encoders.encode(rows, codes, english), spark.createDataFrame([(1, 9)], "doc_id long, n_atoms int")).collect()
    syllables = encoders.syllable_codes(spark.createDataFrame([("乐", ["lè", "yuè"]), ("了", ["le", "lè"])], "ch string, syllables array<string>"))
    assert {r["syllable"]: r["code"] for r in syllables.collect()} == {"le": 4, "lè": 5, "yuè": 6}
    told = encoders.reading_code(spark.createDataFrame([(1, -1, "yuè"), (2, 9, "le"), (3, -1, "no")], "id int, feat int, reading string"), syllables)
    assert {r["id"]: r["code"] for r in told.collect()} == {1: 6, 2: 9, 3: 3}


def test_graph_samples(spark):
    sizes = spark.createDataFrame([(1, 3)], "doc_id long, n_atoms int")
    kind = "doc_id long, st int, et int, type int"
    nodes, edges = encoders.graph_samples(spark.createDataFrame([(1, 0, 1, 7), (1, 1, 2, 7), (1, 2, 3, 7), (1, 0, 2, 8)], kind), sizes, spark.createDataFrame([(1, 0, 2, None), (1, 2, 3, 9)], kind), 3, 5)
    got = [tuple(r)[1:] for r in nodes.orderBy("node").collect()]
    assert got == [(0, 0, 0, 3), (1, 0, 1, 7), (2, 0, 2, 8), (3, 0, 3, 5), (4, 1, 2, 7), (5, 1, 3, 5), (6, 2, 3, 7), (7, 2, 3, 9), (8, 3, 4, 2)]
    st, et = {n[0]: n[1] for n in got}, {n[0]: n[2] for n in got}
    want = {(u, v) for u in range(8) for v in range(1, 9) if st[v] == (0 if u == 0 else et[u])}
    assert {(r["src"], r["dst"]) for r in edges.collect()} == want and {(r["src"], r["dst"]) for r in edges.where("gold").collect()} == {(0, 2), (2, 7), (7, 8)}
    classes = encoders.span_classes(encoders.spans(sizes, 1, 2), spark.createDataFrame([(1, 0, 2, "n"), (1, 2, 3, "odd")], "doc_id long, st int, et int, label string"), ["v", "n"])
    assert {(r["st"], r["et"]): r["class"] for r in classes.collect()} == {(0, 1): 0, (0, 2): 2, (1, 2): 0, (1, 3): 0, (2, 3): 0}
    items = spark.createDataFrame([(k, "x" * k) for k in range(6)], "id int, t string")
    assert [r["id"] for r in encoders.within_length(items, F.length("t"), 4, ["id"], 3).collect()] == [0, 1, 2] and encoders.within_length(items, F.length("t"), 4, ["id"]).count() == 5


def test_wiki_text_and_atom_helpers(spark):
    text = "{{Box|a={{b|c}}}}'''Bold''' [[Page|text]] and [[plain]]<ref name=x/><ref>gone</ref> [http://a.b link].\n\n== Head ==\n{| class=x\n| cell\n|}\n* item\n[[File:x.png|thumb|a [[b]] c]]\n\n[[Category:Z]]\n\nCategory: no<!-- c -->"
    assert spark.range(1).select(atoms.clean_wikitext(F.lit(text)).alias("p")).first()["p"] == ["Bold text and plain link.", "Head", "item"]
    row = spark.createDataFrame([(["汉", "字", "A"],)], "a array<string>")
    got = row.select(atoms.joined(F.col("a"), F.lit(0), F.lit(2)), atoms.joined(F.col("a"), F.lit(2), F.lit(9)), atoms.at(F.col("a"), -1), atoms.masked(F.col("a"), F.array(F.lit(1)))).first()
    assert tuple(got) == ("汉字", "", "A", [False, True, False])
    with pytest.raises(Exception, match="no atom 5"):
        row.select(atoms.at(F.col("a"), 5)).collect()
    assert spark.range(1).select(atoms.runs_with_space(F.lit("ab , 汉  c")).alias("r")).first()["r"] == ["ab", " , ", "汉", "  ", "c"]
    assert spark.range(1).select(corpus.converted(F.lit("漢字x"), {"漢": "汉", "xx": "y"}).alias("c")).first()["c"] == "汉字x"
    tokens = F.array(F.struct(F.lit("重庆").alias("text"), F.array(F.lit("chóng qìng")).alias("labels")), F.struct(F.lit("AB").alias("text"), F.array(F.lit("ENG")).alias("labels")))
    lines = spark.range(1).select(annotate.reading_line(tokens), annotate.reading_line(tokens, "-", False), annotate.reading_line(tokens, "-", True, "?")).first()
    assert tuple(lines) == ("chóng qìng AB", "chóng qìng", "chóng qìng-?")


def test_corpora(spark):
    words = spark.createDataFrame([("a", "n", 2), ("a", "v", 1), ("b", None, 0), ("c-d", "n", 3)], "word string, pos string, at int")
    tags = {r["word"]: r["pos"] for r in corpus.first_tags(words, spark.createDataFrame([("b", "x"), ("a", "z")], "word string, pos string")).collect()}
    assert tags == {"a": "v", "b": "x", "c-d": "n"}
    assert tuple(corpus.corpus_summary(spark.createDataFrame([(1, "ab"), (1, "c"), (2, "ab")], "sent int, word string")).first()) == (2, 3, 2, 5)
    kinds = corpus.merge_types(spark.createDataFrame([("a", "ENG"), ("b", "NUM"), ("c", "POS")], "ch string, kind string"), spark.createDataFrame([("a", "RUSH"), ("b", "RUSH")], "ch string, kind string"))
    assert {r["ch"]: r["kind"] for r in kinds.collect()} == {"a": "ENG", "b": "RUSH", "c": "POS"}
    texts = spark.createDataFrame([(1, "One two three four! Held out text here!"), (2, "one two three four! One two three four!"), (3, None), (4, "a b")], "doc_id long, text string")
    held = spark.createDataFrame([("Held out text here!",)], "t string").select(corpus.digest(F.col("t")).alias("digest"))
    teacher = lambda batch: [[(w, "X") for w in t.split()] if "two" in t or "Held" in t or t == "a b" else [("wrong", "X")] for t in batch]
    out = corpus.pseudo_corpus(texts, held, teacher, 3, 50).withColumn("words", corpus.word_view(F.col("annotation"))).withColumn("tagged", corpus.tagged_view(F.col("annotation")))
    got = {(r["doc_id"], r["part"]): r["reason"] for r in out.collect()}
    assert got == {(1, 0): None, (1, 1): "evaluation_leak", (2, 0): None, (2, 1): "duplicate", (4, 0): "too_short"}
    kept = out.where("doc_id = 1 and part = 0").first()
    assert kept["words"] == "One two three four!" and kept["tagged"] == "One/X two/X three/X four!/X"
    assert [tuple(r) for r in readers.tag_counts(out).collect()] == [("X", 8)] and readers.manifest(out).count() == 4
    assert [tuple(r) for r in ngram.completions(spark.createDataFrame([("abc",), ("abd",), ("b",)], "word string"), spark.createDataFrame([("ab",), ("zz",)], "start string")).orderBy("word").collect()] == [("ab", "abc"), ("ab", "abd")]


def test_running_sums_across_ranges(spark):
    rng = random.Random(2)
    rows = [("hot" if k % 3 else f"k{k % 7}", k, rng.randrange(9)) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, k long, n long").repartition(5)
    want, sums = {}, Counter()
    for g, k, n in sorted(rows):
        want[k] = sums[g]
        sums[g] += n
    assert {r["k"]: r["before"] for r in storage.running(df, ["g"], ["k"], {"before": "n"}).collect()} == want
    assert storage.running(df.limit(0), ["g"], ["k"], {"before": "n"}).count() == 0


def test_evaluation(spark):
    kind = "doc_id int, images array<string>, tokens array<struct<text:string,atom_s:int,atom_e:int>>"
    rows = [(1, ["a", "b"], [("ab", 0, 2)]), (2, ["a"], []), (3, ["a", "b"], [("a", 0, 1)]), (4, ["a", "b", "c"], [("a", 0, 1), ("c", 2, 3)]), (5, ["a"], [("x", 0, 1)]), (6, [], [])]
    df = spark.createDataFrame(rows, kind)
    assert {r["doc_id"]: r["fault"] for r in evaluate.path_faults(df).collect()} == {2: "empty", 3: "incomplete", 4: "discontinuous", 5: "surface"}
    assert [r["doc_id"] for r in evaluate.changed_paths(df, df.where("doc_id <> 1")).collect()] == [1] and evaluate.changed_paths(df, df).count() == 0
    gold = spark.createDataFrame([(1,), (2,)], "sequence int")
    assert evaluate.covering(gold.withColumn("x", F.lit(1)), gold).count() == 2
    with pytest.raises(Exception, match="not in both"):
        evaluate.covering(gold.limit(1), gold).collect()
    with pytest.raises(Exception, match="no threshold"):
        evaluate.fixed_thresholds(spark.createDataFrame([(2, 0.5, True, True)], "length int, score double, gold boolean, valid boolean"), spark.createDataFrame([(3, 0.5)], "length int, threshold double")).collect()
    sampled = spark.createDataFrame([(1, ["a", "b"]), (1, ["ab"]), (1, ["a", "b"])], "doc_id int, words array<string>")
    assert evaluate.distinct_paths(sampled).first()["paths"] == ["a b", "ab"]


def test_saved_tables(spark, tmp_path):
    entries = spark.createDataFrame(KEYS, "word string, labels array<string>")
    readers.save_dictionary(entries, str(tmp_path / "d"))
    readers.repack(spark, str(tmp_path / "d"), str(tmp_path / "e"), 1)
    back = readers.load_dictionary(spark, str(tmp_path / "e"))
    assert {r["word"]: r["labels"] for r in back.collect()} == dict(KEYS) and len([f for f in (tmp_path / "e").iterdir() if f.suffix == ".parquet"]) == 1
    with pytest.raises(ValueError):
        readers.repack(spark, "a/", "a", 1)
    words, pairs = spark.createDataFrame([("a", 3)], "word string, freq long"), spark.createDataFrame([("a", "a", 2)], "l string, r string, freq long")
    readers.save_model(words, pairs, str(tmp_path / "m"))
    one, two = readers.load_model(spark, str(tmp_path / "m"))
    assert [tuple(r) for r in one.collect()] == [("a", 3)] and [tuple(r) for r in two.collect()] == [("a", "a", 2)]
    readers.write_byte_shards(spark.createDataFrame([(k, "x" * 9) for k in range(10)], "id int, line string"), str(tmp_path / "s"), 40, ["id"])
    assert sorted(f.name for f in (tmp_path / "s").iterdir() if f.is_dir()) == ["part=0", "part=1", "part=2"]
    assert spark.read.text(str(tmp_path / "s")).count() == 10
    (tmp_path / "map.xml").write_text('<osm><node id="1"><tag k="name" v="Cafe X"/><tag k="amenity" v="cafe"/></node><node id="2"/></osm>')
    assert [tuple(r) for r in corpus.places_of_tags(readers.map_items(spark, str(tmp_path / "map.xml"))).collect()] == [("Cafe X", "amenity=cafe")]
    (tmp_path / "wiki.xml").write_text("<mediawiki><page><title>T</title><ns>0</ns><revision><text>'''A''' text.\n\nx</text></revision></page><page><title>U</title><ns>1</ns><revision><text>no</text></revision></page></mediawiki>")
    assert [tuple(r) for r in readers.wiki_texts(spark, str(tmp_path / "wiki.xml"), 2).collect()] == [("T", 0, "A text.")]


def test_types_are_unicode_ones():
    assert charmap.TYPES[charmap.table()[ord("汉")]] == "CJK"
