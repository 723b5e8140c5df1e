"""Quality classifier, quality rules, language id and packing, against brute force and held-out labels."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lexiloom.llm import classifier, language_id, packing, quality_rules

from .cases import clashing, frame, hard, prose, rows

LABELS = "doc_id long, quality int"


def junk(seed):
    return " ".join(f"{w}###" for w in prose(seed, 60).split())


def labelled(n=240):
    docs = [(i, junk(i) if i % 3 == 0 else prose(i, 60 + i % 50), "en" if i % 4 else "fr", "s", 0) for i in range(n)]
    return docs, [(i, int(i % 3 != 0)) for i in range(n)]


def test_measure_by_hand():
    texts = ["AB #1\nab #1\n\n", None, "", "go go stop go", "ab é中"]
    m = quality_rules.measure(pa.array(texts))
    assert m["markup"].tolist() == [2 / 13, 0, 0, 0, 0]
    assert m["upper"][0] == 2 / 13 and m["digits"][0] == 2 / 13
    assert m["echo"].tolist() == [2 / 4, 0, 0, 2 / 4, 0]
    assert m["relines"].tolist() == [0.5, 0, 0, 0, 0]
    assert quality_rules.levels(m).tolist()[1:3] == [quality_rules.LEVELS] * 2


def test_levels_by_brute_force():
    shares = {r: np.linspace(0, 1, 41) if k == 0 else np.linspace(1, 0, 41) ** 4 for k, r in enumerate(quality_rules.CUTOFFS)}
    want = [min([j for r, c in quality_rules.CUTOFFS.items() for j in range(quality_rules.LEVELS) if shares[r][i] > c[j]], default=quality_rules.LEVELS) for i in range(41)]
    assert quality_rules.levels(shares).tolist() == want


def test_binomial_bound_and_correction():
    exact = sum(math.comb(40, i) * 0.1**i * 0.9 ** (40 - i) for i in range(3))
    assert quality_rules.tail(40, 2, 0.1) == pytest.approx(exact, rel=1e-12) and quality_rules.tail(5, 5, 0.3) == 1
    clean = [0] * quality_rules.LEVELS + [200]
    assert quality_rules.choose({"a": clean}, 0.025, 0.05) == {"a": 11}
    assert quality_rules.choose({"a": clean, **{f"b{i}": [0] * 13 for i in range(40)}}, 0.025, 0.05)["a"] == -1  # 41 strata: 200 don't do
    assert quality_rules.choose({"a": [0, 0, 90] + [0] * 9 + [400]}, 0.025, 0.05) == {"a": 1}
    assert quality_rules.choose({}) == {}


def test_bound_holds_when_repeated():
    rng, bad = np.random.default_rng(3), 0
    true = np.array([0.004] * 12)  # added false rejection at each level
    for _ in range(400):
        counts = np.bincount(np.minimum(np.searchsorted(np.cumsum(true), rng.random(300)), 12), minlength=13)
        level = quality_rules.choose({"a": counts.tolist()}, 0.025, 0.05)["a"]
        bad += np.cumsum(true)[level] > 0.025 if level >= 0 else 0
    assert bad / 400 <= 0.08


def test_rules_drop_junk_and_keep_the_rest(spark):
    docs, labels = labelled(900)
    docs = frame(spark, docs)
    judged = quality_rules.judge(docs, spark.createDataFrame(labels, LABELS), risk=0.03)
    kept = {r["doc_id"] for r in judged.where("keep").collect()}
    assert kept == {i for i in range(900) if i % 3}
    passed = quality_rules.drop_rejected(docs, spark.createDataFrame(labels, LABELS), risk=0.03)
    assert {r["doc_id"] for r in passed.collect()} == kept and passed.columns == docs.columns


def test_rules_hard_cases(spark):
    docs, labels = frame(spark, hard()), spark.createDataFrame([(1, 1), (1, None), (None, 1), (2, 0), (2, 1)], LABELS)
    judged = quality_rules.judge(docs, labels)
    assert judged.count() == 16 and judged.where("not keep").count() == 0
    assert rows(quality_rules.judge(clashing(docs), labels)) == rows(judged)
    assert rows(quality_rules.drop_rejected(docs, labels)) == rows(docs)
    assert quality_rules.drop_rejected(clashing(docs), labels).columns == clashing(docs).columns
    assert quality_rules.judge(docs.limit(0), labels).count() == 0 and quality_rules.judge(docs, labels.limit(0)).count() == 16


def test_classifier_on_held_out_labels(spark):
    docs, labels = labelled(600)
    known = [x for x in labels if x[0] < 400]
    out = classifier.classify(frame(spark, docs), spark.createDataFrame(known, LABELS)).collect()
    right = [r["keep"] == bool(r["doc_id"] % 3) for r in out if r["doc_id"] >= 400]
    assert len(right) == 200 and np.mean(right) > 0.97
    by = sorted((r["score"], r["probability"]) for r in out)
    assert all(a[1] <= b[1] for a, b in zip(by, by[1:]))


def test_classifier_is_the_ridge_solution(spark):
    docs, labels = labelled(300)
    table = classifier.featured(frame(spark, docs))
    model = classifier.train(table, spark.createDataFrame(labels, LABELS), dimensions=32)
    known = classifier._labelled(table, spark.createDataFrame(labels, LABELS)).toPandas()
    fit = known[known.draw >= classifier.CALIBRATION]
    x = fit[list(classifier.FEATURES)].to_numpy()
    z = model.features(x)
    want = np.linalg.solve(z.T @ z + classifier.RIDGE * len(x) / 33 * np.eye(33), z.T @ fit.good.to_numpy())
    assert np.allclose(model.weights, want, atol=1e-6)
    a, b = x[:40], x[40:80]
    wide = classifier.Model(model.mean, model.scale, np.random.default_rng(0).normal(0, 0.25, (13, 20_000)), np.random.default_rng(1).uniform(0, 2 * np.pi, 20_000), None, None, None)
    kernel = np.exp(-(((a - b) / model.scale) ** 2).sum(axis=1) / (2 * 16))
    assert np.allclose((wide.features(a)[:, :-1] * wide.features(b)[:, :-1]).sum(axis=1), kernel, atol=0.05)


def test_isotonic_against_min_max_formula():
    rng = np.random.default_rng(2)
    w, t = rng.integers(1, 9, 30).astype(float), rng.integers(0, 9, 30).astype(float)
    mean = lambda i, j: t[i : j + 1].sum() / w[i : j + 1].sum()
    want = [max(min(mean(i, j) for j in range(k, 30)) for i in range(k + 1)) for k in range(30)]
    assert np.allclose(classifier.isotonic(w, t), want)


def test_classifier_hard_cases(spark):
    docs = frame(spark, hard())
    none = classifier.classify(docs, spark.createDataFrame([], LABELS))
    assert none.count() == 16 and none.where("score is null and probability is null and keep").count() == 16
    more, labels = labelled(120)
    every = docs.union(frame(spark, [(1000 + r[0], *r[1:]) for r in more]))
    known = spark.createDataFrame([(1000 + i, q) for i, q in labels] + [(None, 1), (1, None)], LABELS)
    out = classifier.classify(every, known)
    assert out.count() == 136 and out.where("score is null").count() == 0
    assert rows(classifier.classify(clashing(every), known)) == rows(out)
    assert classifier.classify(docs.limit(0), known).count() == 0


def profile_by_hand(texts, size):
    counts = Counter()
    for t in texts:
        for word in "".join(c if "a" <= c <= "z" or ord(c) >= 0xC0 else " " for c in t.lower()).split():
            x = f" {word} "
            counts.update(x[i : i + n] for n in (1, 2, 3) for i in range(len(x) - n + 1) if x[i : i + n].strip())
    return sorted(counts, key=lambda g: (-counts[g], g))[:size]


def test_languages_against_brute_force(spark):
    docs = [(i, prose(i, 40).replace("a", "ü" if i % 2 else "a").replace("o", "ção" if i % 3 == 0 else "o"), "xa" if i % 2 else "xb", "s", 0) for i in range(24)]
    got = {r["doc_id"]: r for r in language_id.identify(frame(spark, docs), language_id.train_profiles(frame(spark, docs), 40), 40).collect()}
    profiles = {lang: {g: k for k, g in enumerate(profile_by_hand([d[1] for d in docs if d[2] == lang], 40))} for lang in ("xa", "xb")}
    for i, text, *_ in docs:
        away = sorted((sum(abs(p[g] - k) if g in p else 40 for k, g in enumerate(profile_by_hand([text], 40))), lang) for lang, p in profiles.items())
        assert (got[i]["predicted"], got[i]["distance"], got[i]["runner_up"], got[i]["margin"]) == (away[0][1], away[0][0], away[1][1], away[1][0] - away[0][0])


def test_languages_hard_cases(spark):
    docs = frame(spark, hard())
    profiles = language_id.train_profiles(docs)
    got = language_id.identify(docs, profiles)
    assert got.count() == 17
    none = {r["doc_id"] for r in got.where("predicted is null").collect()}
    assert none == {4, 5, 6, 7, 8}
    assert rows(language_id.identify(clashing(docs), language_id.train_profiles(clashing(docs)))) == rows(got)
    assert rows(language_id.identify(docs, profiles.limit(0)).select("predicted").distinct()) == [(None,)]
    assert language_id.identify(docs.limit(0), profiles).count() == 0 and language_id.train_profiles(docs.limit(0)).count() == 0
    wide = "".join(chr(c) for c in range(0x4E00, 0x9000)) + "".join(chr(c) for c in range(0x10000, 0x11000))
    rare = frame(spark, [(i, wide[i * 7 :], "zh", "s", 0) for i in range(40)])
    assert language_id.identify(rare, language_id.train_profiles(rare)).where("predicted = 'zh'").count() == 40


def pack_by_hand(sizes, limits):
    left, bins = list(range(len(sizes))), []
    weight = np.mean([[s / c for s, c in zip(x, limits)] for x in sizes], axis=0)
    while left:
        room, own = list(limits), []
        while True:
            fit = [i for i in left if all(s <= r for s, r in zip(sizes[i], room))]
            if not fit:
                break
            pull = lambda i: sum(w * s / c * (r / c) for w, s, c, r in zip(weight, sizes[i], limits, room))
            top = max(pull(i) for i in fit)
            best = min((tuple(sizes[i]), i) for i in fit if pull(i) > top - 1e-12)[1]
            own.append(best)
            left.remove(best)
            room = [r - s for r, s in zip(room, sizes[best])]
        bins.append(own)
    return bins


@pytest.mark.parametrize("seed", range(5))
def test_packing_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    tokens = rng.integers(1, 100, 60)
    sizes = np.stack([tokens, np.ones(60, dtype=np.int64), (tokens * rng.random(60)).astype(np.int64)], axis=1)
    got = packing.pack(sizes, np.array([100, 6, 60])) if (sizes[:, 2] <= 60).all() else packing.pack(np.minimum(sizes, 60), np.array([100, 6, 60]))
    want = pack_by_hand((sizes if (sizes[:, 2] <= 60).all() else np.minimum(sizes, 60)).tolist(), [100, 6, 60])
    assert got == want


def test_packing_places_everything_within_limits(spark):
    turns = [(i, r, prose(i * 9 + k, 5 + 40 * (i % 5)), ) for i in range(80) for k, r in enumerate(("user", "assistant", None))]
    out = packing.pack_conversations(spark.createDataFrame([(i, r, t) for i, r, t in turns], "conv_id long, role string, text string"), tokens=300, segments=4, loss=90, group=32).toPandas()
    words = Counter()
    loss = Counter()
    for i, r, t in turns:
        n = len(t.split())
        words[i] += n
        loss[i] += n * (r == "assistant")
    assert dict(out.groupby("doc_id").tokens.sum()) == dict(words) and dict(out.groupby("doc_id").loss_tokens.sum()) == dict(loss)
    by = out.groupby("bin").agg(t=("tokens", "sum"), n=("slot", "size"), l=("loss_tokens", "sum"), s=("slot", "max"))
    assert (by.t <= 300).all() and (by.n <= 4).all() and (by.l <= 90).all() and (by.s == by.n - 1).all()
    for _, own in out.sort_values("piece").groupby("doc_id"):
        assert own.start.tolist() == [0, *own.tokens.cumsum().tolist()[:-1]] and own.piece.tolist() == list(range(len(own)))


def test_packing_cuts_where_the_loss_is(spark):
    turns = [(1, 0, "user", "u " * 8192), (1, 1, "assistant", "a " * 8192), (2, 0, "user", "u " * 30), (2, 1, "assistant", "a " * 20), (2, 2, "user", "u " * 10), (2, 3, "assistant", "a " * 25), (3, None, None, "x"), (3, 5, "assistant", None), (None, 0, "user", "u")]
    df = spark.createDataFrame([(c, t, r, x) for c, t, r, x in turns], "conv_id long, turn long, role string, text string").repartition(3)
    out = packing.pack_conversations(df).orderBy("doc_id", "piece").collect()
    got = [(r["doc_id"], r["piece"], r["start"], r["tokens"], r["loss_tokens"]) for r in out]
    assert got == [(1, 0, 0, 8192, 0), (1, 1, 8192, 6144, 6144), (1, 2, 14336, 2048, 2048), (2, 0, 0, 85, 45), (3, 0, 0, 1, 0)]
    small = packing.pack_conversations(df.where("conv_id = 2"), tokens=40, loss=15, segments=3).orderBy("piece").collect()
    bears, at = "u" * 30 + "a" * 20 + "u" * 10 + "a" * 25, 0
    for k, r in enumerate(small):
        own = bears[r["start"] : r["start"] + r["tokens"]]
        assert (r["piece"], r["start"], r["loss_tokens"]) == (k, at, own.count("a")) and len(own) <= 40 and own.count("a") <= 15
        at += len(own)
    assert at == len(bears)


def test_packing_hard_cases(spark):
    docs = frame(spark, hard())
    out = packing.pack_documents(docs)
    by = Counter(r["doc_id"] for r in out.collect())
    assert set(by) == {1, 2, 3, 9, 10, 11, 12, 13, 14, -(2**62)} and by[9] == 2 and by[10] == 2 and by[13] == -(-60_000 // packing.TOKENS)
    assert rows(packing.pack_documents(clashing(docs))) == rows(out)
    assert rows(packing.pack_documents(docs.repartition(7))) == rows(out)
    assert packing.pack_documents(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, 0, 5, 9), (2, 0, None, 1), (3, 0, 0, 0), (4, 0, 4, -2), (5, 0, 4, None), (6, 0, 6, 6)], "doc_id long, digest long, tokens long, loss_tokens long")
    got = {(r["doc_id"], r["piece"]): (r["tokens"], r["loss_tokens"]) for r in packing.pack_examples(odd, 6, 2, 5).collect()}
    assert got == {(1, 0): (5, 5), (4, 0): (4, 0), (5, 0): (4, 0), (6, 0): (3, 3), (6, 1): (3, 3)}
    with pytest.raises(ValueError):
        packing.pack_examples(odd, 0)


def test_packing_by_a_tokenizer(tmp_path, spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer(tokenizers.models.WordLevel({"a": 0, "b": 1, "[UNK]": 2}, unk_token="[UNK]"))
    t.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    t.save(str(tmp_path / "t.json"))
    out = packing.pack_documents(frame(spark, [(1, "a b, c", "en", "s", 0)]), tokenizer=str(tmp_path / "t.json"))
    assert out.first()["tokens"] == 4
    import base64

    pieces = [bytes([k]) for k in range(256)] + [b"ab", b" ab"]
    (tmp_path / "t.tiktoken").write_bytes(b"".join(base64.b64encode(p) + b" %d\n" % k for k, p in enumerate(pieces)))
    out = packing.pack_documents(frame(spark, [(1, "ab ab c", "en", "s", 0)]), tokenizer=str(tmp_path / "t.tiktoken"))
    assert out.first()["tokens"] == 4


def by_definition(docs, known, draws):
    """Probabilities by the method's steps, each in its plainest form: all rows at once, the min-max form of isotonic regression."""
    x = {i: classifier.statistics(pa.array([t]))[0] for i, t, *_ in docs}
    fit, held = ([i for i in known if (draws[i] < classifier.CALIBRATION) == low] for low in (False, True))
    mean, scale = np.mean([x[i] for i in fit], axis=0), np.std([x[i] for i in fit], axis=0)
    scale = np.where(scale > 1e-9, scale, 1)
    rng = np.random.default_rng(classifier.SEED)
    waves = rng.normal(0, 1 / classifier.WIDTH, (len(mean), classifier.DIMENSIONS))
    phase = rng.uniform(0, 2 * np.pi, classifier.DIMENSIONS)
    z = lambda i: np.append(np.sqrt(2 / len(phase)) * np.cos((x[i] - mean) / scale @ waves + phase), 1)
    a = np.array([z(i) for i in fit])
    weights = np.linalg.lstsq(np.vstack([a, np.sqrt(classifier.RIDGE * len(fit) / a.shape[1]) * np.eye(a.shape[1])]), np.array([known[i] for i in fit] + [0] * a.shape[1], dtype=float), rcond=None)[0]
    score = {i: float(z(i) @ weights) for i in x}
    bins = {}
    for i in held:
        bins.setdefault(int((score[i] + 0.5) / 2 * classifier.SCORE_BINS), []).append(i)
    groups = [bins[b] for b in sorted(bins)]
    share = lambda u, v: np.mean([known[i] for g in groups[u : v + 1] for i in g])
    level = [max(min(share(u, v) for v in range(k, len(groups))) for u in range(k + 1)) for k in range(len(groups))]
    blocks = {}
    for g, y in zip(groups, level):
        blocks.setdefault(round(y, 12), []).extend(score[i] for i in g)
    return {i: float(np.interp(s, [np.mean(v) for v in blocks.values()], list(blocks))) for i, s in score.items()}


def test_classifier_against_its_definition(spark):
    docs, labels = labelled(260)
    rng = np.random.default_rng(4)
    known = {i: int(q if rng.random() < 0.9 else 1 - q) for i, q in labels if i < 200}
    out = classifier.classify(frame(spark, docs), spark.createDataFrame(list(known.items()), LABELS)).collect()
    table = spark.createDataFrame([(i,) for i in known], "doc_id long")
    draws = {r["doc_id"]: r["draw"] for r in classifier._labelled(table, spark.createDataFrame(list(known.items()), LABELS)).collect()}
    want = by_definition(docs, known, draws)
    assert len({round(p, 3) for p in want.values()}) > 3
    assert all(abs(r["probability"] - want[r["doc_id"]]) < 2e-3 for r in out) and len(out) == 260


def test_ids_of_any_type(spark):
    """Text ids go through every operator as integer ones do."""
    from pyspark.sql import functions as F

    from lexiloom.llm import decontaminate, license_scan, line_dedup, near_dedup

    docs = frame(spark, [(i, prose(i % 9, 60) + (" under the MIT License" if i == 3 else ""), "en", "s", 0) for i in range(14)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(14)], LABELS)
    items = spark.createDataFrame([(1, prose(2, 60)[:200])], "item_id long, text string")
    name = lambda df, c="doc_id": df.withColumn(c, F.concat(F.lit("http://h/"), F.lpad(F.col(c).cast("string"), 4, "0")))
    runs = [
        lambda d, x, t: classifier.classify(d, x).select("doc_id"),
        lambda d, x, t: quality_rules.judge(d, x),
        lambda d, x, t: language_id.identify(d, language_id.train_profiles(d)),
        lambda d, x, t: packing.pack_documents(d).select("doc_id", "tokens"),
        lambda d, x, t: near_dedup.near_duplicate_groups(d),
        lambda d, x, t: decontaminate.find_leaks(d, t),
        lambda d, x, t: license_scan.scan(d),
        lambda d, x, t: line_dedup.dedup_lines(d),
    ]
    for run in runs:
        plain = run(docs, labels, items)
        for c in ("doc_id", "group_id"):
            plain = name(plain, c) if c in plain.columns else plain
        told = run(name(docs), name(labels), items)
        assert rows(plain) == rows(told) and rows(told)
