"""MinHash near-dedup and line dedup, against brute force."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from lexiloom.llm import line_dedup, near_dedup
from lexiloom.llm import textkit as tk

from .cases import clashing, frame, hard, prose, rows


def test_words_of_any_slice_and_split():
    texts = ["Ab c-d", None, "", "x" * 50 + " 中文b ", " é1—Z"]
    w = tk.words(pa.array(texts, pa.string()))
    got = [[bytes(w.data[a:b]).decode() for d, a, b in zip(w.doc, w.start, w.end) if d == k] for k in range(len(texts))]
    assert got == [["ab", "c", "d"], [], [], ["x" * 50, "中", "文", "b"], ["é1", "z"]]
    one = tk.words(pa.array(["zz ab"]).slice(0))
    assert one.hash[1] == w.hash[0]
    assert len(tk.words(pa.array([], pa.string())).hash) == 0


def shingle_set(text, k=near_dedup.SHINGLE):
    r, h = tk.shingles(tk.words(pa.array([text])), k)
    return set(h.tolist())


def near_rows(n=60, seed=5):
    out = []
    for i in range(n):
        base = prose(seed + i % 20, 120).split(" ")
        for j in range(i // 20 * (i % 7)):
            base[(j * 37 + i) % len(base)] = f"edit{i}x{j}"
        out.append((i, " ".join(base), "en", "s", 0))
    return out


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    shared, left, right = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (600, 200, 200))
    sets = [np.concatenate([shared, left]), np.concatenate([shared, right]), rng.integers(0, 2**63, 3).astype(np.uint64)]
    rows_, hashes = np.repeat([0, 1, 2], [len(s) for s in sets]), np.concatenate(sets)
    table = near_dedup.sketch(rows_, hashes, 4, 512)
    assert (table[:3] != np.uint64(2**64 - 1)).all() and (table[3] == np.uint64(2**64 - 1)).all()
    assert abs((table[0] == table[1]).mean() - 0.6) < 0.08


def test_near_groups_against_all_pairs(spark):
    docs = near_rows()
    sets = {i: shingle_set(t) for i, t, *_ in docs}
    true = {(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) >= near_dedup.THRESHOLD * len(sets[a] | sets[b])}
    group = {r["doc_id"]: r["group_id"] for r in near_dedup.near_duplicate_groups(frame(spark, docs)).collect()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in true:
        ra, rb = sorted((find(a), find(b)))
        parent[rb] = ra
    found = {(a, b) for a, b in true if group[a] == group[b]}
    assert len(true) > 30 and len(found) >= 0.9 * len(true)
    assert all(find(a) == find(b) for a, b in combinations(sets, 2) if group[a] == group[b])


def test_near_hard_cases(spark):
    docs = frame(spark, hard())
    got = near_dedup.near_duplicate_groups(docs)
    by = {r["doc_id"]: r for r in got.collect()}
    assert set(by) == {1, 2, 3, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, -(2**62)}
    assert by[3]["group_id"] == 1 and by[3]["exact"] and not by[3]["keep"]
    assert by[6]["group_id"] == 5 and by[9]["group_id"] == 2 and by[12]["group_id"] == 11
    assert by[8]["group_id"] == 8 and by[7]["group_id"] == 7 and by[13]["keep"]
    assert rows(near_dedup.near_duplicate_groups(clashing(docs))) == rows(got)
    assert near_dedup.near_duplicate_groups(docs.limit(0)).count() == 0
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(None) == 2 and ids.count(4) == 1 and ids.count(2) == 1 and 9 not in ids and ids.count(10) <= 1
    assert near_dedup.drop_near_duplicates(clashing(docs)).columns == clashing(docs).columns


def test_components(spark):
    edges = [(i + 1, i) for i in range(30)] + [(100, 101), (101, 102), (7, 7)]
    got = dict(near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(1, 31)} | {101: 100, 102: 100}


def lcs_blocks(a, b, words, least):
    """Shared runs of lines, by brute force, where every line is unique."""
    at = {x: i for i, x in enumerate(a)}
    gone, run = [], []
    for j, x in enumerate(b):
        if x in at and run and at[x] == at[b[run[-1]]] + 1:
            run.append(j)
        else:
            gone += run if sum(words[k] for k in run) >= least else []
            run = [j] if x in at else []
    return gone + (run if sum(words[k] for k in run) >= least else [])


def test_patience_aligns_in_order():
    assert line_dedup.patience([1, 2, 3, 4], [9, 2, 3, 8]) == [(1, 1), (2, 2)]
    assert line_dedup.patience([0, 5], [0, 5]) == [(1, 1)]
    pairs = line_dedup.patience([1, 2, 1, 3, 4, 1], [3, 1, 2, 1, 4])
    assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pairs, pairs[1:]))


def common_blocks(a, b, words, least):
    """Lines of b that go, where a comes first and its lines have the same words; a's other lines are long."""
    size = {y: w for y, w in zip(b, words)} | {y: 0 for y in (0,)}
    runs = []
    for x in (a, b):
        count = [size.get(y, 10**6) for y in x]
        runs.append(list(zip(*(v.tolist() for v in line_dedup.run_keys(np.array(x, dtype=np.int64), np.array(count), np.zeros(len(x), dtype=np.int64), least)[1:]))) if x else [])
    first = {}
    for run, start, _ in runs[0]:
        first[run] = min(start, first.get(run, start))
    aligned, moved = line_dedup.align([(run, first[run], start, stop) for run, start, stop in runs[1] if run in first])
    assert not aligned & moved
    return sorted(aligned | moved)


def test_blocks_of_a_pair():
    assert common_blocks([1, 2, 3], [7, 1, 2, 3], [50, 10, 10, 10], 30) == [1, 2, 3]
    assert common_blocks([1, 2, 3], [7, 1, 2, 8], [50, 10, 10, 10], 30) == []


def runs_by_hand(a, b, words, least):
    """Lines of b in runs that a holds, by trying all of them; lines without words count only within."""
    x, at = [y for y in a if y], [k for k, y in enumerate(b) if y]
    has = lambda run: any(x[s : s + len(run)] == run for s in range(len(x) - len(run) + 1))
    gone = set()
    for i in range(len(at)):
        for j in range(i, len(at)):
            if sum(words[k] for k in at[i : j + 1]) >= least and has([b[k] for k in at[i : j + 1]]):
                gone |= set(range(at[i], at[j] + 1))
    return sorted(gone)


def test_blocks_that_repeat_or_moved():
    p, w = [1, 2, 3], [20, 20, 20]
    assert common_blocks([7, *p, 8], [9, *p, 10, *p, 11], [5, *w, 5, *w, 5], 30) == [1, 2, 3, 5, 6, 7]
    assert common_blocks([9, *p, 10, *p, 11], [7, *p, 8], [5, *w, 5], 30) == [1, 2, 3]
    assert common_blocks([1, 2, 9, 3, 4, 5], [3, 4, 5, 8, 1, 2], [20] * 6, 30) == [0, 1, 2, 4, 5]
    rng = random.Random(6)
    for _ in range(1500):
        size = {0: 0} | {x: rng.randint(1, 9) for x in range(1, 8)}
        a, b = ([rng.randrange(rng.choice([3, 8])) for _ in range(rng.randint(0, 14))] for _ in range(2))
        words = [size[x] for x in b]
        assert common_blocks(a, b, words, 12) == runs_by_hand(a, b, words, 12)


def test_line_dedup_against_brute_force(spark):
    shared = prose(77, 70)
    texts = [prose(i, 60) for i in range(8)]
    for i in (1, 3, 4, 6):
        head, tail = texts[i].split("\n")[:2], texts[i].split("\n")[2:]
        texts[i] = "\n".join([*head, shared, *tail])
    texts.append(texts[0])
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(frame(spark, docs)).collect()}
    assert 8 not in got
    seen = []
    for i, t in enumerate(texts[:8]):
        own = t.split("\n")
        words = [len(x.split()) for x in own]
        gone = set()
        for other in seen:
            gone |= set(lcs_blocks(other, own, words, line_dedup.BLOCK_WORDS))
        assert got[i]["text"].rstrip("\n") == "\n".join(x for k, x in enumerate(own) if k not in gone).rstrip("\n")
        assert got[i]["n_chars"] == len(got[i]["text"])
        seen.append(own)
    assert shared in got[1]["text"] and "\n".join(shared.split("\n")[1:-1]) not in got[3]["text"]


def test_line_dedup_hard_cases(spark):
    docs = frame(spark, hard())
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    by = {}
    for r in out.collect():
        by.setdefault(r["doc_id"], []).append(r["text"])
    assert by[1] == [hard()[0][1]] and 3 not in by and 9 not in by
    assert by[4] == [None] and len(by[None]) == 2 and by[5] == [""] and by[11] == ["word"] and by[12] == ["word"] and by[8] == ["!!! ..."]
    assert len(by[13][0]) == len(hard()[16][1])
    extra = line_dedup.dedup_lines(clashing(docs))
    assert rows(extra.select(docs.columns)) == rows(out)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_line_dedup_of_blocks_whose_lines_have_other_first_holders(spark):
    line = [" ".join(f"{c}{k}" for k in range(12)) + "." for c in "abc"]
    texts = [f"{line[i]}\n{prose(40 + i, 50)}" for i in range(3)] + ["\n".join([prose(50 + i, 50), *line, prose(60 + i, 50)]) for i in range(5)]
    short = "\n".join(f"u{k} v{k}." for k in range(20))
    texts += [f"{prose(70 + i, 50)}\n{short}\n{prose(80 + i, 50)}" for i in range(2)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame(spark, [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)])).collect()}
    assert [sum(x in got[i] for x in line) for i in range(8)] == [1, 1, 1, 3, 0, 0, 0, 0]
    assert short in got[8] and not any(x in got[9] for x in short.split("\n"))


@pytest.mark.parametrize("holders", [2, 3, 5, 12, 50])
def test_line_dedup_for_any_number_of_holders(spark, holders):
    line = [" ".join(f"{c}{k}" for k in range(12)) + "." for c in "abc"]
    texts = [f"{prose(100 + i, 20)}\n{line[i]}\n{prose(140 + i, 20)}" for i in range(3)] + ["\n".join([prose(200 + i, 20), *line, prose(300 + i, 20)]) for i in range(holders)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame(spark, [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)])).collect()}
    assert [sum(x in got[i] for x in line) for i in range(3 + holders)] == [1, 1, 1, 3] + [0] * (holders - 1)


def test_line_dedup_of_random_blocks(spark):
    """Against all pairs of documents, with blocks of any size held by 2 to 12 documents in any order."""
    rng = random.Random(11)
    pool = [" ".join(f"w{k}x{j}" for j in range(rng.randint(2, 14))) + "." for k in range(60)]
    blocks = [pool[k : k + rng.randint(1, 6)] for k in range(0, 54, 6)]
    docs = [[f"own {i} {j} {rng.random()}." for j in range(rng.randint(1, 4))] for i in range(60)]
    for block in blocks:
        for i in rng.sample(range(60), rng.randint(2, 12)):
            at = rng.randint(0, len(docs[i]))
            docs[i][at:at] = block
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame(spark, [(i, "\n".join(x), "en", "s", 0) for i, x in enumerate(docs)]), drop_empty=False).collect()}
    size = lambda x: len(tk.words(pa.array([x])).hash)
    deleted = 0
    for i, own in enumerate(docs):
        gone = {k for j in range(i) for k in runs_by_hand(docs[j], own, [size(x) for x in own], line_dedup.BLOCK_WORDS)}
        deleted += len(gone)
        assert [x for x in got[i].split("\n") if x] == [x for k, x in enumerate(own) if k not in gone]
    assert deleted > 30


def test_near_groups_in_hot_buckets(spark):
    """A bucket of unlike texts over one boilerplate, copies of a text in thousands of versions, and a hub of the graph."""
    rng = np.random.default_rng(3)
    page = prose(1, 40, 300)
    unlike = [(i, f"{page} {prose(100 + i, 120, 90_000)}", "en", "s", 0) for i in range(400)]
    base = prose(2, 80).split(" ")
    versions = [(10_000 + i, " ".join(f"v{i}" if k == i % 60 else w for k, w in enumerate(base)), "en", "s", 0) for i in range(600)]
    docs = unlike + versions
    got = {r["doc_id"]: r for r in near_dedup.near_duplicate_groups(frame(spark, docs), bands=20, rows=1).collect()}
    sets = {i: shingle_set(t) for i, t, *_ in docs}
    assert all(got[i]["group_id"] == i for i, *_ in unlike) and {got[i]["group_id"] for i, *_ in versions} == {10_000}
    assert all(len(sets[a] & sets[b]) < 0.5 * len(sets[a] | sets[b]) for a, b in combinations(range(60), 2)) and got[10_000]["links"] >= 300
    order = rng.permutation(20_000).tolist()
    star = spark.createDataFrame([(20_000, k) for k in order], "a long, b long")
    roots = near_dedup.components(star)
    assert roots.count() == 20_000 and roots.where("root <> 0").count() == 0


@pytest.mark.parametrize("text", ["İİ. Straße Ünï. Next one.\nEnd", "a. b! c? d", "\n\n"])
def test_lines_where_lower_case_moves_bytes(text):
    row, end, _, count = line_dedup.lines(pa.array([text, "plain one. two"]))
    raw = text.encode()
    ends = end[row == 0].tolist()
    assert ends[-1] == len(raw) and b"".join(raw[a:b] for a, b in zip([0, *ends], ends)) == raw
    assert count.sum() == len(tk.words(pa.array([text, "plain one. two"])).hash)
