"""Decontamination, license scans, URL filters and WARC assembly, against brute force and round trips."""

import datetime as dt
import gzip
import random

import numpy as np
import pyarrow as pa
import pytest

from lexiloom.llm import decontaminate, license_scan, url_filters, warc
from lexiloom.llm import textkit as tk
from lexiloom.plans import storage

from .cases import clashing, frame, hard, prose, rows

ITEMS = "item_id long, text string"


def words(text):
    return tk.words(pa.array([text])).hash.tolist()


def matches_by_hand(docs, items, phrase):
    out = set()
    for d, text in docs:
        a = words(text)
        for i, item in items:
            b = words(item)
            size = min(phrase, len(b))
            for s in range(len(a)):
                for t in range(len(b)):
                    if a[s] == b[t] and not (s and t and a[s - 1] == b[t - 1]):
                        n = 0
                        while s + n < len(a) and t + n < len(b) and a[s + n] == b[t + n]:
                            n += 1
                        if n >= size:
                            out.add((d, i, s, t, n))
    return out


def near_by_hand(docs, items):
    held = {d: words(t) for d, t in docs}
    count = lambda t: sum(t in set(w) for w in held.values())
    out = {}
    for i, item in items:
        terms = [t - (1 << 64) if t >= 1 << 63 else t for t in words(item)]
        unsigned = dict(zip(terms, words(item)))
        keys = [unsigned[t] for t in sorted(set(terms), key=lambda t: (count(unsigned[t]), t))[: decontaminate.KEY_TERMS]]
        width = int(decontaminate.SLACK * len(terms))
        for d, w in held.items():
            best = max((len(set(w[s : s + width]) & set(keys)), -s) for s in range(len(w)) if w[s] in keys) if set(w) & set(keys) else (0, 0)
            if len(keys) >= decontaminate.LEAST_TERMS and best[0] >= np.ceil(decontaminate.NEAR_SHARE * len(keys)):
                out[d, i] = (best[0], -best[1])
    return out


def test_leaks_against_brute_force(spark):
    rng = random.Random(4)
    items = [(i, prose(500 + i, 14 + i, 300)) for i in range(12)] + [(90, "two words"), (91, prose(500, 14, 300) + " again and again"), (92, "the the the the")]
    docs = []
    for d in range(40):
        text = prose(d, 60, 300).split("\n")
        for i in rng.sample(range(15), 2 if d % 2 else 0):
            own = items[i][1].split(" ")
            if d % 3 == 0 and len(own) > 12:
                own[6] = "changed"
            text.insert(1, " ".join(own))
        docs.append((d, "\n".join(text)))
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS)).collect()
    phrases = {(r["doc_id"], r["item_id"], r["doc_start"], r["item_start"], r["n_terms"]) for r in got if r["kind"] == "phrase"}
    want = matches_by_hand(docs, items, decontaminate.PHRASE)
    assert len(want) > 20 and phrases == want
    near = {(r["doc_id"], r["item_id"]): (r["n_terms"], r["doc_start"]) for r in got if r["kind"] == "proximity"}
    assert near == near_by_hand(docs, items) and set(near) - {x[:2] for x in want}


def edited_copies(n):
    """Items of 45 words, and documents with a copy of each in which every 9th word is another."""
    items = [(i, prose(3000 + i, 45)) for i in range(n)]
    copies = [" ".join(f"new{i}x{k}" if k % 9 == 4 else w for k, w in enumerate(t.split())) for i, t in items]
    return items, [(i, f"{prose(5000 + i, 40)} {t} {prose(7000 + i, 40)}") for i, t in enumerate(copies)]


def test_leaks_of_copies_with_replaced_words(spark):
    items, docs = edited_copies(40)
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items + [(99, prose(9999, 45))], ITEMS)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(i, i) for i, _ in items}
    distinct = {i: set(words(t)) for i, t in items}
    for r in got:
        if r["kind"] == "edited":
            own, width = words(docs[r["doc_id"]][1]), 2 * r["item_terms"]
            near = [len(set(own[s : s + width]) & distinct[r["item_id"]]) if own[s] in distinct[r["item_id"]] else 0 for s in range(len(own))]
            assert (r["n_terms"], r["doc_start"]) == (max(near), near.index(max(near)))


def test_leaks_whatever_the_index_holds(spark, monkeypatch):
    docs = spark.createDataFrame([(i, prose(i % 5, 50)) for i in range(9)], "doc_id long, text string")
    items = spark.createDataFrame([(1, prose(2, 20)), (2, prose(99, 20))], ITEMS)
    few = rows(decontaminate.find_leaks(docs, items))
    monkeypatch.setattr(decontaminate, "VOCABULARY_ROWS", 0)
    assert rows(decontaminate.find_leaks(docs, items)) == few and few
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 100)
    assert rows(decontaminate.find_leaks(docs, items)) == few


def test_leaks_hard_cases(spark):
    docs = frame(spark, hard())
    items = spark.createDataFrame([(1, " ".join(hard()[0][1].split()[5:40])), (1, " ".join(hard()[0][1].split()[5:40])), (2, None), (None, "word"), (3, ""), (4, "!!"), (5, "word")], ITEMS)
    got = decontaminate.find_leaks(docs, items)
    assert {(r["doc_id"], r["item_id"], r["kind"]) for r in got.collect()} == {(d, 1, k) for d in (1, 3, 10) for k in ("phrase", "proximity")} | {(11, 5, "phrase"), (12, 5, "phrase")}
    assert rows(decontaminate.find_leaks(clashing(docs), items)) == rows(got)
    kept = decontaminate.drop_leaks(docs, items)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {2, 4, None, 5, 6, 7, 8, 9, 13, 14, -(2**62)}
    assert decontaminate.find_leaks(docs.limit(0), items).count() == 0
    assert decontaminate.find_leaks(docs, items.limit(0)).count() == 0
    assert decontaminate.drop_leaks(docs, items.limit(0)).count() == docs.count()


def test_winnowing_meets_every_long_stretch():
    rng = np.random.default_rng(8)
    h = rng.integers(0, 50, 400).astype(np.uint64)
    kept = license_scan.winnow(h, 5)
    assert (np.diff(np.concatenate([[-1], kept, [400]])) <= 5).all()
    assert license_scan.winnow(h[:3], 5).tolist() == [int(2 - np.argmin(h[:3][::-1]))]


def best_by_hand(a, b):
    """(matches, b from, b to) of the best local alignment, over all cells."""
    best = (0, 0, 0, 0)
    table = [[(0, 0, 0)] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            x = table[i - 1][j - 1]
            hit = a[i - 1] == b[j - 1]
            cell = (x[0] + (1 if hit else -1), x[1] + hit, x[2] if x[0] else j - 1)
            for y in (table[i - 1][j], table[i][j - 1]):
                if y[0] - 1 > cell[0]:
                    cell = (y[0] - 1, y[1], y[2])
            table[i][j] = cell if cell[0] > 0 else (0, 0, 0)
            if table[i][j][0] > best[0]:
                best = (*table[i][j], j)
    return best[1:]


def test_licenses_against_unbanded_alignment(spark):
    rng, docs = random.Random(6), []
    given = {n: t for n, t in license_scan.TEMPLATES.items() if len(words(t)) < 130}
    names = sorted(n for n, t in given.items() if len(words(t)) >= license_scan.EXACT) + ["mit-note", "cc-by-nc-4.0-note", "all-rights-reserved"]
    for d in range(30):
        own = given[names[d % len(names)]].split()
        if d % 3 == 1 and len(own) > 12:
            own[5] = "altered"
            del own[9]
        if d % 5 == 4:
            own = own[: len(own) // 3]
        docs.append((d, " ".join(prose(d, 20).split() + own + prose(d + 50, 20).split())))
    docs += [(100 + d, prose(d, 60)) for d in range(5)]
    rng.shuffle(docs)
    got = license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string"), given).collect()
    want = set()
    for d, text in docs:
        for n in given:
            a, b = words(given[n]), words(text)
            if len(a) < license_scan.EXACT:
                want |= {(d, n, len(a), k, k + len(a)) for k in range(len(b)) if b[k : k + len(a)] == a}
            else:
                m, b0, b1 = best_by_hand(a, b)
                if m >= license_scan.COVERAGE * len(a):
                    want.add((d, n, m, b0, b1))
    assert {(r["doc_id"], r["template"], r["matched"], r["doc_start"], r["doc_end"]) for r in got} == want and len(want) > 20
    texts = dict(docs)
    for r in got:
        if r["coverage"] == 1:
            assert words(texts[r["doc_id"]].lower()[r["char_start"] : r["char_end"]]) == words(texts[r["doc_id"]])[r["doc_start"] : r["doc_end"]]


def test_whole_licenses_with_changes(spark):
    rng, docs, spot = random.Random(3), [], {}
    for d, name in enumerate(("mit", "bsd-3-clause", "gpl-3.0", "apache-2.0", "mpl-2.0", "isc", "lgpl-2.1")):
        own = license_scan.TEMPLATES[name].split()
        for _ in range(len(own) // 40):
            own[rng.randrange(3, len(own) - 3)] = f"changed{rng.randrange(99)}"
        for _ in range(len(own) // 90):
            del own[rng.randrange(3, len(own) - 3)]
        head, body = prose(d, 300), " ".join(own)
        docs.append((d, f"{head}\n{body}\n{prose(d + 40, 300)}"))
        spot[d, name] = (len(words(head)), len(words(f"{head} {body}")))
    got = {(r["doc_id"], r["template"]): r for r in license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert set(spot) <= set(got)
    for key, (a, b) in spot.items():
        assert (got[key]["doc_start"], got[key]["doc_end"]) == (a, b) and 0.9 < got[key]["coverage"] < 1
    assert {k[1] for k in got if k[0] in (0, 5)} == {"mit", "isc"}  # nothing but the license itself


@pytest.mark.parametrize("text", ["All rights reserved. foo bar ", "licensed under the MIT License and CC BY-NC 4.0 ", license_scan.TEMPLATES["mit"] + " x "])
def test_licenses_in_a_long_text_of_notices(text):
    import time

    index = license_scan.Index(license_scan.TEMPLATES, license_scan.K, license_scan.WINDOW, license_scan.COVERAGE, license_scan.EXACT)
    n = 100_000 // len(text.split())
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text * n]})
    start = time.perf_counter()
    (out,) = license_scan._scan(index, license_scan.BAND, pa.int64())(iter([batch]))
    assert time.perf_counter() - start < 8 and out.num_rows >= n


def test_licenses_hard_cases(spark, monkeypatch):
    note = f"Licensed {license_scan.TEMPLATES['mit-note']}."
    docs = frame(spark, [*hard(), (50, f"É {note} x {note}", "en", "s", 0), (50, f"É {note} x {note}", "en", "s", 0), (51, None, "en", "s", 0)])
    got = license_scan.scan(docs)
    assert [(r["doc_id"], r["doc_start"], r["char_start"]) for r in got.orderBy("doc_start").collect()] == [(50, 2, 11), (50, 8, 45)]
    assert rows(license_scan.scan(clashing(docs))) == rows(got)
    assert license_scan.scan(docs, {}).count() == 0 and license_scan.scan(docs, {"t": "", "u": "two words"}).count() == 0 and license_scan.scan(docs.limit(0)).count() == 0
    monkeypatch.setattr(license_scan, "BLOCK_TERMS", 10)
    assert rows(license_scan.scan(docs)) == rows(got)


DAY = dt.datetime(2024, 1, 1)
ENTRIES = "list string, kind string, pattern string, action string, dated timestamp"
CAPTURES = "page_id long, url string, fetched timestamp"


def verdict_by_hand(url, at, entries):
    host, path = url_parts(url)
    if at is None or not host:
        return False, 0
    active = []
    for lst, kind, domain, path_ in {(e[0], e[1], *pattern_parts(e[2])) for e in entries if None not in e}:
        own = [(e[4], e[3]) for e in entries if None not in e and (e[0], e[1], *pattern_parts(e[2])) == (lst, kind, domain, path_) and e[4] <= at]
        if own and max(own)[1] == "add" and (host == domain or host.endswith("." + domain)) and (path == path_ or path.startswith(path_ + "/") or not path_):
            active.append((-len(domain), -len(path_), kind, lst))
    return bool(active) and min(active)[2] == "block", len(active)


def url_parts(url):
    import urllib.parse as p

    if url is None:
        return "", ""
    x = p.urlsplit(url)
    return (x.hostname or "").rstrip("."), x.path.rstrip("/")


def pattern_parts(pattern):
    domain, slash, path = pattern.partition("/")
    return domain.lower(), (slash + path).rstrip("/")


def test_urls_against_brute_force(spark):
    rng = random.Random(2)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "ab.org", "c.net"]
    paths = ["", "/", "/p", "/p/q", "/pq", "/p/q/r?x=1", "/P"]
    captures = [(i, f"http{'s' * (i % 2)}://{rng.choice(hosts).upper() if i % 5 == 0 else rng.choice(hosts)}{':80' * (i % 3 == 0)}{rng.choice(paths)}", DAY + dt.timedelta(days=rng.randrange(20))) for i in range(300)]
    entries = [(rng.choice("LM"), rng.choice(["block", "allow"]), rng.choice(hosts) + rng.choice(["", "", "/p", "/p/q"]), rng.choice(["add", "add", "remove"]), DAY + dt.timedelta(days=rng.randrange(20))) for _ in range(60)]
    got = url_filters.evaluate(spark.createDataFrame(captures, CAPTURES), spark.createDataFrame(entries, ENTRIES)).collect()
    want = {i: verdict_by_hand(u, t, entries) for i, u, t in captures}
    assert {r["page_id"]: (r["blocked"], r["active"]) for r in got} == want and 20 < sum(b for b, _ in want.values()) < 280


def test_urls_hard_cases(spark, monkeypatch):
    captures = spark.createDataFrame([(1, "http://a.com/", DAY), (1, "http://a.com/", DAY), (None, "http://u:p@A.com:8/x", DAY), (2, None, DAY), (3, "http://a.com", None), (4, "nonsense", DAY), (5, "", DAY), (6, "//a.com./" + "y" * 100_000, DAY)], CAPTURES)
    entries = spark.createDataFrame([("l", "block", "a.com", "add", DAY), ("l", "block", "a.com", "add", DAY), (None, "block", "a.com", "remove", DAY), ("l", "block", None, "add", DAY), ("l", "block", "", "add", DAY), ("l", "odd", "a.com", "add", DAY), ("l", "block", "a.com", "remove", None)], ENTRIES)
    out = url_filters.evaluate(captures, entries)
    assert sorted((r["page_id"] or 0, r["blocked"], r["active"]) for r in out.collect()) == [(0, True, 1), (1, True, 1), (1, True, 1), (2, False, 0), (3, False, 0), (4, False, 0), (5, False, 0), (6, True, 1)]
    late = spark.createDataFrame([("l", "block", "a.com", "add", DAY), ("l", "block", "a.com", "remove", DAY)], ENTRIES)
    assert url_filters.evaluate(captures, late).where("blocked").count() == 0
    assert url_filters.evaluate(captures, entries.limit(0)).where("blocked").count() == 0 and url_filters.evaluate(captures.limit(0), entries).count() == 0
    from pyspark.sql import functions as F

    more = captures.select("*", F.lit("x").alias("domain"), F.lit("x").alias("active"), F.lit("x").alias("won"), F.lit("x").alias("host"))
    assert rows(url_filters.evaluate(more, entries)) == rows(out)
    monkeypatch.setattr(storage, "BROADCAST_BYTES", 0)
    assert rows(url_filters.evaluate(captures, entries)) == rows(out)


STRINGS = warc.RECORD.replace("binary", "string")


def transactions_by_hand(records):
    ids = {r[0] for r in records if r[0] is not None}
    group = {i: {i} for i in ids}
    for r in records:
        for to in r[4] or [] if r[0] is not None else []:
            if to is not None:
                joined = group.setdefault(r[0], {r[0]}) | group.setdefault(to, {to})
                for x in joined:
                    group[x] = joined
    return {frozenset(g & ids) for g in group.values() if g & ids}


def test_transactions_against_brute_force(spark):
    rng, records = random.Random(9), []
    for t in range(60):
        names = [f"<{t}-{k}>" for k in range(rng.randint(1, 5))]
        kinds = ["response", "request", "metadata", "odd", None]
        for k, n in enumerate(names):
            to = [rng.choice(names[:k])] if k else rng.choice([None, [], ["<gone>" + n], [n]])
            records.append((n, kinds[k] if t % 7 else kinds[k + 1 if k < 4 else 4], DAY + dt.timedelta(seconds=k), f"http://h/{t}", to, f"payload {n}"))
    rng.shuffle(records)
    out = warc.assemble(spark.createDataFrame(records, STRINGS)).collect()
    got = {frozenset(x["record_id"] for x in ([r["response"]] if r["response"] else []) + r["requests"] + r["metadata"] + r["others"]) for r in out}
    assert got == transactions_by_hand(records) and len(out) == 60
    for r in out:
        assert r["response"] is None or (r["capture_id"] == r["response"]["record_id"] and r["response"]["payload"] == f"payload {r['capture_id']}")
        assert [x["record_id"] for x in r["others"]] == sorted(x["record_id"] for x in r["others"])


def test_transactions_hard_cases(spark):
    records = [
        ("r1", "response", DAY, "u", None, "first"), ("r1", "response", DAY, "u", ["q1"], "first"), ("q1", "request", DAY, "u", ["gone"], None), ("m1", "metadata", None, None, ["gone", None, "m1"], ""),
        ("r2", "revisit", DAY, "u2", ["r3"], "x" * 1_000_000), ("r3", "response", DAY, "u3", [], None), ("q3", "request", DAY, "u3", ["r3"], "q"), (None, "request", DAY, "u", ["r1"], "lost"),
        ("alone", "request", DAY, "u4", None, "p"), ("odd", None, None, None, None, None),
    ]
    df = spark.createDataFrame(records, STRINGS)
    by = {r["capture_id"]: r for r in warc.assemble(df).collect()}
    assert set(by) == {"r1", "r2", "r3", "alone", "odd"}
    assert [x["record_id"] for x in by["r1"]["requests"] + by["r1"]["metadata"]] == ["q1", "m1"]
    assert [x["record_id"] for x in by["r2"]["requests"]] == ["q3"] and by["r3"]["requests"] == [] and len(by["r2"]["response"]["payload"]) == 1_000_000
    assert by["alone"]["response"] is None and by["alone"]["target_uri"] == "u4" and by["odd"]["others"][0]["record_id"] == "odd"
    from pyspark.sql import functions as F

    more = df.select("*", *[F.lit("x").alias(c) for c in ("root", "capture_id", "copies", "response", "answer")])
    assert rows(warc.assemble(more)) == rows(warc.assemble(df))
    assert warc.assemble(df.limit(0)).count() == 0


@pytest.mark.parametrize("zipped", [False, True])
def test_warc_round_trip(spark, tmp_path, zipped):
    given = [("<r>", "response", "2024-01-01T00:00:00Z", "http://h/", [], "HTTP/1.1 200 OK\r\nA: é\r\n\r\nWARC/1.1\r\nnot a record é".encode() + b"\xff\x00\x1f\x8b"), ("<q>", "request", "2024-01-01T00:00:00Z", "http://h/", ["<r>"], b"GET / HTTP/1.1\r\n\r\n"), ("<m>", "metadata", "bad", "http://h/", ["<q>", "<r>"], b""), ("<big>", "resource", "2024-01-01T00:00:00Z", "http://h/2", [], bytes(range(256)) * 20_000)]
    parts = [warc.write_record(*g) for g in given]
    name = "a.warc.gz" if zipped else "a.warc"
    (tmp_path / name).write_bytes(b"".join(gzip.compress(p) if zipped else p for p in parts))
    back = warc.read_warc(spark, str(tmp_path / name))
    assert [(r["record_id"], r["type"], r["concurrent_to"], bytes(r["payload"])) for r in back.collect()] == [(g[0], g[1], g[4], g[5]) for g in given]
    assert back.where("record_id = '<m>'").first()["date"] is None
    out = {r["capture_id"]: r for r in warc.assemble(back).collect()}
    assert set(out) == {"<r>", "<big>"} and len(out["<r>"]["requests"]) == 1 and len(out["<r>"]["metadata"]) == 1 and bytes(out["<big>"]["response"]["payload"]) == given[3][5]
    from pyspark.sql import functions as F

    http = {r["record_id"]: r["x"] for r in back.select("record_id", warc.http_parts(F.col("payload")).alias("x")).collect()}
    assert http["<r>"]["status"] == 200 and http["<r>"]["head"].startswith("HTTP/1.1 200 OK\r\nA: ") and bytes(http["<r>"]["body"]) == given[0][5].split(b"\r\n\r\n", 1)[1]
    assert http["<q>"]["status"] is None and bytes(http["<q>"]["body"]) == b"" and http["<m>"]["head"] is None and bytes(http["<big>"]["body"]) == given[3][5]
    whole = (tmp_path / name).read_bytes()
    (tmp_path / name).write_bytes(whole[: len(whole) - len(whole) // 20])
    assert warc.read_warc(spark, str(tmp_path / name)).where("type <> 'resource'").count() == 3


def test_pages_as_records(spark):
    pages = spark.createDataFrame([(1, "http://h/a?b", "<p>é</p>"), (2, "http://h/", None), (None, "http://h/", "x")], "page_id long, url string, html string")
    out = {r["target_uri"]: r for r in warc.assemble(warc.records_of_pages(pages)).collect()}
    assert set(out) == {"http://h/a?b", "http://h/"} and out["http://h/a?b"]["response"]["payload"] == "<p>é</p>"
    assert all(len(r["requests"]) == len(r["metadata"]) == 1 for r in out.values())
