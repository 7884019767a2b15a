"""License scans, periodic runs and the filter audit against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest

from outlyr.llm import filter_audit, license_scan, queries, word_runs

CLASH = ["row", "licence", "base", "part", "A", "E", "n", "mask", "digest", "t", "w", "template", "own", "share", "start", "first", "rows"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`own {c}` string, `{c}` string" for c in CLASH if c not in ("A", "t")) + ", `A` string, `t` string"
N_EXTRA = 2 * (len(CLASH) - 2) + 2
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
TEXTS = [
    "Some words. Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0. And licensed under CC BY 4.0", "this work: GNU GENERAL PUBLIC LICENSE; gnu general public license, version 3",
    "This work is licensed under the GNU General Public License, version 3.", MIT, MIT.replace("hereby granted", "hereby, as said, granted"), "head " + MIT.replace("any person obtaining", "any person who is obtaining"),
    "the mit licenses", "MIT\x00License", "mit licenseé", "Released under the MIT License. " * 40, "mit license", "ccéby", "apache license version two", "license " * 30, None, "", " \t\n",
    "AAAA BBBB # cc", "x " * 300, "a b c " * 5, "a b a b a b c a b a b a b", " ".join("abcab"[i % 5] for i in range(120)) + " end", "漢字 漢字 漢字 漢字 漢字 漢字 é",
]


def rows():
    r = random.Random(5)
    out = [(i, t, ["en", "fr", None, ""][i % 4]) for i, t in enumerate(TEXTS * 3)]
    for i in range(100, 160):  # the planted repeats
        out.append((i, " ".join(r.choice("abcdefgh") for _ in range(r.randrange(300))), "en"))
    out += [(None, "no id a b a b a b a b a b", "en"), (None, TEXTS[0], "xx"), (3, TEXTS[3], "en"), (-4, "a " * 20, "de")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*x, None, None, *["x"] * N_EXTRA) for x in rows()], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 3) for i in range(0, 60)] + [(None, 1, 1), (3, None, 1), (4, 1, None), (500, 1, 1)], "doc_id long, quality int, toxic int")


# 11


def licence_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def spots(ws, phrase):
    p = phrase.split()
    return [i for i in range(len(ws)) if ws[i : i + len(p)] == p]


def judged(t, rarest):
    """Labels and score of one text, by looking at every place of every template."""
    ws = licence_words(t)
    base = {p: spots(ws, p) for p in license_scan.PHRASES}
    own, best = {license_scan.PHRASES[p] for p, s in base.items() if s}, 0.0
    for label, text, keys in license_scan.TEMPLATES:
        tw = text.split()
        look = sorted(set(tw) & set(ws), key=rarest.index)[: license_scan.RARE]
        for o in {x - p for x, w in enumerate(ws) for p, v in enumerate(tw) if w == v and w in look}:
            agree = sum(w in look and 0 <= o + p < len(ws) and ws[o + p] == w for p, w in enumerate(tw))
            near = lambda key, o=o, tw=tw: any(abs(s - o - spots(tw, key)[0]) <= license_scan.SLACK for s in spots(ws, key))
            if agree < license_scan.NEED or not all(map(near, keys)):
                continue
            share = sum(any(0 <= x < len(ws) and ws[x] == w for x in range(o + p - license_scan.SLACK, o + p + license_scan.SLACK + 1)) for p, w in enumerate(tw)) / len(tw)
            if share >= license_scan.ACCEPT:
                own.add(label)
                best = max(best, share)
    places = sorted(x for s in base.values() for x in s)
    first = {license_scan.PHRASES[p] for p, s in base.items() if s}
    return len(ws), len(places), places[0] if places else None, places[-1] if places else None, ",".join(sorted(first)), ",".join(sorted(own)), 1.0 if places else best


def test_licenses(docs):
    files = license_scan.scanned(docs).cache()
    seen = {w: sum(w in set(licence_words(t)) for _, t, _ in rows()) for w in license_scan.VOCABULARY}
    rarest = sorted(license_scan.VOCABULARY, key=lambda w: (seen[w], w))
    assert [license_scan.VOCABULARY[k] for k in license_scan.rarity(files)] == rarest
    got = sorted(map(repr, ((r[0], *r[1:-1], pytest.approx(r[-1]).expected) for r in license_scan.scan(docs).collect())))
    assert got == sorted(repr((d, *judged(t, rarest))) for d, t, _ in rows())
    found = {r.doc_id: r for r in license_scan.scan(docs.where("doc_id < 24")).collect()}
    assert [found[i].labels for i in (0, 1, 3, 4, 5, 6, 7, 8, 11)] == ["apache,apache-2.0", "cc-by,cc-by-4.0,cc-by-nc-4.0", "gpl,gpl-3.0", "mit", "", "mit", "", "mit", "mit"]
    assert found[15].n_words == 0 and found[15].labels == "" and found[15].first_word is None and found[10].n_base == 40


def test_templates_hold_their_phrases():
    for _, text, keys in license_scan.TEMPLATES:
        assert all(f" {k} " in f" {text} " for k in keys) and text == " ".join(licence_words(text))


# 12


def brute_runs(ws):
    out = {}
    for q in range(1, len(ws) // word_runs.EXPONENT + 1):
        i = 0
        while i + q < len(ws):
            s = i
            while i + q < len(ws) and ws[i] == ws[i + q]:
                i += 1
            if i - s + q >= max(word_runs.SHORTEST, word_runs.EXPONENT * q):
                out.setdefault((s, i - s + q), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in out.items())


def changed(ws, doc_id):
    n, h = len(ws), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return ws
    a, g = h // 10 % n, h // 10
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]


def test_runs(docs):
    exp, planted = [], 0
    for d, t, _ in rows():
        own = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        ws = changed(own, d)
        planted += ws != own
        found = brute_runs(ws)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None, None, None)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        exp.append((d, len(ws), len(found), *best, found and 1000 * best[1] // best[2] or None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for i, w in enumerate(ws) if i not in gone))))
    assert planted > 5
    assert sorted(map(repr, map(tuple, word_runs.repetitions(docs).collect()))) == sorted(map(repr, exp))


@pytest.mark.parametrize("scan", [1, 2, 8])
def test_refinement_finds_all_runs(monkeypatch, scan):
    """Many small texts together, of few letters, with stretches repeated inside; the table of distances from several levels on."""
    monkeypatch.setattr(word_runs, "SCAN", scan)
    r = random.Random(scan)
    for _ in range(60):
        texts = []
        for _ in range(r.randrange(1, 8)):
            w = [r.randrange(r.choice([1, 2, 3, 30])) for _ in range(r.randrange(120))]
            for _ in range(r.randrange(4) if w else 0):
                a, p = r.randrange(len(w)), r.randrange(1, 12)
                for i in range(a + p, min(len(w), a + r.randrange(60))):
                    w[i] = w[i - p]
            texts.append(w)
        codes, sizes = np.array([x for w in texts for x in w], np.int64), np.array([len(w) for w in texts], np.int64)
        assert [tuple(x) for x in word_runs.runs(codes, sizes).tolist()] == [(t, *x) for t, w in enumerate(texts) for x in brute_runs(w)]


def test_runs_of_long_texts(spark, monkeypatch):
    """Long periods, a word repeated very often, and the moves of positions that smaller halves allow."""
    n = 60_000
    r = random.Random(1)
    stretch = [f"w{r.randrange(10**9)}" for _ in range(n // 5)]
    got = word_runs.repetitions(spark.createDataFrame([(1, " ".join(stretch * 5)), (2, "same " * 300_000), (3, "a b " * n)], "doc_id long, text string"), lambda ws, _: ws).orderBy("doc_id").collect()
    assert [(x.n_runs, x.start, x.length, x.period) for x in got] == [(1, 0, n, n // 5), (1, 0, 300_000, 1), (1, 0, 2 * n, 2)]
    moves, refine = [0], word_runs.Refinement._swap
    monkeypatch.setattr(word_runs.Refinement, "_swap", lambda self, moved, *a: (moves.__setitem__(0, moves[0] + len(moved)), refine(self, moved, *a))[1])
    fib = [0, 1]
    while len(fib) < 4000:
        fib = [0 if x == 1 else y for x in fib for y in ((0,) if x == 1 else (0, 1))]
    word_runs.runs(np.array(fib), np.array([len(fib)]))
    assert moves[0] <= 2 * len(fib) * np.log2(len(fib))


# 13


def test_filter_audit(docs, labels):
    marks = {"q": {i for i in range(60) if i % 2 == 1} | {3, 4, 500}, "t": {i for i in range(60) if i % 3 == 1} | {3, 500}}
    kinds = []
    for d, t, lang in rows():
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        e = d is not None and any(x is not None and x < d and (y or "") == t for x, y, _ in rows())
        fails = "A" * (len(ws) < 200) + "B" * (100 * len(set(ws)) < 50 * len(ws)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 3 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t)) + "E" * e
        kinds.append((lang or "", fails, d in marks["q"], d in marks["t"]))
    exp = []
    for part in {k[0] for k in kinds}:
        own = [k for k in kinds if k[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        found = []
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order):
                gone = [k for k in left if f in k[1]]
                left = [k for k in left if f not in k[1]]
                total[f] += len(gone)
                found.append((part, "".join(order), step + 1, len(left), len(gone), sum(f in k[1] for k in own) - len(gone), sum(k[1] == f for k in own), sum(k[2] for k in gone), sum(k[3] for k in gone)))
        exp += [(*x, total[x[1][x[2] - 1]]) for x in found]
    got = filter_audit.audit(docs, labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == sorted(exp)
    assert filter_audit.audit(docs, labels.limit(0)).where("good_lost > 0").count() == 0


def test_nothing_gives_nothing(docs, labels):
    none = docs.limit(0)
    assert not license_scan.scan(none).collect() and not word_runs.repetitions(none).collect() and not filter_audit.audit(none, labels).collect()


def test_a_hot_text_and_a_long_one(spark, labels):
    """Copies of one text are a third of all rows, and a text of 3 MB is taken whole."""
    long = "Licensed under CC BY 4.0. " * 120_000
    df = spark.range(900).selectExpr("id doc_id", "if(id % 3 = 0, 'copy', concat('text ', id)) text", "'en' lang").union(spark.createDataFrame([(5000, long, "en")], "doc_id long, text string, lang string"))
    got = filter_audit.audit(df, labels).where("filter_order = 'EABCD' and step = 1").first()
    assert (got.kept, got.removed) == (602, 299)
    assert license_scan.scan(df).where("doc_id = 5000").first().n_base == 120_000
    assert word_runs.repetitions(df, lambda ws, _: ws).where("doc_id = 5000").first().period == 5


@pytest.mark.parametrize("name", ["op11_license_scan", "op12_word_runs", "op13_filter_audit"])
def test_queries_agree_with_their_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    found = con.execute(queries.ORACLE[name])
    names = [x[0] for x in found.description]
    theirs = sorted(repr(tuple(r[names.index(c)] for c in df.columns)) for r in found.fetchall())
    assert sorted(repr(tuple(r)) for r in df.collect()) == theirs
