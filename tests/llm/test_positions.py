"""Positional index, periodic runs and collocations against brute force, on small tables and odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from lintlake.llm import collocations, periodic, positional_index, queries

DATA = "/root/testdata/sf0.001"
UPPER = {c: c + 32 for c in range(65, 91)}
DOCUMENT = "doc_id bigint, text string, lang string, row string, runs string, start string"
LONG = "alpha beta gamma delta " * 3000
ODD = [
    (1, None), (2, ""), (3, "one two three four five six seven eight nine ten eleven"), (3, "one two three four five six seven eight nine ten eleven"), (None, "no id but two words"),
    (4, LONG), (5, "É é É é É é É é É é É é É é"), (6, "A-b. C"), (7, "\t\x0b \n"), (8, "x " * 11), (9, "x " * 12), (10, "two words, one two three four five six seven eight nine TEN two words"),
    (12, "aa bb " * 7 + "aa aa aa " + "bb aa " * 8),
]
ITEMS = [("b2", "two words"), ("b1", "One two three four five six seven eight nine ten. Eleven twelve"), ("b3", None), ("b4", ""), (None, "c"), ("b5", "two words"), ("b5", "two words"), ("b6", "É"), ("b7", "absent here")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", "r", "u", "s") for i, t in ODD], DOCUMENT)


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def rows_of(frame):
    return sorted(map(repr, (tuple(r) for r in frame.collect())))


def test_contamination_by_hand(spark, odd):
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id string, text string, doc_id string")

    def by_hand(text):
        w, hit, found = item_words(text), set(), set()
        for name, own in ITEMS:
            own = item_words(own)
            m = min(10, len(own))
            for s in range(len(own) - m + 1) if own else []:
                for k in range(len(w) - m + 1):
                    if w[k : k + m] == own[s : s + m]:
                        hit |= set(range(k, k + m))
                        found |= {name} - {None}
        return len(w), len(hit), len(found), sorted(found)

    got = positional_index.contamination(odd, items).drop("n_near")
    assert rows_of(got) == sorted(repr((i, *by_hand(t))) for i, t in ODD)
    none = spark.createDataFrame([], "item_id string, text string")
    assert {r["n_hit"] for r in positional_index.contamination(odd, none).collect()} == {0}
    assert positional_index.contamination(odd.limit(0), items).count() == 0


def test_phrases_and_proximity_by_hand(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(60))) for _ in range(40)]
    index = positional_index.built(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    ids = {r["row"]: r["doc_id"] for r in index.rows.collect()}
    phrases = [[rng.choice("abcdefgh") for _ in range(rng.randrange(1, 6))] for _ in range(30)]
    phrases = [list(p) for p in sorted(set(map(tuple, phrases)))]
    got = positional_index.phrase_matches(index, spark.createDataFrame(list(enumerate(phrases)), "phrase int, gram array<string>"))
    wanted = [(d, n, k, k + len(p)) for d, t in enumerate(texts) for n, p in enumerate(phrases) for w in [t.split()] for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
    assert sorted((ids[r["row"]], r["phrase"], r["start"], r["past"]) for r in got.collect()) == sorted(wanted)

    groups = [sorted(rng.sample("abcdefgh", rng.randrange(1, 5))) for _ in range(12)] + [["a", "absent"]]
    near = positional_index.proximity_matches(index, spark.createDataFrame([(n, t) for n, g in enumerate(groups) for t in g], "grp int, term string"), 6)
    wanted = [(d, n, k) for d, t in enumerate(texts) for n, g in enumerate(groups) for w in [t.split()] for k, x in enumerate(w) if x in g and set(g) <= set(w[k : k + 6])]
    assert sorted((ids[r["row"]], r["grp"], r["start"]) for r in near.collect()) == sorted(wanted)
    index.dropped()


def test_index_plan_has_no_python(spark, odd, capsys):
    items = spark.createDataFrame([("b1", "two words")], "item_id string, text string")
    positional_index.contamination(odd, items).explain("formatted")
    assert not re.search("EvalPython|InArrow|InPandas|CartesianProduct|BroadcastNestedLoop", capsys.readouterr().out)


def brute_runs(w, least):
    out = []
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - p:
            s = i
            while i < len(w) - p and w[i] == w[i + p]:
                i += 1
            m = i - s + p
            if i > s and m >= max(least, 2 * p) and all(any(w[s + x] != w[s + x + q] for x in range(m - q)) for q in range(1, p)):
                out.append((s, m, p))
            i += i == s
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_of_random_words(least):
    rng = random.Random(least)
    for _ in range(700):
        w = [rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(rng.randrange(70))]
        if w and rng.random() < 0.5:
            a, p = rng.randrange(len(w)), rng.randrange(1, 20)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        assert periodic.word_runs(w, periodic.RunRules(least)) == brute_runs(w, least)


def test_runs_when_hashes_clash(monkeypatch):
    """With a base of 0 every hash is that of the last word, so only the check of the words can find the error."""
    monkeypatch.setattr(periodic, "_BASE", 0)
    rng = random.Random(9)
    for _ in range(200):
        w = [rng.randrange(2) for _ in range(80)]
        own = periodic._lyndon_runs(w, 12, periodic._DirectExtensions(w))
        assert sorted(own) == sorted(brute_runs(w, 12)) and periodic._verified(w, own)
    w = [0] * 9 + [1] + [0] * 9 + [2] + [0] * 9 + [1]
    assert not periodic._verified(w, {(0, 30, 10)})


def test_long_runs_take_little_time():
    assert periodic.word_runs(["a"] * 30_000) == [(0, 30_000, 1)]
    assert periodic.word_runs([k % 50 for k in range(30_000)]) == [(0, 30_000, 50)]


def test_periodic_runs_query(spark, odd, tmp_path):
    def by_hand(doc_id, text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(w), -1 if doc_id is None else zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs = brute_runs(w, 12) if n < 2000 else periodic.word_runs(w)
        gone = {i for s, m, p in runs for i in range(s + p, s + m)}
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        return (
            doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{m},{p}\n" for s, m, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
        )

    more = [(k, " ".join(random.Random(k).choice("ab cd ef".split()) for _ in range(k % 60))) for k in range(20, 200)]
    docs = odd.union(spark.createDataFrame([(i, t, "en", "r", "u", "s") for i, t in more], DOCUMENT))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_periodic_runs(spark, str(tmp_path))
    assert rows_of(got) == sorted(repr(by_hand(i, t)) for i, t in [*ODD, *more])
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in more) > 5
    found = periodic.periodic_runs(odd.limit(0), ["doc_id", "runs"])
    assert found.count() == 0 and found.columns[:2] == ["doc_id", "runs"]


def brute_collocations(docs, rules, top):
    n, f = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, rules.most_words + 1):
                f.update((lang, tuple(w[k : k + m])) for k in range(len(w) - m + 1))
    f = {k: v for k, v in f.items() if v >= rules.least}
    rows = defaultdict(list)
    for (lang, w), a in f.items():
        if len(w) > 1:
            score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            inside = lambda v: any(v[x : x + len(w)] == w for x in range(len(v) - len(w) + 1))
            if not any(o == lang and len(v) > len(w) and 100 * b >= rules.absorbed_percent * a and inside(v) for (o, v), b in f.items()):
                rows[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return [(lang, r, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang in rows for r, x in enumerate(sorted(rows[lang])[:top], 1)]


@pytest.mark.parametrize(("segment", "percent", "words"), [(4_000_000, 100, 5), (40, 100, 5), (40, 60, 3)])
def test_collocations_by_hand(spark, segment, percent, words):
    rng = random.Random(segment + percent)
    vocabulary, marks = ["the", "The", "of", "Éa", "éa", "x y", "\U0001d518", "of\x00"], [" ", " ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "!"]
    docs = [("".join(rng.choice(vocabulary) + rng.choice(marks) for _ in range(rng.randrange(40))), rng.choice(["en", "en", "en", "de", None, ""])) for _ in range(150)]
    docs += [(None, "en"), ("", None), ("the of the of", "und")] + [("hot group of copies here", "en")] * 60 + [("the of " * 300, "en")]
    rules = collocations.CollocationRules(least=4, absorbed_percent=percent, most_words=words, segment_words=segment)
    frame = spark.createDataFrame([(k, t, lang, "x", 1) for k, (t, lang) in enumerate(docs)], "doc_id int, text string, lang string, phrase string, seg int")
    for top in (2000, 3):
        assert rows_of(collocations.collocations(frame, top, rules)) == sorted(map(repr, brute_collocations(docs, rules, top)))


def test_scores_past_64_bits(spark):
    totals = spark.createDataFrame([("en", 3 * 10**13)], "lang string, n bigint")
    found = spark.createDataFrame([("en", 2, "a b", 7 * 10**10), ("en", 1, "a", 9 * 10**12), ("en", 1, "b", 11 * 10**12)], "lang string, size int, phrase string, f bigint")
    got = collocations.scored_phrases(totals, found).first()
    assert got["score"] == 1000 * 7 * 10**10 * 3 * 10**13 // (9 * 10**12 * 11 * 10**12)


def test_rare_words_give_no_phrases(spark):
    frame = spark.createDataFrame([(1, "one two three", "en")], "doc_id int, text string, lang string")
    assert collocations.collocations(frame).count() == 0 == collocations.collocations(frame.limit(0)).count()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    got = queries.QUERIES[name](spark, DATA)
    assert rows_of(got) == sorted(map(repr, db.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()))


def test_lists_of_a_segment_move_in_one_block_for_a_bucket():
    """However many phrases there are, a segment has no more rows than buckets; the blocks hold every place of every pair."""
    rng = np.random.default_rng(6)
    ids, words = np.sort(rng.choice(10**12, 300, replace=False)), rng.integers(0, 300, 5000).astype(np.int32)
    at = np.flatnonzero(rng.random(4999) < 0.8)
    for kind, width in ((np.int32, 4), (np.int64, 8)):
        places = np.arange(5000, dtype=kind) * 7
        got = collocations._blocks(9, 4, ids, words, places, at).to_pylist()
        assert len(got) == len({r["bucket"] for r in got}) == 4 and {r["seg"] for r in got} == {9}
        found = []
        for r in got:
            a, b, counts, own = collocations._unpacked(r["data"], r["n"], 2, width)
            assert len(a) == r["n"] and len(own) == counts.sum() == r["size"]
            found += zip(np.repeat(a, counts).tolist(), np.repeat(b, counts).tolist(), own.tolist(), strict=True)
        assert sorted(found) == sorted((int(ids[words[k]]), int(ids[words[k + 1]]), int(places[k])) for k in at)
