import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lattice.llm import periodic_runs as pr
from lattice.llm.queries import op11_periodic_runs

import cases


def brute(words, least=24):
    """Every run, straight from the definition: maximal stretches of each period that have no smaller one."""
    n, out = len(words), []
    for p in range(1, n // 3 + 1):
        i = 0
        while i < n - p:
            if words[i] != words[i + p]:
                i += 1
                continue
            start = i
            while i < n - p and words[i] == words[i + p]:
                i += 1
            length = i + p - start
            stretch = words[start : start + length]
            if length >= max(least, 3 * p) and not any(stretch[q:] == stretch[:-q] for q in range(1, p)):
                out.append((start, length, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def changed(doc_id, words):
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def digest(doc_id, text):
    words = changed(doc_id, [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w])
    runs = brute(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    kept = [w for i, w in enumerate(words) if not any(s + p <= i < s + n for s, n, p in runs)]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(kept)))


def pieces(rng, n, kinds):
    """Words with repeated stretches, some broken, some nested."""
    words = []
    while len(words) < n:
        part = rng.choices(range(kinds), k=rng.randint(1, 12))
        part = part * rng.choice([1, 1, 2, 3, 5, 9]) + part[: rng.randint(0, len(part))]
        words += part * rng.choice([1, 1, 1, 3])
        if rng.random() < 0.3:
            words[rng.randrange(len(words))] = rng.randrange(kinds)
    return words[:n]


def test_runs_equal_brute_force(monkeypatch):
    rng = random.Random(11)
    texts = [pieces(rng, rng.randint(0, 260), rng.choice([1, 2, 3, 20])) for _ in range(250)]
    for listed in (2048, 16):  # the stored grid, and one period after another
        monkeypatch.setattr(pr, "_LISTED", listed)
        pr._grid.cache_clear()
        for words in texts:
            assert pr.runs_of(np.array(words, np.int32)) == brute(words)
    pr._grid.cache_clear()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40), st.integers(1, 6), st.lists(st.integers(0, 2), max_size=10))
def test_runs_of_repeated_parts(part, times, tail):
    words = part * times + tail
    assert pr.runs_of(np.array(words, np.int32), 6) == brute(words, 6)


def test_long_runs_are_extended_whole():
    unit = list(range(700))
    words = np.array([-1, -2, *unit * 40, 3, 9, *[5] * 20_000], np.int32)
    assert pr.runs_of(words) == [(2, 28_000, 700), (28_004, 20_000, 1)]


def test_digests_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(f"w{w}" for w in pieces(rng, rng.randint(1, 300), rng.choice([2, 5, 50])))) for k in range(120)]
    rows += [(200, None), (201, ""), (202, " \t\r\n\v\f "), (203, "a b \u0085 " * 30), (None, "x " * 30), (7, "y z " * 20), (7, "y z " * 20), (204, "é ß\t漢字\n" * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, pr.run_digests(docs).collect()), key=key) == sorted((digest(*r) for r in rows), key=key)


def test_awkward_rows(spark):
    docs = cases.awkward(spark)
    assert pr.run_digests(docs).count() == docs.count() and pr.run_digests(cases.empty(spark)).count() == 0
    found = pr.periodic_runs(docs.withColumnRenamed("x", "runs"))
    assert [c for c in found.columns if c not in docs.columns] == ["runs", "collapsed"]
    assert all(r.collapsed == " ".join((r.text or "").split()) for r in found.where("doc_id <= 7").collect())


def test_query_equals_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: tuple(r) for r in op11_periodic_runs(spark, sf_dir).collect()}
    assert got.keys() == docs.keys()
    some = sorted((i for i in docs if len(docs[i] or "") < 6000), key=lambda i: zlib.crc32(str(i).encode()) % 10)
    assert some and all(got[i] == digest(i, docs[i]) for i in some)
