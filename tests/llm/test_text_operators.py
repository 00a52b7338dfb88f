"""Duplicates, decontamination, lines and toxicity against plain Python versions."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import LONG, awkward, distance, documents, empty, groups, near, shingles, split
from lattice.llm import queries, toxicity
from lattice.llm.decontaminate import ORACLE, contaminated
from lattice.llm.graph import connected_components
from lattice.llm.line_dedup import dedup_lines
from lattice.llm.minhash_dedup import near_duplicates
from lattice.llm.scratch import Scratch
from lattice.llm.substring_dedup import passages
from lattice.llm.suffix_dedup import LENGTH, remove_repeats
from lattice.llm.toxicity import toxicity_scores
from oracle import duckdb_rows, spark_rows


def texts_of(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def prose(rng, n):
    return [f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.randrange(3000)}" for _ in range(n)]


# near duplicates


def test_near_duplicates_are_those_of_all_pairs(spark, sf_dir):
    texts = texts_of(spark, sf_dir)
    want = near(texts)
    for r in queries.op3_minhash_near_dedup(spark, sf_dir).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(shingles(texts[r.doc_id])), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_near_duplicates_in_a_large_family(spark):
    rng = random.Random(3)
    base = prose(rng, 120)
    texts = {}
    for i in range(400):  # a family around one text, some members beyond reach of it but not of each other
        own = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 9])):
            own[rng.randrange(len(own))] = f"new{rng.randrange(40)}"
        texts[i] = " ".join(own)
    found = near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in found.collect()} == near(texts)


def test_near_duplicates_of_awkward_rows(spark):
    found = near_duplicates(awkward(spark)).collect()
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    assert len(found) == 12 and all(r.kept for r in found if r.doc_id is None)
    assert [by_id[i].n_shingles for i in (1, 2, 3, 4)] == [0, 0, 0, 1]
    assert [by_id[i].component_id for i in (1, 2, 3, 4, 5, 6, 7, 8, 9)] == [1, 2, 3, 4, 4, 6, 6, 8, 9]
    assert near_duplicates(empty(spark)).count() == 0


def test_texts_of_one_document_link_their_groups(spark):
    rng = random.Random(4)
    a, b, c = (" ".join(prose(rng, 40)) for _ in range(3))
    rows = spark.createDataFrame([(3, a), (5, a), (5, b), (7, b), (8, c), (8, "some other words stand here"), (9, c + " more")], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_duplicates(rows).collect()}
    assert found == {3: 3, 5: 3, 7: 3, 8: 8, 9: 8}


def test_components_of_a_path(spark):
    links = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = connected_components(links, Scratch(spark, "test")).collect()
    assert len(found) == 301 and {r.component for r in found} == {0}


# repeated bytes


def repeats(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(hash(x[i : i + LENGTH]) for x in data for i in range(len(x) - LENGTH + 1))
    out = []
    for x in data:
        gone = bytearray(len(x))
        for i in range(len(x) - LENGTH + 1):
            if seen[hash(x[i : i + LENGTH])] > 1:
                gone[i : i + LENGTH] = b"\1" * LENGTH
        kept = bytes(c for c, g in zip(x, gone) if not g)
        out.append((len(x), sum(gone), sum(g and not p for p, g in zip(b"\0" + gone, gone)), hashlib.sha256(kept).hexdigest(), any(gone)))
    return out


def test_repeated_bytes_of_the_table(spark, sf_dir):
    at = os.path.join(os.path.dirname(sf_dir), "sf0.01")
    texts = texts_of(spark, at)
    want = dict(zip(texts, repeats(texts.values())))
    found = queries.op5_suffix_dedup(spark, at).collect()
    assert len(found) == len(texts)
    assert {r.doc_id: tuple(r)[1:] for r in found} == want


@pytest.mark.parametrize("most", [20_000, 7, 1])
def test_repeated_bytes_of_hard_cases(spark, most):
    rng = random.Random(5)
    a, b, c = ("".join(rng.choices("abcdefgh é", k=k)) for k in (390, 600, 900))
    texts = [None, "", a + a, a + b, b + a + "!", c + "x" + c, "z" * 401, "z" * 399, "y" * 2000, c[:450], "q" + c[40:500] + "r", b[100:560] + c[:400], LONG, LONG]
    for _ in range(12):
        i, k = rng.randrange(300), rng.randrange(380, 500)
        texts.append("".join(rng.choices("mnop", k=rng.randrange(50))) + c[i : i + k] + "".join(rng.choices("mnop", k=30)))
    found = {r.doc_id: r for r in remove_repeats(documents(spark, *texts), most).collect()}
    for i, want in enumerate(repeats(texts)):
        assert tuple(found[i])[1:] == want, i
    assert found[6].n_removed == 401 and found[7].n_removed == 0
    assert found[12].kept_sha256 == hashlib.sha256(b"").hexdigest()


def test_spans_of_one_text_are_joined_within_a_context_only():
    import random

    import pyarrow as pa

    from lattice.llm.suffix_dedup import _expanded

    rng = random.Random(7)
    some = lambda n: bytes(rng.choices(b"abcdefgh ", k=n))
    anchor, left, right, other_left, other_right = some(100), some(8), some(300), some(3), some(300)
    rows = [  # the first context's repeated windows start 8 to 4 bytes before the anchor, the second one's 3 to 0
        (0, 1, 0, 0, left + anchor + right, 8, True),
        (0, 1, 0, 1000, other_left + anchor + other_right, 3, True),
        (0, 2, 0, 0, left + anchor + right[:296] + b"wxyz", 8, True),
        (0, 2, 0, 1000, b"z" + other_left + anchor + other_right, 4, True),
    ]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["anchor", "d", "x", "lo", "context", "at", "single"])
    found = [r for out in _expanded(iter([batch])) for r in zip(*[c.to_pylist() for c in out.columns])]
    assert [r for r in found if r[0] == 1] == [(1, 0, 0, 404), (1, 0, 1000, 1403)]


def test_repeated_bytes_of_awkward_rows(spark):
    found = remove_repeats(awkward(spark)).collect()
    assert len(found) == 12 and sum(r.n_removed > 0 for r in found) == 4
    assert remove_repeats(empty(spark)).count() == 0


# fuzzy passages


@pytest.mark.parametrize("every, least", [(16, 0.98), (8, 0.95), (6, 0.9)])
def test_edited_passages_are_found(spark, every, least):
    """Recall on 60 passages of 80 words of which the second document has every so many words changed."""
    rng = random.Random(every)
    texts = []
    for _ in range(60):
        a = prose(rng, 80)
        b = [w + "x" if i % every == every - 1 else w for i, w in enumerate(a)]
        texts += [" ".join(prose(rng, 60) + x + prose(rng, 60)) for x in (a, b)]
    found = {(r.doc_id, r.partner_id) for r in passages(documents(spark, *texts)).collect() if r.matches >= 40}
    assert sum((2 * i, 2 * i + 1) in found or (2 * i + 1, 2 * i) in found for i in range(60)) >= least * 60


def test_passages_cover_every_shared_run_of_fifty_words(spark, sf_dir):
    texts = {i: split(t) for i, t in texts_of(spark, sf_dir).items()}
    found = queries.op1_substring_dedup(spark, sf_dir).collect()
    covered = {}
    for r in found:
        covered.setdefault(r.doc_id, set()).update(range(r.from_word, r.to_word))
        covered.setdefault(r.partner_id, set()).update(range(r.partner_from, r.partner_to))
    where = {}
    for i, words in texts.items():
        for k in range(len(words) - 49):
            where.setdefault(tuple(words[k : k + 50]), set()).add(i)
    missed = [(i, k) for i, words in texts.items() for k in range(len(words) - 49) if len(where[tuple(words[k : k + 50])]) > 1 and len(covered.get(i, set()) & set(range(k, k + 50))) < 45]
    assert len(where) and not missed
    for r in found[:200]:
        x, y = texts[r.doc_id][r.from_word : r.to_word], texts[r.partner_id][r.partner_from : r.partner_to]
        assert max(len(x), len(y)) >= 40 and r.matches >= 0.8 * max(len(x), len(y))
        assert len(x) + len(y) - r.matches >= distance(x, y) if len(x) * len(y) < 40_000 else True


def test_an_edited_passage_is_found_and_prose_is_not(spark):
    rng = random.Random(1)
    passage = prose(rng, 80)
    edited = passage[:20] + ["other"] + passage[21:50] + passage[52:]
    texts = [prose(rng, 90) + passage + prose(rng, 30), prose(rng, 10) + edited, *[prose(rng, 200) for _ in range(5)]]
    found = passages(documents(spark, *[" ".join(t) for t in texts])).collect()
    assert {(r.doc_id, r.partner_id) for r in found} == {(0, 1), (1, 0)}
    one = next(r for r in found if r.doc_id == 0)
    assert (one.from_word, one.to_word, one.partner_from, one.partner_to, one.matches) == (90, 170, 10, 88, 77)


def test_edited_passages_of_forty_to_sixty_words_are_found(spark):
    rng = random.Random(11)
    texts, want = [], {}
    for k in range(60):
        passage = prose(rng, rng.randrange(40, 61))
        every = 5 + k % 6  # one word of 5 to 10: 80 to 90 %
        edited = [f"new{k}x{i}" if i % every == every - 1 else w for i, w in enumerate(passage)]
        pad = rng.randrange(5, 40)
        want[2 * k] = (pad, pad + len(passage) - (len(passage) % every == 0), 2 * k + 1)
        texts += [prose(rng, pad) + passage + prose(rng, 30), prose(rng, 20) + edited + prose(rng, 20)]
    found = passages(documents(spark, *[" ".join(t) for t in texts])).collect()
    for i, (start, end, partner) in want.items():
        held = [set(range(r.from_word, r.to_word)) for r in found if (r.doc_id, r.partner_id) == (i, partner)]
        assert len(set().union(*held) & set(range(start, end))) >= 0.9 * (end - start), i


def test_a_passage_whose_seeds_have_other_extreme_documents(spark):
    rng = random.Random(12)
    run = prose(rng, 50)
    texts = [prose(rng, 60) for _ in range(11)]
    for i, part in ((5, run), (6, run), (1, run[:25]), (9, run[:25]), (2, run[25:]), (10, run[25:])):
        texts[i] = texts[i][:30] + part + texts[i][30:]
    found = passages(documents(spark, *[" ".join(t) for t in texts])).collect()
    assert {(r.doc_id, r.partner_id, r.from_word, r.to_word) for r in found} == {(5, 6, 30, 80), (6, 5, 30, 80)}


def test_edited_passages_whose_every_seed_is_common_are_found(spark):
    """Every piece of six words also stands in a lower and in a higher document, so that neither copy is an extreme one of any seed."""
    rng = random.Random(21)
    run = prose(rng, 60)
    edited = [w + "x" if i % 12 == 11 else w for i, w in enumerate(run)]
    texts = [prose(rng, 80) for _ in range(82)]
    for i, part in ((40, run), (41, edited)):
        texts[i] = texts[i][:30] + part + texts[i][30:]
    for k in range(20):
        for i, of in ((k, run), (k + 20, edited), (k + 42, run), (k + 62, edited)):
            texts[i] = texts[i][:20] + of[3 * k : 3 * k + 6] + texts[i][20:]
    found = {(r.doc_id, r.partner_id): r for r in passages(documents(spark, *[" ".join(t) for t in texts])).collect()}
    assert set(found) == {(40, 41), (41, 40)}
    assert all(r.from_word <= 31 and r.to_word >= 88 and r.matches >= 54 for r in found.values())


def test_all_documents_of_a_seed_are_linked_part_by_part(spark, monkeypatch):
    from lattice.llm import substring_dedup

    rng = random.Random(22)
    common = prose(rng, 40)
    texts = [" ".join(prose(rng, 30) + common + prose(rng, 30)) for _ in range(7)]
    want = {(d, r, 30, 70, 30, 70, 40) for d in range(7) for r in range(7) if d != r}
    for part in (substring_dedup.PART, 300):  # one part, and several
        monkeypatch.setattr(substring_dedup, "PART", part)
        assert {tuple(r) for r in passages(documents(spark, *texts)).collect()} == want


def test_links_of_seeds_are_those_of_whole_groups():
    import random

    import pyarrow as pa

    from lattice.llm.substring_dedup import K, _linked

    rng = random.Random(5)
    seeds = sorted({(rng.randrange(-20, 20), rng.randrange(1, 9), rng.randrange(400)) for _ in range(400)} | {(99, 1, 5), (100, 2, 8), (100, 2, 6)})
    kinds = {h: h % 2 for h, _, _ in seeds}  # a seed has one length
    seeds = sorted({(h, d, at // 2 * 2 + kinds[h]) for h, d, at in seeds})
    want = []
    for h in kinds:
        own = [(d, at // 2) for g, d, at in seeds if g == h]
        ends = (min(own), min(x for x in own if x[0] == max(own)[0]))
        want += [(d, r, p + more, q + more) for d, p in own for r, q in ends if r != d and ends[0][0] != ends[1][0] for more in ((0, 30 - K) if kinds[h] else (0,))]
    for step in (1, 7, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*seeds[i : i + step]), (pa.int64(), pa.int64(), pa.int32()))], ["h", "d", "at"]) for i in range(0, len(seeds), step)]
        found = [r for out in _linked(30)(iter(batches)) for r in zip(*[c.to_pylist() for c in out.columns])]
        assert sorted(found) == sorted(want), step


def test_passages_do_not_depend_on_the_slices(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one, five = (sorted(tuple(r) for r in passages(docs, slices_of=n).collect()) for n in (1, 5))
    assert one and one == five


def test_passages_of_awkward_rows(spark):
    found = passages(awkward(spark)).collect()
    assert {(r.doc_id, r.partner_id, r.from_word, r.to_word) for r in found} == {(6, 7, 0, 6000), (7, 6, 0, 6000)}
    assert passages(empty(spark)).count() == 0


# decontamination


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_contamination_is_that_of_the_exact_join(spark, sf_dir, sf):
    at = os.path.join(os.path.dirname(sf_dir), sf)
    assert spark_rows(queries.op8_decontamination(spark, at)) == duckdb_rows(ORACLE, at)


def test_short_items_in_long_documents(spark):
    rng = random.Random(8)
    item = prose(rng, 24)
    docs = documents(spark, " ".join(prose(rng, 9000) + item + prose(rng, 9000)), " ".join(prose(rng, 50) + item[:18]), " ".join(prose(rng, 50) + item[:16]), "Only THREE words", None)
    items = spark.createDataFrame([(1, " ".join(item), 0), (2, "only three words", 0), (3, None, 0), (4, "", 0), (None, "x", 0)], "item_id long, text string, doc_id int")
    found = {(r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in contaminated(docs, items, percent=70).collect()}
    assert found == {(0, 1, 20, 20), (1, 1, 20, 14), (3, 2, 1, 1)}
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, items, percent=70, broadcast_items=0).collect()} == {(0, 1), (1, 1), (3, 2)}


def test_items_of_few_words_are_never_missed(spark):
    rng = random.Random(9)
    items = [prose(rng, 5 + i % 4) for i in range(8)]
    texts = [" ".join(prose(rng, 30 + k) + items[k % 8] + prose(rng, 40)) for k in range(400)]
    rows = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    want = {(k, k % 8) for k in range(400)}
    assert {(r.doc_id, r.item_id) for r in contaminated(documents(spark, *texts), rows).collect()} == want


def test_contamination_of_awkward_rows(spark):
    items = spark.createDataFrame([(1, "one two"), (2, None)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in contaminated(awkward(spark), items).collect()} == {(4, 1), (5, 1)}
    assert contaminated(empty(spark), items).count() == 0
    assert contaminated(awkward(spark), items.limit(0)).count() == 0


# lines


def test_lines_of_the_table_lose_every_exact_copy(spark, sf_dir):
    import re

    texts = texts_of(spark, sf_dir)
    done = {r.doc_id: r for r in queries.op10_line_dedup(spark, sf_dir).collect()}
    assert set(done) == set(texts)
    norm = lambda x: " ".join(re.findall(r"[^\W_]+", x.lower()))
    left = Counter(norm(x) for r in done.values() for x in (r.text or "").split("\n"))
    assert max(v for k, v in left.items() if k) == 1
    for i, r in done.items():
        old, new = (texts[i] or "").split("\n"), (r.text or "").split("\n")
        assert r.n_lines == len(old) and (r.n_removed == 0) == (r.text == texts[i])
        rest = iter(old)
        assert r.n_removed == len(old) or all(x in rest for x in new)


@pytest.fixture(scope="module")
def fuzzy(spark):
    """Twelve groups of five lines of 30 words, three of them equal when normalised and two with one word edited: normalised lines, groups, what stays."""
    rng = random.Random(10)
    lines = []
    for _ in range(12):
        base = " ".join(prose(rng, 30))
        lines += [base, base.upper() + "!", base.replace(" ", " - ", 2)]
        lines += [base[:-1], base[:40] + "z" + base[41:]]
    rng.shuffle(lines)
    found = {r.doc_id: r for r in dedup_lines(documents(spark, *lines)).collect()}
    norm = [" ".join("".join(c if c.isalnum() else " " for c in x.lower()).split()) for x in lines]
    links = [(i, j) for j in range(len(norm)) for i in range(j) if norm[i][:20] == norm[j][:20] and distance(norm[i], norm[j]) <= 0.1 * max(len(norm[i]), len(norm[j]))]
    return norm, groups(range(len(lines)), links), {i for i, r in found.items() if r.n_removed == 0}


def test_the_first_line_of_each_group_stays_and_copies_go(fuzzy):
    norm, want, stays = fuzzy
    first = {i for i, g in want.items() if i == g}
    assert len(first) == 12 and first <= stays
    assert not any(norm[j] == norm[i] for i in stays for j in stays if j < i)


def test_every_edited_line_goes(fuzzy):
    _, want, stays = fuzzy
    assert stays == {i for i, g in want.items() if i == g}


@pytest.mark.parametrize("kind", ["last letter", "any letter"])
def test_edited_lines_are_found(spark, kind):
    """Recall on lines of an edit similarity of 0.9 and more: all with one edited word, at least 0.9 of those with more, wherever in the word the edit is."""
    rng = random.Random(11)
    lines, kinds = [], []

    def edited(word):
        i = len(word) - 1 if kind == "last letter" else rng.randrange(len(word))
        return word[:i] + "x" + word[i + rng.choice([1] if kind == "last letter" else [0, 1, 1]) :]

    def put(n, edits, times):
        for _ in range(times):
            a = prose(rng, n)
            b = list(a)
            for i in rng.sample(range(n), edits):
                b[i] = edited(b[i])
            lines.extend([" ".join(a), " ".join(b)])
            kinds.append((n, edits))

    several = [(12, 2), (30, 2), (30, 3), (30, 4), (30, 6), (30, 10), (60, 6), (100, 10)]
    for n, edits, times in [(30, 1, 60), (8, 1, 60), (4, 1, 60), (5000, 1, 2), *[(*x, 60) for x in several]]:
        put(n, edits, times)
    found = {r.doc_id: r.n_removed for r in dedup_lines(documents(spark, *lines)).select("doc_id", "n_removed").collect()}
    near = [distance(lines[2 * i], lines[2 * i + 1]) <= 0.1 * max(len(lines[2 * i]), len(lines[2 * i + 1])) if n < 50 else True for i, (n, _) in enumerate(kinds)]
    share = {k: sum(found[2 * i + 1] for i, x in enumerate(kinds) if x == k and near[i]) / sum(near[i] for i, x in enumerate(kinds) if x == k) for k in set(kinds)}
    assert not any(found[2 * i] for i in range(len(kinds)))
    assert share[30, 1] == share[8, 1] == share[4, 1] == share[5000, 1] == 1
    assert all(share[k] >= 0.9 for k in several), share


def test_groups_of_any_shape_are_those_of_all_pairs(spark):
    """Chains, stars and single lines of one to forty words: what stays is the first line of each group by all pairs."""
    rng = random.Random(12)
    lines = []
    for n in (1, 2, 3, 5, 9, 16, 25, 40):
        for shape in ("chain", "star", "alone"):
            base = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(6, 12))) for _ in range(n)]
            here = [base]
            for _ in range({"chain": 5, "star": 5, "alone": 0}[shape]):
                b = list(here[-1] if shape == "chain" else base)
                i = rng.randrange(n)
                b[i] = b[i][:3] + rng.choice("xyz") + b[i][4:]
                here.append(b)
            lines += [" ".join(x) for x in here]
    rng.shuffle(lines)
    near = [(i, j) for j in range(len(lines)) for i in range(j) if abs(len(lines[i]) - len(lines[j])) <= 30 and distance(lines[i], lines[j]) <= 0.1 * max(len(lines[i]), len(lines[j]))]
    want = groups(range(len(lines)), near)
    found = {r.doc_id: r.n_removed for r in dedup_lines(documents(spark, *lines)).select("doc_id", "n_removed").collect()}
    assert {i for i, n in found.items() if not n} == {i for i, g in want.items() if i == g}


def test_all_similar_lines_with_one_run_of_words_are_found(spark):
    """Four words in a row in lines of 43 short words, eight in longer lines; the words around are edited everywhere, so that few blocks or one are shared."""
    rng = random.Random(13)
    word = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    lines, edited = [], lambda w: w[:-1] + ("x" if w[-1] != "x" else "z")
    for _ in range(100):
        a = [word(rng.choice([4, 5])) for _ in range(43)]  # edits two words apart but for one run of four
        at = rng.randrange(5, 35)
        b = [w if at <= i < at + 4 or i % 3 else edited(w) for i, w in enumerate(a)]
        lines += [" ".join(a), " ".join(b)]
    for _ in range(60):
        a = [word(rng.randint(6, 9)) for _ in range(rng.choice([40, 100, 300]))]
        at = rng.randrange(5, 30)
        b = [w if at <= i < at + 8 or i % 3 else edited(w) for i, w in enumerate(a)]
        lines += [" ".join(a), " ".join(b)]
    found = {r.doc_id: r.n_removed for r in dedup_lines(documents(spark, *lines)).select("doc_id", "n_removed").collect()}
    assert [i for i in range(len(lines)) if found[i] != i % 2] == []


def test_bounds_settle_pairs_as_the_distance_does(spark):
    from lattice.llm.line_dedup import similar

    rng, texts = random.Random(14), []
    for _ in range(150):
        a = prose(rng, rng.choice([3, 8, 30, 60]))
        b = list(a)
        for _ in range(rng.randint(0, 2 + len(a) // 6)):
            i = rng.randrange(len(b))
            b[i : i + 1] = rng.choice([[b[i][:-1] + "x"], [b[i], "öé"], [], [b[i] + "y\U0001f600"], [b[i][::-1]]])
            b = b or ["x"]
        texts += [" ".join(a), " ".join(b)]
    lines = spark.createDataFrame(list(enumerate(texts)), "id long, norm string")
    pairs = [(i, j) for k in range(0, len(texts), 2) for i, j in ((k, k + 1), (k + 1, k), (k, (k + 2) % len(texts)))]
    got = {(r.a, r.b) for r in similar(spark.createDataFrame(pairs, "a long, b long"), lines, 0.9).collect()}
    want = {(i, j) for i, j in pairs if distance(texts[i], texts[j]) <= int(0.1 * max(len(texts[i]), len(texts[j])) + 1e-9)}
    assert got == want and 50 < len(want) < len(pairs) - 50


def test_lines_of_awkward_rows(spark):
    rows = awkward(spark)
    found = dedup_lines(rows)
    assert found.columns == [c for c in rows.columns if c not in ("n_lines", "n_removed")] + ["n_lines", "n_removed"]
    by_id = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in found.where("doc_id IS NOT NULL").collect()}
    assert by_id[1] == (None, 0, 0) and by_id[2] == ("", 1, 0) and by_id[3] == (" \t\n ", 2, 0)
    assert by_id[4] == ("one two", 1, 0) and by_id[5] == ("", 1, 1) and by_id[6] == (LONG, 1, 0) and by_id[7] == ("", 1, 1)
    assert found.where("doc_id IS NULL").count() == 2 and found.where("doc_id IS NULL AND n_removed > 0").count() == 0
    assert dedup_lines(empty(spark)).count() == 0


# toxicity


def test_toxicity_of_held_out_documents(spark, sf_dir):
    at = os.path.join(os.path.dirname(sf_dir), "sf0.1")  # smaller tables have six toxic documents held out at most, two of them by the labels' noise alone
    labels = spark.read.parquet(f"{at}/labels.parquet").select("doc_id", "toxic")
    found = queries.op6_toxicity(spark, at)
    assert found.count() == spark.read.parquet(f"{at}/documents.parquet").count()
    rows = found.where("held_out").join(labels, "doc_id").collect()
    bad, good = [r.score for r in rows if r.toxic == 1], [r.score for r in rows if r.toxic == 0]
    assert len(bad) > 30 and len(good) > 200
    above = sum((x > y) + (x == y) / 2 for x in bad for y in good) / (len(bad) * len(good))
    assert above >= 0.9
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in found.collect())


def plain_log_ratios(words, toxic, ordinary, everything):
    """log P(word | before, toxic) - log P(word | before, ordinary) of each of ``words`` by dictionaries; texts are lists of words."""
    shared = Counter(w for t in everything for w in t)
    total, vocabulary = sum(shared.values()), {w for t in toxic + ordinary for w in ["", *t]}

    def given_up(counts):
        n = Counter(counts)
        y = n[1] / max(1, n[1] + 2 * n[2])
        most = {j: min(max(j - (j + 1) * y * n[j + 1] / max(1, n[j]), 0.5 * min(j, 2)), j) for j in (1, 2, 3)}
        return lambda c: most[min(c, 3)] if c else 0.0

    def model(texts):
        pairs = Counter(p for t in texts for p in zip(["", *t], t))
        follow, context, kinds = Counter(w for _, w in pairs), Counter(), Counter()
        less, low_less = given_up(pairs.values()), given_up(follow.values())
        for (v, _), c in pairs.items():
            context[v] += c
            kinds[v] += less(c)
        k = sum(follow.values())
        left = sum(low_less(c) for c in follow.values()) + toxicity.SHARED * k

        def p(v, w):
            base = max(1, shared[w]) / total if w in vocabulary else 1.0
            low = (follow[w] - low_less(follow[w]) + left * base) / ((1 + toxicity.SHARED) * k)
            return (pairs[v, w] - less(pairs[v, w]) + (kinds[v] + toxicity.CONTEXT) * low) / (context[v] + toxicity.CONTEXT)

        return p

    one, two = model(toxic), model(ordinary)
    return [math.log(one(v, w)) - math.log(two(v, w)) for v, w in zip(["", *words], words)]


def test_toxicity_models_are_plain_kneser_ney(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(30)]
    docs = [[rng.choice(words[:20] if i % 3 else words[10:]) for _ in range(rng.randrange(1, 60))] for i in range(60)]
    rows = documents(spark, *[", ".join(x).upper() for x in docs])
    labels = {i: int(i % 3 == 0) for i in range(40)}
    table = spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    model = toxicity.train(rows, table, Scratch(spark, "test"))
    crc = lambda i: zlib.crc32(str(i).encode()) % 5
    classes = [[docs[i] for i, x in labels.items() if x == k and crc(i) != 1] for k in (1, 0)]
    for text in (docs[50], docs[51], ["w3", "never", "seen", "w29"]):
        data = " ".join(text).encode()
        hashed, before, _ = toxicity._tokens(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        assert model.log_ratios(hashed, before).tolist() == pytest.approx(plain_log_ratios(text, *classes, docs), rel=1e-3, abs=1e-4)


def test_labels_of_held_out_rows_are_never_read(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    turned = labels.withColumn("toxic", F.when(held_out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = ({r.doc_id: r.score for r in toxicity_scores(docs, x).collect()} for x in (labels, turned))
    assert one == two


def test_toxicity_of_awkward_rows(spark):
    rows = awkward(spark)
    labels = spark.createDataFrame([(4, 1), (6, 0), (8, 1), (9, 0), (None, 1), (7, None), (5, 7)], "doc_id long, toxic int")
    found = toxicity_scores(rows, labels).collect()
    assert len(found) == 12 and all(0 <= r.score <= 1 for r in found) and len({r.score for r in found if r.doc_id in (1, 2, 3)}) == 1
    assert all(r.score == pytest.approx(0, abs=1e-9) for r in toxicity_scores(rows, labels.limit(0)).collect())
    assert toxicity_scores(empty(spark), labels).count() == 0


def test_texts_are_split_into_words_after_their_shuffle(spark):
    """Only the plain match for blank texts comes before it."""
    from lattice.llm.decontaminate import document_words

    docs = documents(spark, None, "", " \t\r\n", "A b", "   ")
    assert {r.doc_id: r.w for r in document_words(docs).collect()} == {3: ["a", "b"], 4: [" "]}
    plan = document_words(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan[plan.index("Repartition") :]


def test_memory_of_word_counts_is_bounded_by_a_slice(spark):
    """Four megabytes of text in one batch are hashed a megabyte at a time, with the same counts."""
    import numpy as np
    import pyarrow as pa

    from lattice.llm import toxicity

    texts, sizes, tokens = ["to be or not to be " * 3000] * 80, [], toxicity._tokens
    toxicity._tokens = lambda data, offsets: (sizes.append(len(data)), tokens(data, offsets))[1]
    try:
        parts = list(toxicity._word_counts(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])])))
    finally:
        toxicity._tokens = tokens
    assert max(sizes) <= 1 << 20
    assert sorted(np.concatenate([p.column(1).to_numpy() for p in parts]).tolist()) == [240_000, 240_000, 480_000, 480_000]


def test_only_texts_go_to_the_scoring_tasks_and_scores_come_back(spark):
    docs = documents(spark, "aa bb cc", "dd ee ff", None).withColumn("score", F.lit("old")).withColumn("a b.c", F.col("text"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(3)], "doc_id long, toxic int")
    found = toxicity.with_scores(docs, labels)
    assert found.columns == [c for c in docs.columns if c != "score"] + ["score"]
    assert {(r.doc_id, r.text, r["a b.c"]) for r in found.where("score < 2").collect()} == {(0, "aa bb cc", "aa bb cc"), (1, "dd ee ff", "dd ee ff"), (2, None, None)}
    plan = found.where("score < 2")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "MapInArrow" not in plan
