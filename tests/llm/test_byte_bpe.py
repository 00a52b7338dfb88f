import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattice.llm.byte_bpe import bpe_digests, decode, encode, ranks_of, replay, word_ids
from lattice.llm.queries import op13_byte_bpe

FILE, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks_of(FILE).of, special_tokens={})


def in_turn(word, of):
    """The merges of one word, one after another, the lowest rank and then the leftmost first."""
    if word in of:
        return [of[word]]
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        rank, i = min((of.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
        if rank == 1 << 30:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [of[x] for x in parts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=30), st.text("aeinrst ", max_size=40).map(str.encode), st.text("ab", max_size=60).map(str.encode)), max_size=12))
def test_replay_equals_merges_in_turn(words):
    ranks = ranks_of(FILE)
    assert replay(words, ranks) == [in_turn(w, ranks.of) if w else [] for w in words]


def test_lower_ranks_made_on_the_way_come_first():
    """Ranks where merging one pair makes a pair of a lower rank, next to a second place of the first pair."""
    of = {bytes([b]): b for b in range(256)} | {b"bab": 256, b"abab": 257, b"ba": 258, b"ab": 259, b"aba": 260}

    class Small(type(ranks_of(FILE))):
        def __init__(self):
            pass

    from lattice.llm import byte_bpe

    small = Small()
    small.of, small.tokens = of, [t for t, _ in sorted(of.items(), key=lambda x: x[1])]
    small.byte = np.arange(256, dtype=np.int32)
    small.first = np.array([[of.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)], np.int32)
    small.pairs = byte_bpe._Pairs(small)
    rng = random.Random(3)
    words = [bytes(rng.choices(b"ab", k=rng.randint(1, 14))) for _ in range(3000)]
    assert replay(words, small) == [in_turn(w, of) for w in words]


ROWS = [
    (1, "Hello  World\n\n\tNASA's 1234 's  "), (2, None), (3, ""), (4, "   "), (None, "no id"), (1, "the same id"), (1, "the same id"),
    (5, "<|endoftext|> is text"), (6, "naïve café \u0085 x　 y 你好 🙂‍🙂"), (7, "x" * 30_000 + " y"), (8, " a  b   c  d"), (9, "tail \n "),
]


def test_digests_equal_the_library(spark, library):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("decoded", F.lit("x")).repartition(3)
    got = sorted(map(tuple, bpe_digests(docs, FILE, PATTERN).collect()), key=str)
    want = []
    for doc, text in ROWS:
        ids = library.encode_ordinary(text or "")
        want.append((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe_digests(docs.where("false"), FILE, PATTERN).count() == 0


def test_a_small_word_table_changes_nothing(spark, library):
    """Whichever words the broadcast table holds, the ids are the same, and the other columns stay."""
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("extra", F.lit(7))
    for most in (1, 5, 1000):
        rows = decode(encode(docs, FILE, PATTERN, most=most), FILE).collect()
        for x in rows:
            assert np.frombuffer(x.ids, "<u4").tolist() == library.encode_ordinary(x.text or "") and bytes(x.decoded) == (x.text or "").encode() and x.extra == 7
    assert word_ids(docs.unionByName(docs).coalesce(1), FILE, PATTERN, 5).count() == 5
    assert encode(docs, FILE, PATTERN, out="extra").columns == ["doc_id", "text", "extra"]


def test_query_equals_the_library(spark, sf_dir, library):
    got = {x.doc_id: x for x in op13_byte_bpe(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for x in docs:
        ids = library.encode_ordinary(x.text or "")
        assert (got[x.doc_id].n_tokens, got[x.doc_id].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[x.doc_id].decoded_sha256 == hashlib.sha256((x.text or "").encode()).hexdigest()
