"""Operator 13: byte-level BPE by corpus-level merge replay.

Encoding looks at words (the matches of the pre-token pattern), not at texts.
``replay`` lays words out one after another, keeps an inverted index from each
mergeable pair, named by the rank of the token it makes, to the positions where
it stands, and takes the ranks in ascending order: one step merges a pair
wherever it stands, and only the neighbours of merged positions enter the index
anew. A merge can make a pair of a lower rank than its own; the rest of that word
then waits until the lower rank has had its turn, so each word goes through the
merges in the order in which the library takes them.

Two jobs use it. ``word_ids`` counts the words of all documents, and each hash
partition of the ``most`` commonest replays its own; that table has at most
``most`` rows of at most ``LONGEST`` bytes a word, and is broadcast. Then the
documents are encoded where they lie, without a shuffle: a block of them replays
together the words that the table lacks. Nothing else is kept per word, so memory
follows the block, not the corpus.

Defined cases: null or empty text gives no ids; a null ``doc_id`` is kept; rows
with equal ``doc_id`` are rows of their own; an empty table gives no rows; other
columns are ignored by the query and kept by ``encode`` and ``decode``, whose new
column takes the place of one of its name.
"""

from __future__ import annotations

import base64
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from lattice.llm.tokens import space_parts

#: Bytes of the longest word in the broadcast table.
LONGEST = 64
#: Characters of text that are encoded together, and words that are counted together.
_BLOCK, _COUNTED = 12_000_000, 300_000
#: Positions of a pair that are merged one by one, as that many are no work for arrays.
_FEW = 48
#: The key of a pair of ids holds the second one in so many bits.
_SHIFT, _MASK = 24, (1 << 24) - 1


class Ranks:
    """The tokens of a rank file, by id and by bytes, and the rank of the pair of two ids."""

    def __init__(self, file: str):
        with open(file, "rb") as lines:
            self.of = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
        self.tokens: list[bytes] = [b""] * (max(self.of.values()) + 1)
        for token, rank in self.of.items():
            self.tokens[rank] = token
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.byte = np.array([self.of[bytes([b])] for b in range(256)], np.int32)
        self.first = np.array([[self.of.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)], np.int32)
        self.pairs = _Pairs(self)


class _Pairs(dict):
    """Rank of the token that two ids make, -1 if none; the key holds both."""

    def __init__(self, ranks: Ranks):
        super().__init__()
        self.of, self.tokens = ranks.of, ranks.tokens

    def __missing__(self, key: int) -> int:
        if len(self) > 300_000:
            self.clear()
        rank = self[key] = self.of.get(self.tokens[key >> _SHIFT] + self.tokens[key & _MASK], -1)
        return rank


@lru_cache(maxsize=2)
def ranks_of(file: str) -> Ranks:
    """This worker's ranks."""
    return Ranks(file)


class _Laid:
    """Words laid out one after another: the token at each position, its neighbours within the word, and the rank of the pair that starts there (-1: none).

    The index has the positions of each rank's pairs, as arrays from steps with many of them and as numbers from steps with few.
    """

    def __init__(self, words: list[bytes], ranks: Ranks):
        sizes = np.array([len(w) for w in words], np.int64)
        raw, self.ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes)
        n = len(raw)
        self.pairs, self.token, self.word = ranks.pairs, ranks.byte[raw], np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.right, self.before, self.rank = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32), np.full(n, -1, np.int32)
        self.right[self.ends - 1] = self.before[self.ends - sizes] = -1
        self.rank[:-1] = ranks.first[raw[:-1], raw[1:]]
        self.rank[self.ends - 1] = -1
        self.many: dict[int, list[np.ndarray]] = {}
        self.few: dict[int, list[int]] = {}
        self.due: list[int] = []
        self._enter(np.arange(n, dtype=np.int32), self.rank)

    def _enter(self, at: np.ndarray, rank: np.ndarray) -> None:
        """Put the pairs that start ``at`` into the index, those with a rank."""
        some = np.flatnonzero(rank >= 0)
        some = some[np.argsort(rank[some], kind="stable")]
        at, rank = at[some], rank[some]
        cuts = (np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist()
        for i, j in zip([0, *cuts] if len(rank) else [], [*cuts, len(rank)]):
            r = int(rank[i])
            if r not in self.many and r not in self.few:
                heappush(self.due, r)
            self.many.setdefault(r, []).append(at[i:j])

    def _ranks(self, others: np.ndarray, made: int, left: bool) -> np.ndarray:
        """Ranks of the pairs of ``others`` with ``made``, the others to its left or right."""
        kinds, which = np.unique(others, return_inverse=True)
        return np.array([self.pairs[(k << _SHIFT | made) if left else (made << _SHIFT | k)] for k in kinds.tolist()], np.int32)[which] if len(kinds) else np.zeros(0, np.int32)

    def _merge_all(self, at: np.ndarray, made: int) -> None:
        """Merge the pairs that start ``at``, of which no word has two."""
        gone = self.right[at]
        to = self.right[gone]
        self.token[at], self.token[gone], self.rank[gone], self.rank[at], self.right[at] = made, -1, -1, -1, to
        more = to >= 0
        self.before[to[more]] = at[more]
        back = self.before[at]
        back = back[back >= 0]
        for where, others, left in ((at[more], self.token[to[more]], False), (back, self.token[back], True)):
            self.rank[where] = self._ranks(others, made, left)
            self._enter(where, self.rank[where])

    def _merge_in_turn(self, at: list[int], made: int) -> None:
        """Merge the pairs that start ``at``, from the left; what follows a pair of a lower rank in its word goes back to the index."""
        token, right, before, rank, pairs, word, waiting = self.token, self.right, self.before, self.rank, self.pairs, self.word, -1
        for i in at:
            if rank[i] != made:
                continue  # a neighbour has changed since
            if waiting >= 0 and word[i] == waiting:
                self._enter_one(i, made)
                continue
            j = right[i]
            k, h = int(right[j]), int(before[i])
            token[i], token[j], rank[j], rank[i], right[i] = made, -1, -1, -1, k
            low = made
            if k >= 0:
                before[k] = i
                if (new := pairs[made << _SHIFT | int(token[k])]) >= 0:
                    rank[i] = new
                    self._enter_one(i, new)
                    low = min(low, new)
            if h >= 0:
                rank[h] = new = pairs[int(token[h]) << _SHIFT | made]
                if new >= 0:
                    self._enter_one(h, new)
                    low = min(low, new)
            if low < made:
                waiting = word[i]

    def _enter_one(self, at: int, rank: int) -> None:
        if rank not in self.many and rank not in self.few:
            heappush(self.due, rank)
        self.few.setdefault(rank, []).append(at)

    def run(self) -> None:
        while self.due:
            made = heappop(self.due)
            many, few = self.many.pop(made, []), self.few.pop(made, [])
            if len(few) + sum(map(len, many)) <= _FEW:
                self._merge_in_turn(sorted({*few, *(i for x in many for i in x.tolist())}), made)
                continue
            at = np.unique(np.concatenate([*many, np.array(few, np.int32)]))
            at = at[self.rank[at] == made]
            same = np.zeros(len(at) + 1, bool)
            same[1:-1] = self.word[at[1:]] == self.word[at[:-1]]
            several = same[1:] | same[:-1]
            if several.any():
                self._merge_in_turn(at[several].tolist(), made)
                at = at[~several]
            self._merge_all(at, made)


def replay(words: list[bytes], ranks: Ranks) -> list[list[int]]:
    """Token ids of each word, by one replay of the merges over all of them."""
    out = [[ranks.of[w]] if w in ranks.of else [] for w in words]
    left_over = [k for k, w in enumerate(words) if w and not out[k]]
    if left_over:
        laid = _Laid([words[k] for k in left_over], ranks)
        laid.run()
        alive = np.flatnonzero(laid.token >= 0)
        ids, to = laid.token[alive].tolist(), np.searchsorted(alive, laid.ends).tolist()
        for k, i, j in zip(left_over, [0, *to], to):
            out[k] = ids[i:j]
    return out


def _counted(docs: DataFrame, pattern: str) -> DataFrame:
    """(word, n) of all documents; a row for each word and block, to be summed. Words of chunks that a block holds but once can't be common and are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, first, later = regex.compile(pattern).findall, Counter(), Counter()

        def told() -> pa.RecordBatch:
            words: Counter = Counter()
            for lead, seen in (("", first), (" ", later)):
                for chunk, n in seen.items():
                    if n > 1:
                        for word in cut(lead + chunk):
                            words[word] += n
                seen.clear()
            short = [(w, n) for w, n in ((w.encode(), n) for w, n in words.items()) if len(w) <= LONGEST]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in short], pa.binary()), pa.array([n for _, n in short], pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    parts = space_parts(text)
                    first[parts[0]] += 1
                    later.update(parts[1:])
            if len(first) + len(later) > _COUNTED:
                yield told()
        yield told()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word binary, n long")


def word_ids(docs: DataFrame, ranks_file: str, pattern: str, most: int = 1 << 17) -> DataFrame:
    """(word, ids): the ``most`` commonest words of ``docs`` and their token ids, each hash partition replayed together."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [w for batch in batches for w in batch.column(0).to_pylist()]  # at most ``most``
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(replay(words, ranks_of(ranks_file)), pa.list_(pa.int32()))], ["word", "ids"])

    common = _counted(docs, pattern).groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most)
    return common.select("word").repartition("word").mapInArrow(merge, "word binary, ids array<int>")


class _Blocks:
    """Ids of blocks of texts. Chunks (a word or a few, cut before spaces) that were met before keep their ids, up to ``most`` of them.

    ``known`` holds words, their ids one after another, and how many each has.
    """

    def __init__(self, ranks: Ranks, pattern: str, known: tuple[list[bytes], np.ndarray, np.ndarray], most: int = 200_000):
        words, ids, sizes = known
        self.ranks, self.cut, self.most = ranks, regex.compile(pattern).findall, most
        self.known, self.known_ids, self.known_ends = {w: k for k, w in enumerate(words)}, array("i", ids.tobytes()), [0, *np.cumsum(sizes).tolist()]
        self._clear()

    def _clear(self) -> None:
        self.first: dict[str, int] = {}
        self.later: dict[str, int] = {}
        self.ids, self.ends = array("i"), array("q", [0])

    def _learn(self, chunks: list[str]) -> None:
        """Append the ids of ``chunks``; all their words that are not known yet are replayed together."""
        cut = [[w.encode() for w in self.cut(chunk)] for chunk in chunks]
        known, ids, own, ends = self.known, self.ids, self.known_ids, self.known_ends
        fresh = list({w for words in cut for w in words if w not in known})
        new = dict(zip(fresh, replay(fresh, self.ranks)))
        for words in cut:
            for w in words:
                k = known.get(w)
                ids.extend(new[w] if k is None else own[ends[k] : ends[k + 1]])
            self.ends.append(len(ids))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.first) + len(self.later) > self.most:
            self._clear()
        fresh, flat, bounds, n = [], [], [0], len(self.ends) - 1
        for text in texts:
            if text:
                parts = space_parts(text)
                for codes, lead, chunks in ((self.first, "", parts[:1]), (self.later, " ", parts[1:])):
                    found = list(map(codes.get, chunks))
                    if None in found:
                        for i, k in enumerate(found):
                            if k is None and (k := codes.get(chunks[i])) is None:
                                k = codes[chunks[i]] = n
                                fresh.append(lead + chunks[i])
                                n += 1
                            found[i] = k
                    flat += found
            bounds.append(len(flat))
        self._learn(fresh)
        ids, ends = np.frombuffer(self.ids, np.int32) if self.ids else np.zeros(0, np.int32), np.frombuffer(self.ends, np.int64)
        at = np.array(flat, np.int64)
        size = ends[at + 1] - ends[at]
        to = np.cumsum(size)
        whole = ids[np.repeat(ends[at] - (to - size), size) + np.arange(to[-1] if len(to) else 0)].astype("<u4")
        edge = np.concatenate([[0], to])[bounds].tolist()
        return [whole[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])]


def _mapped(df: DataFrame, steps: list[tuple[str, str, Callable]], keep: list[str] | None = None) -> DataFrame:
    """``df`` with a binary column for each step (source column, new column, maker of a function from values to values).

    All steps of a block of rows are taken in one task. ``keep`` names the columns of the result, all by default.
    """
    names = [c for c in df.columns if c not in [out for _, out, _ in steps]]
    df = df.select(*[f"`{c}`" for c in names])
    schema = StructType([*df.schema, *[StructField(out, BinaryType()) for _, out, _ in steps]])
    kept = schema.fieldNames() if keep is None else keep
    first = names.index(steps[0][0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [(source, out, make()) for source, out, make in steps]
        for batch in batches:
            size = max(1, int(batch.num_rows * _BLOCK / max(1, batch.column(first).nbytes)))
            for i in range(0, batch.num_rows, size):
                part = batch.slice(i, size)
                columns = dict(zip(names, part.columns))
                for source, out, work in made:
                    columns[out] = pa.array(work(columns[source].to_pylist()), pa.binary())
                yield pa.RecordBatch.from_arrays([columns[c] for c in kept], kept)

    return df.mapInArrow(run, StructType([schema[c] for c in kept]))


def _encoding(docs: DataFrame, ranks_file: str, pattern: str, most: int) -> Callable:
    """What a task encodes texts with: the ids of the commonest words of ``docs`` are broadcast, at most ``most`` of ``LONGEST`` bytes."""
    table = word_ids(docs, ranks_file, pattern, most).toArrow()
    words, ids = table.column("word").to_pylist(), table.column("ids").combine_chunks()
    known = docs.sparkSession.sparkContext.broadcast((words, ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32), ids.value_lengths().to_numpy(zero_copy_only=False)))
    return lambda: _Blocks(ranks_of(ranks_file), pattern, known.value).encode


def _decoding(ranks_file: str) -> Callable:
    def make():
        tokens = ranks_of(ranks_file).tokens
        return lambda column: [b"".join(map(tokens.__getitem__, np.frombuffer(x or b"", "<u4").tolist())) for x in column]

    return make


def encode(docs: DataFrame, ranks_file: str, pattern: str, out: str = "ids", most: int = 1 << 17) -> DataFrame:
    """``docs`` with column ``out``: the ids of ``text`` as little-endian unsigned 32-bit integers, no special tokens."""
    typed = docs.withColumn("text", F.col("text").cast("string"))
    return _mapped(typed, [("text", out, _encoding(typed, ranks_file, pattern, most))])


def decode(encoded: DataFrame, ranks_file: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with column ``out``: the bytes that the ids in column ``ids`` stand for; null ids give no bytes."""
    return _mapped(encoded, [(ids, out, _decoding(ranks_file))])


def bpe_digests(docs: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    done = _mapped(rows, [("text", "ids", _encoding(rows, ranks_file, pattern, 1 << 17)), ("ids", "decoded", _decoding(ranks_file))], ["doc_id", "ids", "decoded"])
    return done.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
