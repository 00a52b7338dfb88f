"""Operator 6: toxicity by class-conditional Kneser-Ney models.

Words are runs of bytes other than ASCII blanks and punctuation, lower-cased. A
toxic and an ordinary bigram model are counted on labelled rows, with contexts
that run across words. Both have three levels, with absolute discounts: counts
of word pairs; continuation counts (how many different words come before a
word), so that copies of one text don't make its words frequent; and the shared
counts of the word in all documents, labelled or not. An expression that is rare
in one class so takes its probability from what both share, and a word that
neither class has seen tells nothing.

Most words of a toxic text are ordinary ones, so its likelihood is that of a
mixture: each word comes from the toxic model at one of the ``RATES``, else from
the ordinary one. The differences between these log-likelihoods and the ordinary
one, over the number of words, are the features, with the logarithm of that
number, as chance differences shrink with it; a logistic curve fitted on
labelled rows that the models leave out turns them into a score.

The models are fitted on a bounded sample: at most ``class_rows`` labelled rows
of each class, those with the least hashed ids (and ``class_rows`` for the curve);
what the driver gathers and tasks load is bounded by these rows' words. Their shared counts
are summed by Spark over all words of all documents. No text is shuffled.

Defined cases: null and wordless texts have features of 0 and get the curve's
value there; rows with equal ``doc_id`` are scored each by its own text and share the
label; rows without ``doc_id`` count as unlabelled; labels other than 0 and 1
are ignored; with labels of one class or none, every score is that class's
share (0 without any); an empty table gives no rows; other columns pass through
``with_scores``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lattice.llm.bytesops import mix, slices, word_hashes, words
from lattice.llm.scratch import Scratch

#: Pseudo-counts by which a context's own pairs yield to the class's word probabilities.
CONTEXT = 10_000.0
#: Pseudo-counts, as a share of a class's continuation counts, by which they yield to the shared ones.
SHARED = 0.004
#: Shares of toxic expressions in a toxic text.
RATES = (0.5, 0.1, 0.02, 0.004)
FEATURES = len(RATES) + 1
#: Stands before the first word of a text.
START = np.uint64(0x243F6A8885A308D3)
#: ASCII other than letters and digits.
SEPARATORS = np.zeros(256, bool)
SEPARATORS[:128] = True
SEPARATORS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, of the word before it in its text, and its row."""
    starts, ends, row = words(data, offsets, SEPARATORS)
    hashed = word_hashes(data, starts, ends)
    before = np.empty_like(hashed)
    before[1:] = hashed[:-1]
    if len(row):
        before[np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))] = START
    return hashed, before, row


def _pair(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + word)


def _class_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, w, n_1, n_0): pairs of words with their counts in toxic and ordinary rows (text, label)."""
    for batch in batches:
        label = batch.column(1).to_numpy()
        for first, end, data, offsets in slices(batch.column(0)):
            word, before, row = _tokens(data, offsets)
            _, at, number = np.unique(_pair(before, word), return_index=True, return_inverse=True)
            toxic = label[first:end][row] == 1
            counts = [np.bincount(number[side], minlength=len(at)) for side in (toxic, ~toxic)]
            yield pa.RecordBatch.from_arrays([*[pa.array(x[at].view(np.int64)) for x in (before, word)], *map(pa.array, counts)], ["v", "w", "n_1", "n_0"])


def _merged(keys: np.ndarray, counts: np.ndarray, more: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys and their counts, with those of ``more`` arrays of keys added."""
    found, n = np.unique(np.concatenate([*more, np.zeros(0, np.uint64)]), return_counts=True)
    keys, number = np.unique(np.concatenate([keys, found]), return_inverse=True)
    return keys, np.bincount(number, weights=np.concatenate([counts, n]), minlength=len(keys)).astype(np.int64)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, n): words of all texts, summed within the task as far as a million different ones allow."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def out() -> Iterator[pa.RecordBatch]:
        for i in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 100_000].view(np.int64)), pa.array(counts[i : i + 100_000])], ["w", "n"])

    waiting: list[np.ndarray] = []
    for batch in batches:
        for _, _, data, offsets in slices(batch.column(0)):
            waiting.append(_tokens(data, offsets)[0])
            if sum(map(len, waiting)) > 500_000:
                keys, counts = _merged(keys, counts, waiting)
                waiting = []
                if len(keys) > 1_000_000:
                    yield from out()
                    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, counts = _merged(keys, counts, waiting)
    yield from out()


def discounts(count: np.ndarray) -> np.ndarray:
    """What each count gives up: a discount of its own for counts of 1, 2 and more, from the numbers of counts of 1 to 4."""
    seen = np.bincount(np.minimum(count, 5).astype(np.int64), minlength=6)
    y = seen[1] / max(1, seen[1] + 2 * seen[2])
    most = [0.0, *[float(np.clip(j - (j + 1) * y * seen[j + 1] / max(1, seen[j]), 0.5 * min(j, 2), j)) for j in (1, 2, 3)]]
    return np.array(most)[np.minimum(count, 3).astype(np.int64)]


class Model:
    """Class-conditional models as sorted arrays of hashes and their probabilities."""

    def __init__(self, pairs: dict[str, np.ndarray], shared: dict[str, np.ndarray], total: int):
        """``pairs``: v, w, n_1, n_0 of different pairs; ``shared``: w, n of those words in all documents; ``total``: words of all documents."""
        v, w = pairs["v"].view(np.uint64), pairs["w"].view(np.uint64)
        self.words, place = np.unique(np.concatenate([w, v]), return_inverse=True)
        n, w, v = len(self.words), place[: len(w)], place[len(w) :]
        everywhere = np.zeros(n)
        if len(shared["w"]):
            everywhere[np.searchsorted(self.words, shared["w"].view(np.uint64))] = shared["n"]
        base = np.maximum(everywhere, 1) / max(1, total)
        key = _pair(self.words[v], self.words[w])
        order = np.argsort(key)
        self.pairs, self.over, self.yields, self.low, self.unseen = key[order], [], [], [], []
        self.counts = []
        for c in ("n_1", "n_0"):
            count = pairs[c].astype(np.float64)
            taken = discounts(count)
            follow = np.bincount(w, count > 0, n)
            less = discounts(follow)
            k = max(1.0, follow.sum())
            left = less.sum() + SHARED * k
            self.low.append(((follow - less + left * base) / ((1 + SHARED) * k)).astype(np.float32))
            self.unseen.append(left / ((1 + SHARED) * k))
            seen = np.bincount(v, count, n) + CONTEXT
            self.over.append((1 / seen).astype(np.float32))
            self.yields.append(((np.bincount(v, taken, n) + CONTEXT) / seen).astype(np.float32))
            self.counts.append((count - taken).astype(np.float32)[order])
        self.weights = np.zeros(FEATURES + 1)

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Places of sorted ``wanted`` among ``keys``; len(keys) where missing."""
        at = np.searchsorted(keys, wanted)
        hit = at < len(keys)
        hit[hit] = keys[at[hit]] == wanted[hit]
        return np.where(hit, at, len(keys))

    def log_ratios(self, word: np.ndarray, before: np.ndarray) -> np.ndarray:
        """log P(word | before, toxic) - log P(word | before, ordinary) of each word."""
        kinds, number = np.unique(np.concatenate([word, before]), return_inverse=True)
        place = self._find(self.words, kinds)[number]
        w, v = place[: len(word)], place[len(word) :]
        pair, number = np.unique(_pair(before, word), return_inverse=True)
        pair = self._find(self.pairs, pair)[number]
        logs = []
        for low, unseen, over, yields, counts in zip(self.low, self.unseen, self.over, self.yields, self.counts):
            # what lies past the end stands for unseen words, contexts and pairs
            low, over, yields, counts = np.append(low, np.float32(unseen)), np.append(over, np.float32(0)), np.append(yields, np.float32(1)), np.append(counts, np.float32(0))
            logs.append(np.log(counts[pair] * over[v] + yields[v] * low[w]))
        return logs[0] - logs[1]

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Length-normalised log-likelihood differences of each row, one for each of the rates, and the logarithm of its words."""
        word, before, row = _tokens(data, offsets)
        rows = len(offsets) - 1
        out = np.zeros((rows, FEATURES))
        if len(word):
            gain = np.expm1(np.clip(self.log_ratios(word, before), -30, 30))
            n = np.maximum(1, np.bincount(row, minlength=rows))
            for k, rate in enumerate(RATES):
                mean = np.bincount(row, np.log1p(rate * gain), rows) / n
                out[:, k] = np.sign(mean) * np.sqrt(np.abs(mean))  # evens out the long upper tail for the curve
            out[:, -1] = np.log(n)
        return out

    def fit_curve(self, x: np.ndarray, y: np.ndarray) -> None:
        """Logistic regression of y on the features by Newton steps, with a small ridge."""
        self.weights = np.zeros(FEATURES + 1)
        if not len(y) or y.min() == y.max():
            self.weights[-1] = 40.0 * (2 * (float(y.mean()) if len(y) else 0.0) - 1)
            return
        mean, scale = x.mean(axis=0), np.where(x.std(axis=0) > 1e-12, x.std(axis=0), 1.0)
        design, w = np.column_stack([(x - mean) / scale, np.ones(len(x))]), np.zeros(FEATURES + 1)
        ridge = np.append(np.full(FEATURES, 0.1), 1e-6)
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(design @ w, -40, 40)))
            step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.diag(ridge), design.T @ (p - y) + ridge * w)
            w -= step / max(1.0, float(np.abs(step).max()) / 2)  # steps of 2 standard deviations at most
            if np.abs(step).max() < 1e-9:
                break
        self.weights = np.append(w[:-1] / scale, w[-1] - (w[:-1] / scale) @ mean)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -500, 500)))


def _features(rows: DataFrame, shared: Broadcast) -> DataFrame:
    """``rows``, whose first column is the text, with their features (f0, f1, ...) by the ``shared`` model."""
    new = [f"f{k}" for k in range(FEATURES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _features_of(shared.value, batch.column(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, x.T)], [*batch.schema.names, *new])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, *[StructField(c, DoubleType()) for c in new]]))


def _features_of(model: Model, texts: pa.Array) -> np.ndarray:
    found = [model.features(data, offsets) for _, _, data, offsets in slices(texts)]
    return np.concatenate(found) if found else np.zeros((0, FEATURES))


def _score(text: Column, shared: Broadcast) -> Column:
    """The score of each text by the ``shared`` model. Only texts go to Python and only scores come back, so that no other column takes up memory there."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(shared.value.score(_features_of(shared.value, texts)))

    return F.arrow_udf(run, DoubleType()).asNondeterministic()(text)  # so that a filter on the score doesn't have it made twice


def _columns(rows: DataFrame) -> dict[str, np.ndarray]:
    """The columns of whole numbers of a table of bounded size; what it came in is given back before they are worked on."""
    table = rows.toArrow()
    out = {c: np.array(table.column(c)) if table.num_rows else np.zeros(0, np.int64) for c in rows.columns}
    del table
    pa.default_memory_pool().release_unused()
    return out


def train(docs: DataFrame, labels: DataFrame, scratch: Scratch, class_rows: int = 3_000) -> Model:
    """Model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic): a fifth of the labelled rows, by crc32, fits the curve, the rest the classes."""
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("of")).agg(F.max("toxic").cast("int").alias("label"))
    curve = F.pmod(F.crc32(F.col("of").cast("string").cast("binary")), F.lit(5)) == 1
    known = known.withColumn("use", F.when(curve, "curve").otherwise(F.concat(F.lit("class"), "label")))
    chosen = None
    for use in ("curve", "class0", "class1"):
        some = known.where(F.col("use") == use).orderBy(F.xxhash64("of"), "of").limit(class_rows)
        chosen = some if chosen is None else chosen.unionByName(some)
    chosen = scratch.table("chosen", chosen)  # 3 x class_rows rows at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("of")).select("text", "label", "use")
    sample = scratch.table("sample", sample)

    pairs = sample.where("use <> 'curve'").select("text", "label").mapInArrow(_class_pairs, "v long, w long, n_1 long, n_0 long")
    pairs = scratch.table("pairs", pairs.groupBy("v", "w").agg(F.sum("n_1").alias("n_1"), F.sum("n_0").alias("n_0")))
    counts = scratch.table("counts", rows.select("text").mapInArrow(_word_counts, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    used = pairs.select("w").distinct()
    common = _columns(counts.join(used, "w", "left_semi"))
    model = Model(_columns(pairs.select("v", "w", F.col("n_1").cast("int"), F.col("n_0").cast("int"))), common, total)
    del common
    scratch.drop("pairs", "counts")  # with the driver's copies of what it has gathered
    shared = docs.sparkSession.sparkContext.broadcast(model)
    found = _features(sample.where("use = 'curve'").select("text", "label"), shared).drop("text").toPandas()
    shared.destroy()
    model.fit_curve(found[[f"f{k}" for k in range(FEATURES)]].to_numpy(), found["label"].to_numpy(float))
    scratch.drop("chosen", "sample")
    return model


def _held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")), F.lit(5)) == 0


def with_scores(docs: DataFrame, labels: DataFrame, score: str = "score") -> DataFrame:
    """``docs`` with one more column, the score of each row's text; a column of ``docs`` with that name is left out. Labels of held-out rows are never read."""
    model = train(docs, labels.where(~_held_out()), Scratch(docs.sparkSession, "toxicity"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [F.col(f"`{c}`") for c in docs.columns if c != score]
    return docs.select(*kept, _score(F.col("text").cast("string"), shared).alias(score))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document; labels of held-out rows are never read."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = with_scores(rows, labels)
    return scored.select("doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
