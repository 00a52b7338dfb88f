"""The vector stage: text columns to vectors, by a column expression or by batches on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattice.functions.text import hashed_embedding

EmbedBatch = Callable[[list[str]], list[list[float]]]


class Embedding:
    """A source of vectors of one declared dimension.

    Either ``column``, an expression that Spark evaluates by itself, or ``batch``, a function from texts to vectors that the
    executors call with at most ``size`` distinct texts at a time. ``name`` tells vectors of one model from those of another.
    """

    def __init__(self, dimension: int, batch: EmbedBatch | None = None, column: Callable[[Column], Column] | None = None, name: str = "", size: int = 256):
        if (batch is None) == (column is None):
            raise ValueError("an embedding has either batch or column")
        self.dimension, self.batch, self.column, self.name, self.size = dimension, batch, column, name, size

    def key(self, text: Column) -> Column:
        """What a vector is kept under: the hash of its content and model."""
        return F.sha2(F.concat(F.lit(f"{self.name}\x1f{self.dimension}\x1f"), F.coalesce(text, F.lit(""))), 256)

    def fresh(self, texts: DataFrame) -> DataFrame:
        """(key, v) of distinct (key, text), by ``batch``. A vector of another dimension is an error, not a silent mismatch."""
        batch, size, dimension = self.batch, self.size, self.dimension

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, size):
                    part = whole.slice(at, size)
                    asked = [t or "" for t in part.column(1).to_pylist()]
                    made = [[float(x) for x in v] for v in batch(asked)]
                    if len(made) != len(asked) or any(len(v) != dimension for v in made):
                        raise ValueError(f"{len(asked)} texts gave {len(made)} vectors, of lengths {sorted({len(v) for v in made})}; declared are {dimension}")
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.list_(pa.float64()))], ["key", "v"])

        return texts.select("key", "text").mapInArrow(run, "key string, v array<double>")

    def embed(self, rows: DataFrame, text: Column, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
        """``rows`` with ``v``, the vector of ``text``, and what was made anew (key, v), None if nothing is kept.

        ``known`` (key, v) are vectors made before: only distinct texts that it lacks are embedded, once each.
        """
        if self.column is not None:
            return rows.withColumn("v", self.column(text)), None
        from lattice.lineage import cut

        keyed = rows.withColumn("key_", self.key(text)).withColumn("text_", text)
        wanted = keyed.select(F.col("key_").alias("key"), F.col("text_").alias("text")).dropDuplicates(["key"])
        missing = wanted if known is None else wanted.join(known.select("key"), "key", "left_anti")
        made = cut(self.fresh(missing))  # a model is asked once for each text, whatever is read again later
        every = made if known is None else made.unionByName(known.select("key", "v"))
        joined = keyed.join(every.withColumnRenamed("key", "key_"), "key_", "left")
        return joined.select(*rows.columns, "v"), made


def hashed(dimension: int = 64) -> Embedding:
    """The offline embedding: feature hashing inside Spark."""
    return Embedding(dimension, column=lambda text: hashed_embedding(text, dimension), name="hashed")
