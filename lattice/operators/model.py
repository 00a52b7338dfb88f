"""Calls to a language model as a batched stage.

The model is any function from a list of prompts to a list of answers, so that a
hosted model, a local one or a rule can stand behind it. It is called on the
executors with a bounded number of prompts at a time.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lattice.functions.text import json_object

Complete = Callable[[list[str]], list[str]]


class ModelError(RuntimeError):
    """Too many of a stage's prompts were left without an answer."""


def _answers(complete: Complete, prompts: list[str]) -> list[str | None]:
    """An answer for each prompt; where a call for several fails, each is tried once on its own, so that one bad prompt costs no other its answer."""
    try:
        found = list(complete(prompts))
        if len(found) != len(prompts):
            raise ValueError(f"{len(found)} answers to {len(prompts)} prompts")
        return found
    except Exception:
        return [None] if len(prompts) == 1 else [x for p in prompts for x in _answers(complete, [p])]


def generate(rows: DataFrame, complete: Complete, prompt: str = "prompt", output: str = "output", batch: int = 32) -> DataFrame:
    """``rows`` with the model's answer to the column ``prompt``; null where the prompt is null or the model fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                prompts = part.column(part.schema.get_field_index(prompt)).to_pylist()
                asked = [p for p in prompts if p is not None]
                found = iter(_answers(complete, asked) if asked else [])
                out = pa.array([None if p is None else next(found) for p in prompts], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, out], [*part.schema.names, output])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(output, StringType())]))


def generate_json(rows: DataFrame, complete: Complete, schema: str, prompt: str = "prompt", output: str = "parsed", batch: int = 32) -> DataFrame:
    """As ``generate``, with the JSON object in the answer read by ``schema``; null where there is none."""
    answered = generate(rows, complete, prompt, "output", batch)
    return answered.withColumn(output, json_object(answered["output"], schema)).drop("output")


def _filesystem(uri: str):
    """Arrow's file system for a folder, and the folder's path in it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class AnswerCache:
    """Answers kept under ``root`` in shared storage, each under the hash of its prompt.

    ``ask`` looks prompts up first and asks the model for the distinct ones that are missing. A task writes each batch of
    answers as a file named by the batch's prompts before it goes on, under a name of its own that is moved to the final
    one: a repeated task, or a job begun again after it was lost, finds its answered batches there and asks only for the rest.
    Prompts are dealt by hash and sorted, so that the batches of a repeated task are the same. Failed prompts are not kept.
    """

    def __init__(self, root: str, complete: Complete, model: str = "", batch: int = 32, parts: int = 64):
        """``model`` names the model, whose answers aren't another one's; ``parts`` is the number of tasks that ask."""
        self.root, self.complete, self.model, self.batch, self.parts = root.rstrip("/"), complete, model, batch, parts

    def _key(self, prompt):
        return F.sha2(F.concat(F.lit(f"{self.model}\x1f"), prompt), 256)

    def stored(self, spark) -> DataFrame:
        """(key, answer) of everything that has been answered; two tasks that met the same prompt may both have kept one, the least counts."""
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return spark.createDataFrame([], "key string, answer string")
        files = spark.read.schema("key string, answer string").option("pathGlobFilter", "*.parquet").parquet(self.root)
        return files.where("answer IS NOT NULL").groupBy("key").agg(F.min("answer").alias("answer"))

    def ask(self, rows: DataFrame, prompt: str = "prompt", output: str = "output", most_failed: float = 0.2) -> DataFrame:
        """``rows`` with the answer in place of the column ``prompt``: null where the prompt is null or the model fails.

        Raises ``ModelError`` if over ``most_failed`` of the distinct prompts (and more than one) got no answer.
        """
        spark = rows.sparkSession
        root, complete, batch = self.root, self.complete, self.batch
        wanted = rows.where(F.col(prompt).isNotNull()).select(self._key(F.col(prompt)).alias("key"), F.col(prompt).alias("p")).dropDuplicates(["key"])
        missing = wanted.join(self.stored(spark).select("key"), "key", "left_anti").repartition(self.parts, "key").sortWithinPartitions("key")

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import pyarrow.parquet as pq

            fs, folder = _filesystem(root)
            waiting: list[tuple[str, str]] = []

            def answered() -> pa.RecordBatch:
                keys = [k for k, _ in waiting]
                name = f"{folder}/{hashlib.sha256(''.join(keys).encode()).hexdigest()}.parquet"
                if fs.get_file_info(name).is_file:
                    table = pq.read_table(name, filesystem=fs)
                    found = dict(zip(table.column("key").to_pylist(), table.column("answer").to_pylist()))
                    kept = [found.get(k) for k in keys]
                else:
                    kept = _answers(complete, [p for _, p in waiting])
                    own = f"{folder}/.{uuid.uuid4().hex}"
                    got = [(k, a) for k, a in zip(keys, kept) if a is not None]
                    if got:
                        fs.create_dir(folder, recursive=True)
                        pq.write_table(pa.table({"key": [k for k, _ in got], "answer": [a for _, a in got]}), own, filesystem=fs)
                        fs.move(own, name)
                waiting.clear()
                return pa.RecordBatch.from_pydict({"n": [len(keys)], "failed": [sum(a is None for a in kept)]})

            for part in batches:
                for pair in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    waiting.append(pair)
                    if len(waiting) == batch:
                        yield answered()
            if waiting:
                yield answered()

        asked = missing.mapInArrow(fill, "n long, failed long").agg(F.sum("n").alias("n"), F.sum("failed").alias("failed")).first()
        if (asked["failed"] or 0) > max(1, most_failed * (asked["n"] or 0)):
            raise ModelError(f"{asked['failed']} of {asked['n']} prompts were not answered")
        answers = self.stored(spark).withColumnRenamed("answer", output)
        return rows.withColumn("key_", self._key(F.col(prompt))).drop(prompt).join(answers.withColumnRenamed("key", "key_"), "key_", "left").drop("key_")
