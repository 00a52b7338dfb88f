"""Operator 9: token-id files with 64-bit document offsets.

Format, for each shard of a directory: ``shard-NNNNN.bin`` holds the ids of its
documents one after another as flat little-endian unsigned integers (16 bits if
the vocabulary fits, else 32); ``shard-NNNNN.idx`` holds 64-bit integers: the
number of documents n, n document ids, then n + 1 offsets, counted in ids from
the shard's start. Shards follow one another in ascending ``doc_id`` order; the
``shards`` table gives each one's base, the prefix sum of the shards before it,
so offset + base addresses the corpus as one array.

Defined cases: a null text is empty and has the end id alone; an empty table
gives no rows; rows with equal ``doc_id`` stand in the order of their texts; a
null ``doc_id`` stands first and reads back as null; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattice.llm.scratch import Scratch
from lattice.llm.tokens import encoder

_NO_ID = -(2**63)
_ROWS = 256


def _place(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _width(vocab: int) -> str:
    return "<u2" if vocab <= 1 << 16 else "<u4"


def write_token_files(docs: DataFrame, path: str, tokenizer_file: str, end_id: int) -> DataFrame:
    """Tokenize ``docs`` (doc_id, text) into shards under ``path``.

    Returns a row for each shard: shard, file, n_docs, n_tokens. A task writes
    under a name of its own and renames at its end, so a repeated task leaves
    the same files.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, encode = TaskContext.get().partitionId(), encoder(tokenizer_file, end_id)
        where, root = _place(path)
        where.create_dir(root, recursive=True)
        name = f"{root}/shard-{shard:05d}"
        own = f"{name}.{TaskContext.get().taskAttemptId()}.tmp"
        ids, sizes = [], []
        with where.open_output_stream(f"{own}.bin") as to:
            for batch in batches:
                for i in range(0, batch.num_rows, _ROWS):
                    part = batch.slice(i, _ROWS)
                    tokens, bounds = encode.encode(part.column(1).to_pylist())
                    to.write(tokens.astype(_width(encode.vocab)).tobytes())
                    ids.append(pc.fill_null(part.column(0), _NO_ID).to_numpy())
                    sizes.append(np.diff(bounds))
        size = np.concatenate([np.zeros(1, np.int64), *sizes])
        index = np.concatenate([[len(size) - 1], *ids, np.cumsum(size)]).astype("<i8")
        with where.open_output_stream(f"{own}.idx") as to:
            to.write(index.tobytes())
        for kind in ("bin", "idx"):
            where.move(f"{own}.{kind}", f"{name}.{kind}")
        if len(size) > 1:
            yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [f"{path}/shard-{shard:05d}"], "n_docs": [len(size) - 1], "n_tokens": [int(size.sum())]})

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(write, "shard long, file string, n_docs long, n_tokens long")


def read_token_files(shards: DataFrame, tokenizer_vocab: int) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, tokens) of each document, from the files of ``shards`` with their ``base``."""
    width = np.dtype(_width(tokenizer_vocab))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                where, at = _place(name)
                if where.type_name == "local":
                    index = np.memmap(f"{at}.idx", "<i8", "r")
                    flat = np.memmap(f"{at}.bin", width, "r") if os.path.getsize(f"{at}.bin") else np.zeros(0, width)
                else:
                    index = np.frombuffer(where.open_input_file(f"{at}.idx").read(), "<i8")
                    flat = np.frombuffer(where.open_input_file(f"{at}.bin").read(), width)
                n = int(index[0])
                ids, offsets = index[1 : n + 1], index[n + 1 :]
                for i in range(0, n, 2000):
                    part = offsets[i : i + 2001]
                    crc = [zlib.crc32(flat[a:b].astype("<u4").tobytes()) for a, b in zip(part[:-1].tolist(), part[1:].tolist())]
                    here = np.asarray(ids[i : i + 2000])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(here, mask=here == _NO_ID), pa.array(part[:-1] + base), pa.array(np.diff(part)), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return shards.select("file", "base").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digests(docs: DataFrame, tokenizer_file: str, end_id: int) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and return what the files hold."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    written = scratch.table("shards", write_token_files(docs, f"{scratch.root}/files", tokenizer_file, end_id))
    base, rows = 0, []
    for x in written.orderBy("shard").collect():  # a row for each file, not for each document
        rows.append((x.file, base))
        base += x.n_tokens
    shards = spark.createDataFrame(rows, "file string, base long").repartition(max(1, len(rows)))
    return read_token_files(shards, encoder(tokenizer_file, end_id).vocab)
