"""Ingestion: documents land as JSON lines and are added in micro-batches, exactly once by checkpoint.

The landing folder is the queue: enqueueing writes files there, a running stream
takes each file once, one batch at a time, and what its log doesn't name yet is pending.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lattice.plans.engine import Engine
from lattice.schemas import DOCUMENT
from lattice.sources.store import Lease


def document_stream(spark: SparkSession, landing: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(DOCUMENT).option("maxFilesPerTrigger", files_per_batch).option("mode", "DROPMALFORMED").json(landing)


def ingest(spark: SparkSession, landing: str, checkpoint: str, add: Callable[[DataFrame, int], None], every: str | None = "180 seconds") -> StreamingQuery:
    """Start adding what lands in ``landing``; ``every`` None drains it once and stops (a forced flush)."""
    writer = document_stream(spark, landing).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


def status(query: StreamingQuery) -> str:
    """idle, running, done or error."""
    if query.exception() is not None:
        return "error"
    if not query.isActive:
        return "done"
    return "running" if query.status["isTriggerActive"] else "idle"


def enqueue(docs: DataFrame, landing: str) -> None:
    """Write documents (id, title, context, text, as far as they have them) into the landing folder; files appear there whole."""
    docs.write.mode("append").json(landing)


def pending(spark: SparkSession, landing: str, checkpoint: str) -> int:
    """How many documents wait: those in landed files that no finished batch has taken."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    here = hadoop.Path(landing)
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(here):
        return 0
    landed = [f.getPath() for f in fs.listStatus(here) if f.isFile() and f.getPath().getName()[0] not in "._"]
    done = set()
    logs, commits = hadoop.Path(f"{checkpoint}/sources/0"), hadoop.Path(f"{checkpoint}/commits")
    store = logs.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(logs) and store.exists(commits):
        finished = {f.getPath().getName() for f in store.listStatus(commits)}
        entries = spark.read.text(f"{checkpoint}/sources/0").select(F.from_json("value", "path string, batchId long").alias("e")).where("e.path IS NOT NULL").select("e.*")
        done = {r.path.rpartition("/")[2] for r in entries.collect() if str(r.batchId) in finished}  # a line for each landed file
    rest = [p.toString() for p in landed if p.getName() not in done]
    return spark.read.schema(DOCUMENT).option("mode", "DROPMALFORMED").json(rest).count() if rest else 0


def shutdown(query: StreamingQuery) -> None:
    """Add what has landed, then stop."""
    if query.isActive:
        query.processAllAvailable()
        query.stop()


def reindex(engine: Engine, landing: str, checkpoint: str, seconds: float = 3600.0, background: bool = True) -> bool:
    """Add what has landed, in a thread of its own; False, and nothing started, while another reindex of this store runs anywhere.

    ``reindex_state`` tells how the latest one stands or ended. One whose holder died can be started again after ``seconds``.
    """
    lease = Lease(engine.store, "reindex", seconds)
    if not lease.start():
        return False
    waiting = pending(engine.spark, landing, checkpoint)

    def add(batch: DataFrame, _: int) -> None:
        lease.renew()
        if not batch.isEmpty():
            engine.add(batch)

    def work() -> None:
        try:
            ingest(engine.spark, landing, checkpoint, add, every=None).awaitTermination()
            lease.finish("done", f"{waiting} documents, now " + ", ".join(f"{n} {k}" for k, n in engine.stats().items()))
        except Exception as e:
            lease.finish("error", str(e)[:1000])
            if not background:
                raise

    if background:
        threading.Thread(target=work, name="reindex", daemon=True).start()
    else:
        work()
    return True


def reindex_state(engine: Engine) -> dict:
    """state (idle, running, done, error or lost) and message of the latest reindex of this store."""
    return Lease(engine.store, "reindex").state()
