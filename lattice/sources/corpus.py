"""Reading corpora: JSON lines, JSON arrays and single objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.schemas import DOCUMENT


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Documents (id, title, context, text) of a corpus.

    Lines are read one by one; blank and malformed ones are dropped, and an
    array in one line becomes several documents. A file whose lines give
    nothing is read again as one JSON value. Raises FileNotFoundError for a
    missing path and ValueError if neither way finds a document.
    """
    try:
        lines = spark.read.schema(DOCUMENT).option("mode", "DROPMALFORMED").json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(path) from e
        raise
    found = lines.where("context IS NOT NULL OR text IS NOT NULL OR title IS NOT NULL OR id IS NOT NULL")
    if not found.isEmpty():
        return found
    whole = spark.read.schema(DOCUMENT).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    whole = whole.where("context IS NOT NULL OR text IS NOT NULL OR title IS NOT NULL OR id IS NOT NULL")
    if whole.isEmpty():
        raise ValueError(f"no document can be read from {path}")
    return whole


def resolve_fields(docs: DataFrame) -> DataFrame:
    """(id, title, body): context before text, an empty context included; missing ones are empty."""
    return docs.select("id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("context", "text", F.lit("")).alias("body"))
