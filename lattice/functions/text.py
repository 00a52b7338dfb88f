"""Column functions on text and vectors; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added to norms, so that a zero vector is at distance 1 from all.
EPSILON = 1e-10


def stripped(c: Column) -> Column:
    """Without white space of any kind at both ends (``trim`` takes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def name_key(c: Column) -> Column:
    return F.lower(stripped(c))


def stable_id(*parts: Column) -> Column:
    """Twelve hex digits from a natural key: the same on every run."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 12)


def label(name: Column, description: Column) -> Column:
    return F.concat(name, F.lit(": "), description)


def shortened(c: Column, size: int, always: bool = False) -> Column:
    """The first ``size`` characters, followed by dots if any are missing (or always)."""
    cut = F.concat(F.left(c, F.lit(size)), F.lit("..."))
    return cut if always else F.when(F.length(c) > size, cut).otherwise(c)


def contains_literally(c: Column, wanted: str) -> Column:
    """Case-insensitive substring test; %, _ and \\ stand for themselves."""
    return F.contains(F.lower(c), F.lower(F.lit(wanted)))


def dot(a: str, b: str) -> Column:
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) * cast(y as double)), 0D, (s, x) -> s + x)")


def norm(a: str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str, b: str) -> Column:
    """Cosine similarity with EPSILON added to the product of the norms."""
    return dot(a, b) / (norm(a) * norm(b) + F.lit(EPSILON))


def _named(value: Column, made: Callable[[Column], Column]) -> Column:
    """``made`` of a value that is worked out once, however often ``made`` names it."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """Deterministic feature hashing of lower-case words into a unit vector."""
    tokens = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda t: t != "")
    slot = lambda t: F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % dim
    sign = lambda t: F.when(F.substring(F.md5(t), 9, 1) < "8", F.lit(1.0)).otherwise(F.lit(-1.0))
    parts = F.transform(tokens, lambda t: F.struct(slot(t).alias("slot"), sign(t).alias("sign")))
    counts = lambda parts: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(F.filter(parts, lambda p: p["slot"] == i), F.lit(0.0), lambda s, p: s + p["sign"]))
    size = lambda raw: F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    unit = lambda raw: _named(size(raw), lambda n: F.transform(raw, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))))
    return _named(parts, lambda parts: _named(counts(parts), unit))


def json_object(c: Column, schema: str) -> Column:
    """The object between the first { and the last } of a free text, or null."""
    return F.from_json(F.regexp_extract(c, r"(?s)\{.*\}", 0), schema)
