"""Prompts for a language model, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXTRACT = """List the entities of the text and how they relate.
Answer with one JSON object: {"entities": [{"name": "...", "type": "...", "description": "..."}], "relations": [{"source": "...", "target": "...", "description": "..."}]}

Text:
%s"""
DESCRIBE = """The notes below are about one entity, %s. Put them into one description without repeating anything.

Notes:
%s"""
SUMMARISE = """The entries below belong together. Say in one paragraph what they are about and how they connect.

Entries:
%s"""
RANK = """Question: %s

From the material below take the points that help to answer it, each with a score from 0 to 100 for how much.
Answer with one JSON object: {"points": [{"description": "...", "score": 0}]}

Material:
%s"""
ANSWER = """Question: %s

Answer it from the scored points below, the highest scores first. Say so if they don't answer it.

Points:
%s"""


def filled(template: str, *parts: Column) -> Column:
    """``template`` with its %s places filled in order; a null part is empty, and % in a part stays as it is."""
    pieces = template.split("%s")
    if len(pieces) != len(parts) + 1:
        raise ValueError(f"the template has {len(pieces) - 1} places, not {len(parts)}")
    columns = [F.lit(pieces[0])]
    for part, piece in zip(parts, pieces[1:]):
        columns += [F.coalesce(part.cast("string"), F.lit("")), F.lit(piece)]
    return F.concat(*columns)
