"""Splitters as table functions that SQL calls by name.

    SELECT * FROM split_recursive(TABLE(SELECT doc_id, text FROM documents) PARTITION BY doc_id)

The table has the columns doc_id and text. PARTITION BY deals the documents anew; without it they are split where they lie.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from ..operators import concept_spans, splitting

SPLITTERS: dict[str, Callable] = {
    "split_boundary_windows": splitting.boundary_windows,
    "split_recursive": splitting.recursive,
    "split_structured_lines": splitting.structured_lines,
    "split_structure_windows": splitting.structure_windows,
    "split_prefixed_structure": splitting.prefixed_structure,
    "split_by_sentence_length": splitting.by_sentence_length,
    "split_concept_windows": concept_spans.concept_windows,
    "split_concept_levels": concept_spans.concept_levels,
}


def register(spark: SparkSession, name: str, key: str = "bigint", **parameters) -> None:
    """Makes the splitter of that name, with these parameters, known to SQL. key: the type of doc_id. The rows are those of the
    function on DataFrames: doc_id, chunk_index and the splitter's columns."""
    walk, columns = SPLITTERS[name](None, **parameters)
    exact = [float if c.endswith(" double") else lambda x: x for c in columns.split(", ")]  # a whole number is no double to a table function

    class Split:
        def eval(self, row: Row):
            for i, chunk in enumerate(walk(row["text"] or "")):
                yield (row["doc_id"], i, *[f(x) for f, x in zip(exact, chunk)])

    spark.udtf.register(name, F.udtf(Split, returnType=f"doc_id {key}, chunk_index int, {columns}"))


def register_all(spark: SparkSession, key: str = "bigint") -> None:
    for name in SPLITTERS:
        register(spark, name, key)
