"""quire: an article corpus and title search engine written as Spark jobs.

Every operator is a function from DataFrames (and Columns) to DataFrames,
so Catalyst sees one lazy plan from the parquet scans to the rendered
answer.  See README.md for the module map.
"""

from quire.operators.corpus import Corpus  # noqa: F401

__all__ = ["Corpus"]
