"""All queries over the driver's tables; importing this registers them."""

from quillmill.plans import corpus, files, pairs, parsing, runs, selection
from quillmill.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "corpus", "files", "pairs", "parsing", "runs", "selection"]
