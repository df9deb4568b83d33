from tarn.queries import catalog, checks, columns, grants, graphs, keyed, maintained, pages, scans, syncing, texts, writes  # noqa: F401
from tarn.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
