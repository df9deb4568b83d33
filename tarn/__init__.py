"""tarn: a layered, versioned lake of Spark DataFrames.

source -> raw -> (enrichment) -> clean -> graph, served through read-only SQL.
"""

from tarn.lake.store import LakeStore
from tarn.session import build_session

__all__ = ["LakeStore", "build_session"]
