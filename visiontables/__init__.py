"""Detection, mask, tile and track tables as Spark DataFrames."""

from visiontables.session import checkpoint, local_session

__all__ = ["checkpoint", "local_session"]
