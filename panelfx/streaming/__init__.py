from .refresh import hour_bar_stream, read_latest, upsert_stream
from .rolling import rolling_stream, run_rolling

__all__ = ["hour_bar_stream", "read_latest", "rolling_stream", "run_rolling", "upsert_stream"]
