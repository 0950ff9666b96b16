"""tidemark: windowed analytics over telecom-style event records on Spark.

Batch and Structured Streaming forms of the same views: record sources,
projections, event-time interval and latest-row joins, sliding RANGE-frame
statistics, bounded reorder, throughput meters and log reports.
"""

from .session import build_session, checkpoint_dir, prepare

__all__ = ["build_session", "checkpoint_dir", "prepare"]
