"""Structured Streaming jobs: rollups, deduplication, and runs of a state per key.

All take and return streaming DataFrames, so sources, sinks and triggers are the caller's. Event
times are ``timestamp`` columns. Rows up to ``delay`` behind the latest time seen count, in whatever order
they come; a row later than that is dropped once Spark's watermark has moved past it. State is kept per key and lasts as long as
the delay, but for ``closed_runs``, which also keeps the open run of each key.
"""

from tidegauge.streaming.jobs import changes, closed_runs, deduplicated, finished, rollup

__all__ = ["changes", "closed_runs", "deduplicated", "finished", "rollup"]
