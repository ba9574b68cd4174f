"""Structured Streaming: keep table summaries current as new files arrive."""

from tablescope.streaming.refresh import (REFRESH_INTERVALS, file_stream, latest, refresh,
                                          run_until_caught_up)

__all__ = ["REFRESH_INTERVALS", "file_stream", "latest", "refresh", "run_until_caught_up"]
