"""Structured Streaming wrapper around the incremental lead attribution."""

from touchpoint.streaming.lead_stream import load_batch, release_pending, start_lead_stream

__all__ = ["load_batch", "release_pending", "start_lead_stream"]
