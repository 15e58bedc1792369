"""Chunks, deltas, reconstruction, batches, extents, statistics."""
