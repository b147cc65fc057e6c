"""The append-only feed as a stream."""
