"""transitlab.streaming."""
