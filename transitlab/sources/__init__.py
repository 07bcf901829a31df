"""transitlab.sources."""
