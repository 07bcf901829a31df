"""transitlab.sinks."""
