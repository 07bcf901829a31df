"""transitlab.functions."""
