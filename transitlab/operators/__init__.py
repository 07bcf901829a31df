"""transitlab.operators."""
