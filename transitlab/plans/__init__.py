"""transitlab.plans."""
