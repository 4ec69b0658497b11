"""Part of the quern query engine."""
