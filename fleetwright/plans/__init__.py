"""Life-cycle decisions: one row per stream or class."""
