"""Column-level building blocks: rounding, labels, time windows, diff text."""
