"""Episode analytics on Spark: alignment, labels, windows, splits, pooling, metrics."""
