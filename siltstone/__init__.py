"""Columnar analytics over versioned files, chunks, manifests and logs, on Spark."""
