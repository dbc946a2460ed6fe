"""Read correctors: Python over Arrow batches, against a broadcast solid set."""
