"""epochweave: epoch-ordered execution data, layered key-value state and corpus work on Spark."""
