"""Report compositions and the benchmark query catalog."""
