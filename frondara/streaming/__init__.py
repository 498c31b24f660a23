"""streaming of frondara."""
