"""sources of frondara."""
