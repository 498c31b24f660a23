"""operators of frondara."""
