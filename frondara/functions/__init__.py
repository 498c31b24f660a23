"""functions of frondara."""
