"""plans of frondara."""
