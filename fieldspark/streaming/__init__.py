"""Logger readings as they arrive."""
