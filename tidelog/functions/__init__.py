"""Column functions: message IDs, clocks and field maps."""
