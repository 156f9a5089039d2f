"""Recording files, table adapters and export sinks."""
