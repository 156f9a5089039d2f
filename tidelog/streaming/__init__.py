"""Live capture of streams into a message-log table."""
