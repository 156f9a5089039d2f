"""Batch operators on message logs."""
