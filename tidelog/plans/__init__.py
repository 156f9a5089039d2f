"""Shared query plans: ordered numbering at scale, and table locations."""
