"""The sample log that several tests share."""

from __future__ import annotations

START = 1_650_000_000_000
# Own sample: a greenhouse with a fast, a slow and a late stream.
READINGS = [
    ("climate", 0, {"temp": "21.5", "humidity": "60"}),
    ("climate", 40, {"temp": "21.6", "humidity": "61"}),
    ("door", 75, {"open": "true"}),
    ("climate", 80, {"temp": "21.4", "humidity": "59"}),
    ("pump", 90, {"litres": "0.25", "note": "début"}),
    ("climate", 120, {"temp": "21.9", "humidity": "58"}),
    ("door", 150, {"open": "false"}),
]
