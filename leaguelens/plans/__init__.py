"""Named analytical queries."""
