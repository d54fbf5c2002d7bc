"""The query catalogue: every query with its SQL twin."""
