"""Operators that prepare text for training: filters, dedup, counts, scoring, coding."""
