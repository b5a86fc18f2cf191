"""Bounded-batch scans as streams."""
