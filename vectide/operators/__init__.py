"""Operators on windows, selections, groups and overlays."""
