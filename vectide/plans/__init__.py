"""Composite plans: views, artifacts, sweeps, jobs."""
