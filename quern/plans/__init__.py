"""Whole runs: read, work, write, report."""
