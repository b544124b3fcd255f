"""Resumable runs over files as they come, and the log of tasks."""
