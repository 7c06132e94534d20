"""Readers and writers: scripts, translation files, reports, progress, archives and compiled containers."""
