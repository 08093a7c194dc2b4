"""Readers and writers of interval, variant and annotation files."""
