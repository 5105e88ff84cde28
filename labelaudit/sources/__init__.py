"""Readers and writers of audit tables."""
