"""Readers and writers: file inventories, statements, office files, logs and reports."""
