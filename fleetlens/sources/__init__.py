"""Readers and writers: file trees, documents, sync state, reports."""
