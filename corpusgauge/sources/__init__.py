"""Readers and writers: files, manifests, predictions, ledgers, logs, reports."""
