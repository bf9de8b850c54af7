"""Readers and writers of landed pages, captures, ledgers, logs and exports."""
