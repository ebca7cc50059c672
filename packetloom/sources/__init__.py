"""Readers and writers: capture files, adapters from plain tables, exports."""
