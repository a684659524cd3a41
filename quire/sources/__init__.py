"""Readers and writers: document folders, repositories, records, registries."""
