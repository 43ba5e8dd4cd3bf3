"""Readers and writers of tables, frozen states and model artefacts."""
