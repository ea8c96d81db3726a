"""Readers and writers of every table the engine uses."""
