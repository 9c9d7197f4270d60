"""Readers and writers."""

from lectern.sources.tables import checkpointed, load, scratch_folder, shared_folder

__all__ = ["checkpointed", "load", "scratch_folder", "shared_folder"]
