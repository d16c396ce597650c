"""Durable cuts of the lineage for the text operators."""

from sarafa.session import cut, shared_folder, work_path

__all__ = ["cut", "shared_folder", "work_path"]
