"""Tables in the folder that all executors share."""

from ..store import drop, keep, shared_folder, shuffles_removed

__all__ = ["drop", "keep", "shared_folder", "shuffles_removed"]
