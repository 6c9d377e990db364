"""Where operators put intermediate tables and files that all executors must see."""

from ..plans.lineage import cut, forget, keep, shared_folder, shared_root

__all__ = ["cut", "forget", "keep", "shared_folder", "shared_root"]
