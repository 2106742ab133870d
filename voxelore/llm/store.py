"""Tables in the folder that driver and executors share."""

from voxelore.plans.store import new_path, remove, shared_dir, written

__all__ = ["new_path", "remove", "shared_dir", "written"]
