"""Plan helpers: cutting lineage, size-checked broadcasts, joins with hot keys."""

from assayer.plans.materialise import bounded_batches, broadcast_if_small, checkpoint_folder, cut, fresh_names, join_counted, packed, remove_folder

__all__ = ["bounded_batches", "broadcast_if_small", "checkpoint_folder", "cut", "fresh_names", "join_counted", "packed", "remove_folder"]
