"""Tables written between the jobs of one operator, in a folder that driver and executors share."""

from ..plans.shared import deleted_at_end, new_path, shared_dir
from ..plans.shared import materialized as saved

__all__ = ["deleted_at_end", "new_path", "saved", "shared_dir"]
