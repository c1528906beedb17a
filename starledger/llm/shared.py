"""Tables and files that every executor can see."""

from ..scratch import Scratch, new_path, shared_dir, table  # noqa: F401
