"""Image sources. Each gives rows of image_id, ord, name and Spark's image struct."""

from .images import build, from_files, from_folder, from_frame, list_files

__all__ = ["build", "from_files", "from_folder", "from_frame", "list_files"]
