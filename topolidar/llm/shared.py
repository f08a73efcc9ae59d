"""Tables in the folder that driver and executors share."""

from topolidar.sources.scratch import drop, folder, written

__all__ = ["drop", "folder", "written"]
