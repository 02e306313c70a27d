"""Files of a table folder that Spark has no verb for: create one exactly once, list folders, remove them."""

from __future__ import annotations

import os
import time
from dataclasses import dataclass

from marlstone.sources.tree import Tree


@dataclass(frozen=True)
class Store:
    """A folder: a local path, or a URI of any file system that Arrow knows."""

    root: str

    def _open(self):
        from pyarrow.fs import LocalFileSystem

        tree = Tree(self.root)
        return tree.system() if tree.is_uri else (LocalFileSystem(), os.path.abspath(self.root))

    def create_once(self, name: str, content: bytes) -> bool:
        """Make a file with its whole content, unless it exists; of several writers at a time one gets True.

        On a local path a hard link decides, elsewhere a rename, which HDFS
        refuses where the target exists. Object stores that replace silently
        give no such promise.
        """
        system, base = self._open()
        target, partial = f"{base}/{name}", f"{base}/{os.path.dirname(name)}/_{os.urandom(8).hex()}.tmp"
        system.create_dir(os.path.dirname(target), recursive=True)
        with system.open_output_stream(partial) as file:
            file.write(content)
        try:
            if system.type_name == "local":
                os.link(partial, target)
            else:
                if self._exists(system, target):
                    return False
                system.move(partial, target)
            return True
        except OSError:
            if self._exists(system, target):
                return False
            raise
        finally:
            if self._exists(system, partial):
                system.delete_file(partial)

    @staticmethod
    def _exists(system, path: str) -> bool:
        from pyarrow.fs import FileType

        return system.get_file_info(path).type != FileType.NotFound

    def folders(self, name: str) -> list[str]:
        """Names of the folders in a folder; none if it is not there."""
        from pyarrow.fs import FileSelector, FileType

        system, base = self._open()
        found = system.get_file_info(FileSelector(f"{base}/{name}", allow_not_found=True))
        return sorted(info.base_name for info in found if info.type == FileType.Directory)

    def idle_seconds(self, name: str) -> float:
        """How long ago anything in a folder, itself included, was written last."""
        from pyarrow.fs import FileSelector

        system, base = self._open()
        infos = [system.get_file_info(f"{base}/{name}")]
        infos += system.get_file_info(FileSelector(f"{base}/{name}", recursive=True, allow_not_found=True))
        return time.time() - max(info.mtime.timestamp() if info.mtime else 0 for info in infos)

    def remove(self, name: str) -> None:
        system, base = self._open()
        system.delete_dir(f"{base}/{name}")
