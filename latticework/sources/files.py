"""Files in any store that pyarrow's file systems open, for sources whose formats Spark doesn't read itself."""

from __future__ import annotations


def store(path: str):
    """A file system and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def opened(path: str):
    """For reading; can be moved about in."""
    system, at = store(path)
    return system.open_input_file(at)


def created(path: str):
    """For writing from begin to end; folders are made."""
    system, at = store(path)
    system.create_dir(at.rsplit("/", 1)[0] or "/", recursive=True)
    return system.open_output_stream(at)


def listed(path: str, suffix: str) -> list[str]:
    """path itself if it ends in suffix, else the files of that folder that do, by name."""
    from pyarrow import fs

    if path.lower().endswith(suffix):
        return [path]
    system, at = store(path)
    root = path[: path.index(at)]
    return sorted(root + f.path for f in system.get_file_info(fs.FileSelector(at)) if f.path.lower().endswith(suffix))
