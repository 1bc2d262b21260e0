"""Files by path or address: local, HDFS and object stores, through Arrow's file systems."""

from __future__ import annotations

import re

import pyarrow.fs as pafs


def resolve(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address and the path within it."""
    local = re.match(r"file:/*(/.*)", path)
    if local or "://" not in path:
        return pafs.LocalFileSystem(), local[1] if local else path
    return pafs.FileSystem.from_uri(path)


def natural(path: str) -> list:
    """Names in order with their numbers as numbers: slab2 before slab10."""
    return [int(part) if part.isdigit() else part for part in re.split(r"(\d+)", path)]


def listed(path: str, suffixes: tuple[str, ...]) -> list[str]:
    """A file, or the files of a folder in natural order; ValueError for other suffixes, hidden files left out."""
    fs, at = resolve(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else [i for i in fs.get_file_info(pafs.FileSelector(at)) if i.is_file and not re.match(r"[._]", i.base_name)]
    bad = [i.path for i in found if i.extension.lower() not in suffixes]
    if bad:
        raise ValueError(f"no reader for .{bad[0].rpartition('.')[2]} files: {bad[0]}")
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    return [prefix + i.path for i in sorted(found, key=lambda i: natural(i.base_name))]


def write_file(path: str, content: bytes) -> None:
    """Writes beside the file and moves, so that a file is whole and an attempt more does no harm."""
    fs, at = resolve(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    if isinstance(fs, pafs.LocalFileSystem):
        import os
        import uuid

        part = f"{at}.{uuid.uuid4().hex}"
        with open(part, "wb") as file:
            file.write(content)
        os.replace(part, at)
    else:
        with fs.open_output_stream(at) as stream:
            stream.write(content)


def read_file(path: str) -> bytes | None:
    """The whole file, or None where there is none."""
    fs, at = resolve(path)
    if not fs.get_file_info(at).is_file:
        return None
    with fs.open_input_stream(at) as stream:
        return stream.read()


def delete(path: str) -> None:
    fs, at = resolve(path)
    if fs.get_file_info(at).type == pafs.FileType.Directory:
        fs.delete_dir(at)
