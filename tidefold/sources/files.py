"""Binary files by path or URI, from the driver and from executors."""

from __future__ import annotations

import uuid

from pyarrow import fs


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def read_bytes(uri: str) -> bytes:
    files, path = resolve(uri)
    with files.open_input_stream(path, compression=None) as f:
        return f.read()


def write_bytes(uri: str, data: bytes) -> None:
    """Write under a name of this attempt's own first, so a reader never sees half a file, nor two attempts each other's."""
    files, path = resolve(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    with files.open_output_stream(own, compression=None) as f:
        f.write(data)
    files.move(own, path)


def listing(uri: str) -> list[str]:
    """Names of the files of a folder, sorted; none if there is no folder."""
    files, path = resolve(uri)
    found = files.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == fs.FileType.File)


def remove(uri: str) -> None:
    files, path = resolve(uri)
    files.delete_file(path)
