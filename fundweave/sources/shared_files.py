"""Files of the shared folder, opened inside tasks."""

from __future__ import annotations

from pyarrow import NativeFile, fs

_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}


def opened(name: str) -> NativeFile:
    """A file by the name that Spark gives it, from any file system that Arrow reads."""
    scheme, _, rest = name.partition(":")
    if scheme == "file":
        system, path = fs.LocalFileSystem(), "/" + rest.lstrip("/").replace("%20", " ")
    else:
        system, path = fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}:{rest}")
    return system.open_input_file(path)
