"""Stores that tasks open themselves, without Spark's file source."""

from __future__ import annotations

from urllib.parse import quote, urlsplit

from pyarrow import fs

# Schemes of paths, and the names that Arrow has for them.
SCHEMES = {"file": "file", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs"}


def can_open(path: str) -> bool:
    """Whether a qualified path is in such a store."""
    return urlsplit(path).scheme in SCHEMES


def system_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a qualified path and its name there."""
    scheme, rest = path.split(":", 1)
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{SCHEMES[scheme]}:{quote(rest)}")
