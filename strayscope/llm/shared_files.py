"""Plain files in the shared folder, through whatever file system its URI names.

Tasks write each file under a name of their own attempt and report the name in
their output rows, so a repeated or lost attempt leaves at most an unused file."""

from __future__ import annotations

import re
import uuid

import pyarrow.fs as pafs


def locate(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of ``uri`` (Hadoop's ``file:/x`` spelling included)."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?=[^/])", "file:///", uri))


def create(folder: str, stem: str, suffix: str):
    """(uri, output stream) of a new file in ``folder``."""
    uri = f"{folder}/{stem}-{uuid.uuid4().hex}{suffix}"
    fs, path = locate(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return uri, fs.open_output_stream(path)


def open_stream(uri: str):
    fs, path = locate(uri)
    return fs.open_input_stream(path)


def open_random(uri: str):
    fs, path = locate(uri)
    return fs.open_input_file(path)
