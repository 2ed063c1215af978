"""Files written and read by tasks in the folder that all executors share."""

from __future__ import annotations

import re
import uuid

from pyarrow import fs


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder's URI (``file:/x`` and plain paths too)."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def write_file(folder: str, stem: str, suffix: str, parts) -> str:
    """Write ``parts`` (bytes) under a name no other attempt uses; returns the full path.

    A task that runs twice leaves two files; only the one whose name its
    successful attempt returned is ever read.
    """
    system, base = open_folder(folder)
    system.create_dir(base, recursive=True)
    name = f"{stem}-{uuid.uuid4().hex}{suffix}"
    with system.open_output_stream(f"{base}/{name}", compression=None) as out:
        for part in parts:
            out.write(part)
    return f"{folder.rstrip('/')}/{name}"


def open_file(path: str):
    system, base = open_folder(path)
    return system.open_input_file(base)
