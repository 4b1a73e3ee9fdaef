"""Files that tasks write to and read from a folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import NativeFile, fs


@contextmanager
def new_file(folder: str, name: str) -> Iterator[tuple[str, NativeFile]]:
    """A file of a folder, given by URI, as (its URI, an output stream).

    The name gets a suffix of its own, so that the attempts of a task never write
    over each other, and it appears under its name only when it is whole. Readers take the
    names from what the task that succeeded returned.
    """
    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    stem, dot, ending = name.partition(".")
    full = f"{stem}-{uuid.uuid4().hex}{dot}{ending}"
    with system.open_output_stream(f"{root}/.{full}.part") as stream:
        yield f"{folder.rstrip('/')}/{full}", stream
    system.move(f"{root}/.{full}.part", f"{root}/{full}")


@contextmanager
def existing_file(uri: str) -> Iterator[NativeFile]:
    """A file, given by URI, to be read from any place."""
    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_file(path) as stream:
        yield stream
