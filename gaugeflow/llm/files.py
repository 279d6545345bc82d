"""Binary files written by tasks into a folder that all machines share.

A task writes under a name of its own and moves the whole file into place, so
a retried or doubled attempt leaves one complete file. Folders are whole URIs
(see ``shared_dir``), of a file system that Arrow opens too.
"""

from __future__ import annotations

import contextlib
import uuid

from pyarrow import fs


def put(uri: str, data: bytes) -> None:
    """Write ``data`` to ``uri`` (any scheme that Arrow's file systems open).

    Some file systems refuse to move onto a name that is taken. An earlier
    attempt of the same task wrote that file whole, and with the same bytes, so
    it is left where it is."""
    store, path = fs.FileSystem.from_uri(uri)
    folder, _, name = path.rpartition("/")
    store.create_dir(folder, recursive=True)
    temporary = f"{folder}/_{uuid.uuid4().hex}-{name}"
    with store.open_output_stream(temporary, compression=None) as out:
        out.write(data)
    try:
        store.move(temporary, path)
    except OSError:
        if store.get_file_info(path).size != len(data):
            raise
        with contextlib.suppress(OSError):
            store.delete_file(temporary)
