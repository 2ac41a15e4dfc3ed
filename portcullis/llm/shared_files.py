"""Files in the shared folder that tasks write and map into memory."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np


def local_path(uri: str) -> str | None:
    """The path of a ``file:`` address; None for other stores."""
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


class Writer:
    """A file that is written bit by bit and stands under its name, whole, when it is closed: a task
    that runs twice leaves the same file."""

    def __init__(self, uri: str):
        if (path := local_path(uri)) is not None:
            os.makedirs(os.path.dirname(path), exist_ok=True)
            self.store, self.path, self.part = None, path, f"{path}.{uuid.uuid4().hex}"
            self.out = open(self.part, "wb")
            return
        from pyarrow.fs import FileSystem

        self.store, self.path = FileSystem.from_uri(uri)
        self.part = f"{self.path}.{uuid.uuid4().hex}"
        self.store.create_dir(os.path.dirname(self.path), recursive=True)
        self.out = self.store.open_output_stream(self.part)

    def write(self, data: bytes) -> None:
        self.out.write(data)

    def close(self) -> None:
        self.out.close()
        if self.store:
            self.store.move(self.part, self.path)
        else:
            os.replace(self.part, self.path)

    def drop(self) -> None:
        """Leave nothing."""
        self.out.close()
        if self.store:
            self.store.delete_file(self.part)
        else:
            os.remove(self.part)


def put(uri: str, data: bytes) -> None:
    """Write a file in one go."""
    file = Writer(uri)
    file.write(data)
    file.close()


def mapped(uri: str) -> np.ndarray:
    """The file's bytes, mapped into memory; from another store, by way of a copy beside the task."""
    if (path := local_path(uri)) is None:
        from pyarrow.fs import FileSystem

        store, name = FileSystem.from_uri(uri)
        handle = tempfile.TemporaryFile()
        with store.open_input_stream(name) as source:
            shutil.copyfileobj(source, handle)
        handle.flush()
        return np.memmap(handle, np.uint8, "r")
    return np.memmap(path, np.uint8, "r")


def packed(arrays: dict[str, np.ndarray], **facts: object) -> bytes:
    """Arrays and facts as one block: the length of a header, the header, and the arrays at 64-byte steps."""
    places, at = {}, 0
    for name, x in arrays.items():
        places[name] = (x.dtype.str, at, len(x))
        at += -(-x.nbytes // 64) * 64
    header = json.dumps({"arrays": places, "facts": facts}).encode()
    header += b" " * (-(len(header) + 8) % 64)
    body = b"".join(x.tobytes() + b"\0" * (-x.nbytes % 64) for x in arrays.values())
    return len(header).to_bytes(8, "little") + header + body


def unpacked(block: np.ndarray) -> tuple[dict[str, np.ndarray], dict]:
    size = int(block[:8].view("<u8")[0])
    header = json.loads(bytes(block[8 : 8 + size]))
    base, arrays = 8 + size, {}
    for name, (kind, at, n) in header["arrays"].items():
        width = np.dtype(kind).itemsize
        arrays[name] = block[base + at : base + at + n * width].view(kind)
    return arrays, header["facts"]
