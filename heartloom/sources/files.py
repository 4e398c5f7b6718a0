"""Files of any size and place, opened in tasks."""

from __future__ import annotations

import hashlib
import re
from typing import BinaryIO

from pyarrow import fs as filesystems

#: Bytes that are read at a time.
PIECE = 8 << 20


def open_file(path: str) -> BinaryIO:
    """A file by its local path, or by a URI of a file system that pyarrow knows, for reading at any place."""
    path = re.sub(r"^file:/+", "/", path)
    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]+:", path):
        source, path = filesystems.FileSystem.from_uri(path)
    else:
        source = filesystems.LocalFileSystem()
    if source.get_file_info(path).type != filesystems.FileType.File:
        raise FileNotFoundError(f"file not found: {path}")
    return source.open_input_file(path)


def sha256_of(path: str) -> str:
    total = hashlib.sha256()
    with open_file(path) as f:
        while piece := f.read(PIECE):
            total.update(piece)
    return total.hexdigest()
