"""Dump files: globs, folders, compression by name, zip archives."""

from __future__ import annotations

import bz2
import glob
import gzip
import io
import lzma
import os
import zipfile
from collections.abc import Iterable
from typing import BinaryIO, TextIO

SUFFIXES = (".gz", ".bz2", ".xz", ".zst", ".zip")


def local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:") if path.startswith("file:") else path


def expand(paths: str | Iterable[str]) -> list[str]:
    """Files of paths, globs and folders (their ``.sql`` files, compressed or not), in order. A path without a file is an error."""
    out: list[str] = []
    for p in [paths] if isinstance(paths, str) else paths:
        p = local(p)
        if os.path.isdir(p):
            found = sorted(os.path.join(p, f) for f in os.listdir(p) if ".sql" in f.lower())
        else:
            found = sorted(glob.glob(p)) if glob.has_magic(p) else [p]
        if not found or not all(map(os.path.exists, found)):
            raise FileNotFoundError(p)
        out += found
    return list(dict.fromkeys(out))


def is_compressed(path: str) -> bool:
    return path.lower().endswith(SUFFIXES)


def open_bytes(path: str) -> BinaryIO:
    """The uncompressed bytes of a file; members of multi-member files follow each other. A zip must hold exactly one ``.sql`` file, whose CRC is checked as it is read."""
    path = local(path)
    low = path.lower()
    if low.endswith(".gz"):
        return gzip.open(path, "rb")
    if low.endswith(".bz2"):
        return bz2.open(path, "rb")
    if low.endswith(".xz"):
        return lzma.open(path, "rb")
    if low.endswith(".zst"):
        import zstandard

        return io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(open(path, "rb"), read_across_frames=True, closefd=True), 1 << 20)
    if low.endswith(".zip"):
        archive = zipfile.ZipFile(path)
        members = [m for m in archive.namelist() if m.lower().endswith(".sql") and not m.startswith("__MACOSX")]
        if len(members) != 1:
            raise ValueError(f"{path} holds {len(members)} .sql files, not one")
        return archive.open(members[0])
    return open(path, "rb")


class _Range(io.RawIOBase):
    """Bytes [start, end) of a file."""

    def __init__(self, path: str, start: int, end: int) -> None:
        self.file = open(local(path), "rb")
        self.file.seek(start)
        self.left = end - start

    def readable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        data = self.file.read(min(len(b), self.left))
        b[: len(data)] = data
        self.left -= len(data)
        return len(data)

    def close(self) -> None:
        self.file.close()
        super().close()


def open_text(path: str, start: int = 0, end: int = -1) -> TextIO:
    """A text stream; bytes that are no UTF-8 become lone surrogates, so that they can be told and written again."""
    raw = open_bytes(path) if end < 0 else io.BufferedReader(_Range(path, start, end), 1 << 20)
    return io.TextIOWrapper(raw, encoding="utf-8-sig" if start == 0 else "utf-8", errors="surrogateescape", newline="")
