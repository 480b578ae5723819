"""Tar archives of very many tiny files, which in folders would take a block of disk each."""

from __future__ import annotations

import io
import tarfile
import uuid
from collections.abc import Iterator

# fixed values: sizes of the public format
BLOCK, NAME, SIZE, SUM, KIND = 512, 100, slice(124, 135), slice(148, 156), slice(156, 157)
WRITE_AT_ONCE = 1 << 20
_BLANK = tarfile.TarInfo("").tobuf(tarfile.GNU_FORMAT)
_BLANK_SUM = sum(_BLANK) - sum(_BLANK[SIZE]) - sum(_BLANK[SUM]) + 8 * ord(" ")


def tar_entry(name: str, data: bytes) -> bytes:
    """A file as an entry; ``tarfile`` makes the same one, but in several times the time."""
    raw = name.encode()
    if len(raw) > NAME:
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.GNU_FORMAT, "utf-8")
    else:
        size = b"%011o" % len(data)
        head = b"".join((raw.ljust(NAME, b"\0"), _BLANK[NAME : SIZE.start], size, _BLANK[SIZE.stop : SUM.start], b"%06o\0 " % (_BLANK_SUM + sum(raw) + sum(size)), _BLANK[SUM.stop :]))
    return b"".join((head, data, bytes(-len(data) % BLOCK)))


def tar_files(raw) -> Iterator[tuple[str, bytes]]:
    """Names and contents of the files of an archive in order, from a stream; ValueError if it ends too soon."""
    f, long_name, end = io.BufferedReader(raw, WRITE_AT_ONCE), None, bytes(BLOCK)
    while (head := f.read(BLOCK)) != end:
        n = int(head[SIZE], 8) if len(head) == BLOCK else 0
        data = f.read(n + -n % BLOCK)
        if len(head) < BLOCK or len(data) < n:
            raise ValueError("archive ends inside a file")
        if head[KIND] == tarfile.GNUTYPE_LONGNAME:
            long_name = data[: n - 1]
            continue
        yield (long_name or head[:NAME].rstrip(b"\0")).decode(), data[:n]
        long_name = None


class TarWriter:
    """A zstandard archive written under another name and moved into its place by ``close``."""

    def __init__(self, store, path: str) -> None:
        folder = path.rsplit("/", 1)[0]
        store.create_dir(folder, recursive=True)
        self.store, self.path, self.part = store, path, f"{folder}/.{uuid.uuid4().hex}"
        self.out = store.open_output_stream(self.part, compression="zstd")
        self.held, self.n_held, self.n_bytes = [], 0, 0

    def add(self, name: str, data: bytes) -> None:
        entry = tar_entry(name, data)
        self.held.append(entry)
        self.n_held += len(entry)
        if self.n_held >= WRITE_AT_ONCE:
            self._flush()

    def _flush(self) -> None:
        self.out.write(b"".join(self.held))
        self.n_bytes += self.n_held
        self.held, self.n_held = [], 0

    def close(self) -> None:
        self.held.append(bytes(2 * BLOCK))
        self._flush()
        self.out.close()
        self.store.move(self.part, self.path)
