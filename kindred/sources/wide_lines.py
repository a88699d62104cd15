"""A Spark data source for line files whose characters have two or four bytes: one file is read by many tasks."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Width of a character, byte order and marks of each charset.
CHARSETS = {
    "utf16": (2, None), "utf16le": (2, "little"), "utf16be": (2, "big"),
    "utf32": (4, None), "utf32le": (4, "little"), "utf32be": (4, "big"),
}
MARKS = {2: {b"\xff\xfe": "little", b"\xfe\xff": "big"}, 4: {b"\xff\xfe\x00\x00": "little", b"\x00\x00\xfe\xff": "big"}}
SPLIT_BYTES, STEP = 64 << 20, 1 << 20


def plain(encoding: str) -> str:
    return encoding.lower().replace("-", "").replace("_", "")


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


class Part(InputPartition):
    def __init__(self, path: str, begin: int, end: int, first: int, order: str) -> None:
        self.path, self.begin, self.end, self.first, self.order = path, begin, end, first, order


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.width, self.order = CHARSETS[plain(options["encoding"])]
        self.split = max(self.width, int(options.get("splitbytes", SPLIT_BYTES)) // self.width * self.width)

    def partitions(self) -> Sequence[InputPartition]:
        store, where = _open(self.path)
        info = store.get_file_info(where)
        files = [info] if info.type == fs.FileType.File else sorted((f for f in store.get_file_info(fs.FileSelector(where)) if f.type == fs.FileType.File), key=lambda f: f.path)
        parts = []
        for f in files:
            with store.open_input_file(f.path) as source:
                mark = source.read(self.width)
            known = MARKS[self.width].get(mark)
            first = self.width if known else 0
            order = self.order or known or "big"
            parts += [Part(f.path, at, min(at + self.split, f.size), first, order) for at in range(first, f.size, self.split)]
        return parts

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        """The lines that begin in a range of bytes; ``line`` is null where ``bytes`` aren't text."""
        unit = self.width
        feed = (10).to_bytes(unit, part.order)
        charset = f"utf-{8 * unit}-{'le' if part.order == 'little' else 'be'}"
        store, _ = _open(self.path)

        def aligned(data: bytes, start: int) -> int:
            at = data.find(feed, start)
            while at >= 0 and at % unit:
                at = data.find(feed, at + 1)
            return at

        rows: list[tuple[int, str | None, bytes | None]] = []

        def add(at: int, raw: bytes) -> None:
            try:
                text = raw.decode(charset)
                rows.append((at, text[:-1] if text.endswith("\r") else text, None))
            except UnicodeDecodeError:
                rows.append((at, None, raw))

        def batch() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int64(), pa.string(), pa.binary()))], names=["seq", "line", "bytes"])
            rows.clear()
            return out

        with store.open_input_file(part.path) as source:
            # A range begins after the first line feed that ends at its first byte or later.
            at = part.begin - unit if part.begin > part.first else part.begin
            skip = part.begin > part.first
            source.seek(at)
            held = b""
            while True:
                data = source.read(STEP)
                held += data
                done, stop = 0, aligned(held, 0)
                while stop >= 0:
                    if skip:
                        skip = False
                    elif at + done < part.end:
                        add(at + done, held[done:stop])
                    done = stop + unit
                    if at + done >= part.end:
                        break
                    stop = aligned(held, done)
                at, held = at + done, held[done:]
                if len(rows) >= 8192:
                    yield batch()
                if at >= part.end and not skip:
                    break
                if not data:
                    if held and not skip and at < part.end:
                        add(at, held)
                    break
        if rows:
            yield batch()


class WideLines(DataSource):
    """``seq, line, bytes``: options ``path``, ``encoding`` and ``splitBytes``; ``seq`` is the line's place in its file."""

    @classmethod
    def name(cls) -> str:
        return "wide_lines"

    def schema(self) -> str:
        return "seq long, line string, bytes binary"

    def reader(self, schema: object) -> Reader:
        return Reader(self.options)
