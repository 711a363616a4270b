"""The two archive layouts: bytes of headers and tables, and whole archives in memory.

Both are a header, a table with one entry for each chunk, and the payloads. `plain` entries hold id, lengths and the
payload's offset; `checked` entries also the SHA-256 of the chunk's original bytes. All numbers are big-endian.
"""

from __future__ import annotations

import functools
import hashlib
import struct
from dataclasses import dataclass

from bytemill.functions import codecs
from bytemill.schema import ArchiveError, DecodeError


_struct = functools.cache(struct.Struct)


@dataclass(frozen=True)
class Layout:
    """magic, header and entry as struct formats, and the error its readers raise."""

    name: str
    magic: bytes
    header_format: str
    entry_format: str
    error: type[ArchiveError]

    @property
    def header(self) -> struct.Struct:
        return _struct(self.header_format)

    @property
    def entry(self) -> struct.Struct:
        return _struct(self.entry_format)

    @property
    def checked(self) -> bool:
        return self.name == "checked"

    def table_at(self) -> int:
        return self.header.size

    def payload_at(self, chunks: int) -> int:
        return self.header.size + chunks * self.entry.size

    def pack_header(self, size: int, sha: bytes, chunks: int, version: int = 1) -> bytes:
        if len(sha) != 32:
            raise ValueError("a SHA-256 has 32 bytes")
        return self.header.pack(self.magic, version, size, sha, chunks)

    def pack_entry(self, algorithm: int, length: int, compressed: int, offset: int, checksum: bytes = b"") -> bytes:
        if not self.checked:
            return self.entry.pack(algorithm, length, compressed, offset)
        if len(checksum) != 32:
            raise ValueError("a SHA-256 has 32 bytes")
        return self.entry.pack(algorithm, length, compressed, checksum, offset)

    def read_header(self, head: bytes) -> dict:
        """version, size, sha256, chunks out of the first bytes of an archive."""
        if len(head) < self.header.size:
            raise self.error("too short for a header")
        magic, version, size, sha, chunks = self.header.unpack_from(head)
        if magic != self.magic:
            raise self.error(f"not a {self.name} archive: it starts with {magic!r}")
        return {"version": version, "size": size, "sha256": sha, "chunks": chunks}

    def read_table(self, table: bytes, chunks: int) -> list[dict]:
        """algorithm_id, length, compressed, offset, checksum (None in the plain layout) of each entry."""
        if len(table) < chunks * self.entry.size:
            raise self.error("too short for its table")
        out = []
        for row in self.entry.iter_unpack(table[: chunks * self.entry.size]):
            algorithm, length, compressed, *rest = row
            out.append({"algorithm_id": algorithm, "length": length, "compressed": compressed, "offset": rest[-1], "checksum": rest[0] if self.checked else None})
        return out


#: Fixed values of the formats.
PLAIN = Layout("plain", b"SZIP", ">4sBQ32sI", ">BIIQ", ArchiveError)
CHECKED = Layout("checked", b"SZE1", ">4sBQ32sI", ">BII32sQ", DecodeError)
LAYOUTS = {x.name: x for x in (PLAIN, CHECKED)}


def restore(layout: Layout, entry: dict, payload: bytes) -> bytes:
    """The original bytes of a chunk, held to its entry."""
    try:
        name = codecs.name_of(entry["algorithm_id"])
        data = codecs.decompress(payload, name)
    except Exception as e:
        raise layout.error(f"chunk can't be decompressed: {e}") from e
    if len(data) != entry["length"]:
        raise layout.error(f"chunk has {len(data)} bytes, its entry says {entry['length']}")
    if entry["checksum"] is not None and hashlib.sha256(data).digest() != entry["checksum"]:
        raise layout.error("chunk doesn't match its checksum")
    return data


def unpack(archive: bytes, layout: Layout) -> bytes:
    """The source of an archive in memory; raises the layout's error for anything that doesn't hold. Bytes behind the last payload are ignored."""
    header = layout.read_header(archive)
    table = layout.read_table(archive[layout.table_at() :], header["chunks"])
    base, out = layout.payload_at(header["chunks"]), []
    for entry in table:
        at = base + entry["offset"]
        if at + entry["compressed"] > len(archive):
            raise layout.error("payload ends behind the archive")
        out.append(restore(layout, entry, archive[at : at + entry["compressed"]]))
    data = b"".join(out)
    if len(data) != header["size"]:
        raise layout.error(f"source has {len(data)} bytes, the header says {header['size']}")
    if hashlib.sha256(data).digest() != header["sha256"]:
        raise layout.error("source doesn't match its checksum")
    return data
