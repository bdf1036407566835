"""Containers as flat maps: one blob to the blobs inside it, with bounded size and depth."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import struct
import tarfile
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed: limits of one layer, of all layers of a blob, and of nesting.
MOST_LAYER, MOST_TOTAL, MOST_DEPTH = 64 << 20, 256 << 20, 3


def intel_hex(data: bytes) -> bytes | None:
    """The memory image of Intel HEX records, gaps filled with 0xFF; None if a record is broken."""
    base, parts = 0, []
    for line in data.split():
        if line[:1] != b":":
            return None
        try:
            raw = bytes.fromhex(line[1:].decode("ascii"))
        except ValueError:
            return None
        if len(raw) < 5 or len(raw) != raw[0] + 5 or sum(raw) & 0xFF:
            return None
        at, kind, body = int.from_bytes(raw[1:3], "big"), raw[3], raw[4:-1]
        if kind == 0:
            parts.append((base + at, body))
        elif kind == 1:
            break
        elif kind == 2:
            base = int.from_bytes(body, "big") << 4
        elif kind == 4:
            base = int.from_bytes(body, "big") << 16
    return _image(parts)


def srec(data: bytes) -> bytes | None:
    """The memory image of Motorola S-records."""
    parts = []
    for line in data.split():
        if line[:1] != b"S" or not line[1:2].isdigit():
            return None
        kind = int(line[1:2])
        try:
            raw = bytes.fromhex(line[2:].decode("ascii"))
        except ValueError:
            return None
        if not raw or raw[0] != len(raw) - 1 or (sum(raw) & 0xFF) != 0xFF:
            return None
        if kind in (1, 2, 3):
            n = kind + 1
            parts.append((int.from_bytes(raw[1 : 1 + n], "big"), raw[1 + n : -1]))
    return _image(parts)


def uf2(data: bytes) -> bytes | None:
    parts = []
    for k in range(0, len(data) - 511, 512):
        a, b, flags, at, size = struct.unpack_from("<5I", data, k)
        if (a, b) != (0x0A324655, 0x9E5D5157) or size > 476:
            return None
        if not flags & 1:
            parts.append((at, data[k + 32 : k + 32 + size]))
    return _image(parts)


def _image(parts: list[tuple[int, bytes]]) -> bytes | None:
    if not parts:
        return None
    low, high = min(a for a, _ in parts), max(a + len(b) for a, b in parts)
    if high - low > MOST_LAYER:
        return None
    out = bytearray(b"\xff" * (high - low))
    for a, b in parts:
        out[a - low : a - low + len(b)] = b
    return bytes(out)


def _bounded(read) -> bytes | None:
    try:
        out = read(MOST_LAYER + 1)
    except (OSError, EOFError, zlib.error, lzma.LZMAError, ValueError):
        return None
    return out if len(out) <= MOST_LAYER else None


def uimage(data: bytes) -> bytes | None:
    """The payload of a U-Boot image."""
    if data[:4] != b"\x27\x05\x19\x56" or len(data) < 64:
        return None
    size = int.from_bytes(data[12:16], "big")
    return data[64 : 64 + size] if 0 < size <= len(data) - 64 else None


def cpio(data: bytes) -> list[tuple[str, bytes]]:
    """Files of a ``newc`` archive."""
    out, at = [], 0
    while data[at : at + 6] in (b"070701", b"070702") and at + 110 <= len(data):
        try:
            f = [int(data[at + 6 + 8 * k : at + 14 + 8 * k], 16) for k in range(13)]
        except ValueError:
            break
        name = data[at + 110 : at + 110 + f[11] - 1].decode(errors="replace")
        begin = (at + 110 + f[11] + 3) & ~3
        if name == "TRAILER!!!" or begin + f[6] > len(data):
            break
        if f[1] & 0o170000 == 0o100000 and f[6] <= MOST_LAYER:
            out.append((name.lstrip("/"), data[begin : begin + f[6]]))
        at = (begin + f[6] + 3) & ~3
    return out


def layers(data: bytes) -> list[tuple[str, bytes]]:
    """``(name, bytes)`` one level below ``data``."""
    single = None
    if data[:1] == b":":
        single = ("hex", intel_hex(data))
    elif data[:1] == b"S" and data[1:2].isdigit():
        single = ("srec", srec(data))
    elif data[:4] == b"UF2\n":
        single = ("uf2", uf2(data))
    elif data[:4] == b"\x27\x05\x19\x56":
        single = ("uimage", uimage(data))
    elif data[:2] == b"\x1f\x8b":
        single = ("gzip", _bounded(gzip.GzipFile(fileobj=io.BytesIO(data)).read))
    elif data[:6] == b"\xfd7zXZ\x00":
        single = ("xz", _bounded(lzma.LZMAFile(io.BytesIO(data)).read))
    elif data[:3] == b"BZh":
        single = ("bzip2", _bounded(bz2.BZ2File(io.BytesIO(data)).read))
    if single:
        return [single] if single[1] else []
    if data[:4] == b"PK\x03\x04":
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                return [(i.filename, b) for i in z.infolist() if not i.is_dir() and i.file_size <= MOST_LAYER and (b := _bounded(z.open(i).read)) is not None]
        except (zipfile.BadZipFile, NotImplementedError, RuntimeError):
            return []
    if data[257:262] == b"ustar":
        try:
            with tarfile.open(fileobj=io.BytesIO(data)) as t:
                return [(m.name, t.extractfile(m).read()) for m in t if m.isfile() and m.size <= MOST_LAYER]
        except tarfile.TarError:
            return []
    return cpio(data) if data[:6] in (b"070701", b"070702") else []


def unpacked(data: bytes) -> list[tuple[str, int, bytes]]:
    """``(path inside, depth, bytes)`` of everything below ``data``, within the limits."""
    out, total, todo = [], 0, [("", 0, data)]
    while todo:
        at, depth, blob = todo.pop(0)
        if depth >= MOST_DEPTH:
            continue
        for name, inner in layers(blob):
            total += len(inner)
            if total > MOST_TOTAL:
                return out
            path = f"{at}/{name}" if at else name
            out.append((path, depth + 1, inner))
            todo.append((path, depth + 1, inner))
    return out


def expanded(files: DataFrame) -> DataFrame:
    """``path, inside, depth, content`` for each blob below each of ``files(path, content)``."""

    def run(batches):
        for b in batches:
            for p, c in zip(b.column("path"), b.column("content"), strict=True):
                for inside, depth, blob in unpacked(c.as_py() or b""):
                    yield pa.RecordBatch.from_arrays([pa.array([p.as_py()]), pa.array([inside]), pa.array([depth], pa.int32()), pa.array([blob], pa.binary())], ["path", "inside", "depth", "content"])

    return files.select("path", "content").mapInArrow(run, "path string, inside string, depth int, content binary")
