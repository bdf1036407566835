"""Executables: ELF facts, printable strings, entropy, and libraries by their exported symbols."""

from __future__ import annotations

import re
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed: machine numbers of ELF files.
MACHINES = {3: "x86", 8: "mips", 40: "arm", 62: "x86-64", 94: "xtensa", 183: "aarch64", 243: "riscv"}


def elf(data: bytes) -> dict | None:
    """Machine, word size, build id, SONAME and the names of defined global symbols."""
    if data[:4] != b"\x7fELF" or len(data) < 52:
        return None
    wide, end = data[4] == 2, "<" if data[5] == 1 else ">"
    try:
        machine = struct.unpack_from(end + "H", data, 18)[0]
        offset = struct.unpack_from(end + ("Q" if wide else "I"), data, 40 if wide else 32)[0]
        size, count, names_at = struct.unpack_from(end + "3H", data, 58 if wide else 46)
        sections = []
        for k in range(count):
            at = offset + k * size
            if wide:
                name, kind, _, _, begin, length, link = struct.unpack_from(end + "IIQQQQI", data, at)
            else:
                name, kind, _, _, begin, length, link = struct.unpack_from(end + "7I", data, at)
            sections.append((name, kind, begin, length, link))
        text = lambda table, at: data[table[2] + at : data.index(b"\0", table[2] + at)].decode(errors="replace")
        symbols, soname, build = [], None, None
        for _, kind, begin, length, link in sections:
            if kind in (2, 11):
                step = 24 if wide else 16
                for at in range(begin + step, begin + length - step + 1, step):
                    if wide:
                        name, info, _, section = struct.unpack_from(end + "IBBH", data, at)
                    else:
                        name, _, _, info, _, section = struct.unpack_from(end + "IIIBBH", data, at)
                    if section and info >> 4 in (1, 2) and name:
                        symbols.append(text(sections[link], name))
            elif kind == 6:
                step = 16 if wide else 8
                for at in range(begin, begin + length - step + 1, step):
                    tag, value = struct.unpack_from(end + ("qQ" if wide else "iI"), data, at)
                    if tag == 14:
                        soname = text(sections[link], value)
            elif kind == 7:
                n, d, note = struct.unpack_from(end + "3I", data, begin)
                if note == 3 and data[begin + 12 : begin + 12 + n] == b"GNU\0":
                    build = data[begin + 16 : begin + 16 + d].hex()
    except (struct.error, IndexError, ValueError):
        return None
    return {"machine": MACHINES.get(machine, str(machine)), "bits": 64 if wide else 32, "build_id": build, "soname": soname, "symbols": sorted(set(symbols))}


def elf_rows(files: DataFrame) -> DataFrame:
    """``path, machine, bits, build_id, soname, symbols`` of the ELF files among ``files(path, content)``."""
    schema = pa.schema([("path", pa.string()), ("machine", pa.string()), ("bits", pa.int32()), ("build_id", pa.string()), ("soname", pa.string()), ("symbols", pa.list_(pa.string()))])

    def run(batches):
        for b in batches:
            rows = [{"path": p.as_py()} | x for p, c in zip(b.column("path"), b.column("content"), strict=True) if (x := elf(c.as_py()))]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.filter(F.hex(F.substring("content", 1, 4)) == "7F454C46").select("path", "content").mapInArrow(run, "path string, machine string, bits int, build_id string, soname string, symbols array<string>")


def libraries(symbols: DataFrame, wanted: DataFrame) -> DataFrame:
    """Libraries of which a file exports enough: ``symbols(path, symbol)``, ``wanted(library, symbol, need)``."""
    found = symbols.distinct().join(wanted, "symbol").groupBy("path", "library").agg(F.count("*").alias("held"), F.max("need").alias("need"))
    return found.filter("held >= need").select("path", "library", "held")


def printable(data: bytes, least: int = 8) -> list[str]:
    return [m.decode("ascii") for m in re.findall(rb"[\x20-\x7e]{%d,}" % least, data)]


def string_rows(files: DataFrame, least: int = 8) -> DataFrame:
    """``path, s``: distinct printable runs of each file."""

    def run(batches):
        for b in batches:
            for p, c in zip(b.column("path"), b.column("content"), strict=True):
                found = sorted(set(printable(c.as_py() or b"", least)))
                yield pa.RecordBatch.from_arrays([pa.array([p.as_py()] * len(found), pa.string()), pa.array(found, pa.string())], ["path", "s"])

    return files.select("path", "content").mapInArrow(run, "path string, s string")


def string_matches(strings: DataFrame, reference: DataFrame, least: int = 8, share: float = 0.10) -> DataFrame:
    """``path, library, held, own``: images that hold ``least`` strings of a library and ``share`` of them."""
    own = reference.groupBy("library").agg(F.count("*").alias("own"))
    held = strings.join(reference, "s").groupBy("path", "library").agg(F.count("*").alias("held"))
    return held.join(own, "library").filter((F.col("held") >= least) & (F.col("held") >= share * F.col("own"))).select("path", "library", "held", "own")


def incompressible(data: bytes, sample: int = 64 << 10, ratio: float = 0.97) -> bool:
    """Do samples from the start, middle and end all resist compression: encrypted or packed content."""
    if len(data) < 3 * 1024:
        return False
    size = min(sample, len(data) // 3)
    parts = [data[:size], data[(len(data) - size) // 2 :][:size], data[-size:]]
    return all(len(zlib.compress(p, 6)) >= ratio * len(p) for p in parts)
