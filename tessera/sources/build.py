"""Build records: link maps, compile databases, kconfig values and IDE projects."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def whole_files(spark: SparkSession, path: str, most: int = 16 << 20) -> DataFrame:
    """``path, text`` of regular files up to ``most`` bytes, without version-control and cache folders."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return b.filter((F.col("length") <= most) & ~F.col("path").rlike(r"/(\.git|\.svn|\.hg|__pycache__|node_modules)/")).select("path", F.decode("content", "ISO-8859-1").alias("text"), F.col("content"))


def per_file(files: DataFrame, parse: Callable[..., list[dict]], schema: str, with_path: bool = False) -> DataFrame:
    """``parse(text)``, or ``parse(path, text)``, of each file as rows with its ``path``; ``schema`` names what each dict has."""
    names = [x.strip().split()[0] for x in schema.split(",")]

    def run(batches):
        for b in batches:
            rows = [{"path": p.as_py()} | r for p, t in zip(b.column("path"), b.column("text"), strict=True) for r in (parse(p.as_py(), t.as_py() or "") if with_path else parse(t.as_py() or ""))]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow) if rows else pa.RecordBatch.from_pylist([], schema=arrow)

    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
    arrow = pa.schema([("path", pa.string())] + [(n, types[x.strip().split()[1]]) for n, x in zip(names, schema.split(","), strict=True)])
    return files.select("path", "text").mapInArrow(run, f"path string, {schema}")


LINK_MEMBERS = "archive string, member string, kept boolean"


def link_map(text: str) -> list[dict]:
    """Objects of a link map, whichever linker wrote it."""
    head = text[:4000]
    if "IAR ELF Linker" in head or "*** MODULE SUMMARY" in text:
        return iar_map(text)
    if "Image component sizes" in text or "Component: ARM Compiler" in head or "Arm Compiler" in head:
        return arm_map(text)
    if re.search(r"TMS320|TI ARM Linker|TI Linker|TI-\w+ Linker|MODULE SUMMARY", text):
        return ti_map(text)
    return gnu_map(text)


def _rows(kept: set[tuple[str | None, str]], gone: set[tuple[str | None, str]] = frozenset()) -> list[dict]:
    rows = [{"archive": a, "member": o, "kept": True} for a, o in kept] + [{"archive": a, "member": o, "kept": False} for a, o in gone - kept]
    return sorted(rows, key=lambda r: (r["archive"] or "", r["member"]))


def iar_map(text: str) -> list[dict]:
    """The module summary of an IAR map: objects under a folder or an archive with their sizes; none of a size means not linked."""
    kept, gone, archive, inside = set(), set(), None, False
    for line in text.splitlines():
        if "*** MODULE SUMMARY" in line:
            inside = True
        elif inside and line.startswith("***") and "MODULE SUMMARY" not in line and line.strip("* "):
            break
        elif inside and (m := re.match(r"(\S.*?): \[\d+\]\s*$", line)):
            archive = m[1].replace("\\", "/").rsplit("/", 1)[-1] if m[1].endswith((".a", ".lib")) else None
        elif inside and (m := re.match(r"\s+(\S+\.o)\b\s*(.*)$", line)):
            (kept if re.search(r"[1-9]", m[2]) else gone).add((archive, m[1]))
    return _rows(kept, gone)


def arm_map(text: str) -> list[dict]:
    """The component sizes and removed sections of an Arm map."""
    kept, gone, archive = set(), set(), False
    for m in re.finditer(r"(?m)^\s+Removing (\S+?)\(", text):
        gone.add((None, m[1]))
    part = text.split("Image component sizes", 1)[-1]
    for line in part.splitlines():
        if "Library Member Name" in line:
            archive = True
        elif "Library Name" in line and "Member" not in line:
            break
        elif m := re.match(r"\s+((?:\d+\s+){5,6})\d*\s*(\S+\.o)(?:\s+(\S+))?\s*$", line):
            kept.add((m[3] if archive else None, m[2]))
    return _rows(kept, gone)


def ti_map(text: str) -> list[dict]:
    """The module summary of a TI map: objects under their library, with sizes."""
    kept, archive, inside = set(), None, False
    for line in text.splitlines():
        if line.startswith("MODULE SUMMARY"):
            inside = True
        elif inside and line.startswith(("LINKER GENERATED", "GLOBAL SYMBOLS", "SEGMENT")):
            break
        elif inside and (m := re.match(r"\s{0,8}(\S+\.(?:lib|a))\s*$", line)):
            archive = m[1].replace("\\", "/").rsplit("/", 1)[-1]
        elif inside and (m := re.match(r"\s+(\S+\.(?:o|obj))\s+\d+", line)):
            kept.add((archive, m[1].rsplit("/", 1)[-1]))
        elif inside and re.match(r"\s+\./|\s+\+--\+-|\s+Total:", line):
            archive = None if re.match(r"\s+\./", line) else archive
    return _rows(kept)


def function_sections(text: str) -> list[dict]:
    """Per-function sections of a GNU map: ``function, object, kept``."""
    out: dict[tuple[str, str], bool] = {}
    discarded = False
    joined = re.sub(r"(?m)^( \.text\.\S+)\n\s+", r"\1 ", text)
    for line in joined.splitlines():
        if line.startswith("Discarded input sections"):
            discarded = True
        elif line.startswith(("Linker script and memory map", "Memory Configuration")):
            discarded = False
        elif m := re.match(r" \.text\.(?:hot\.|unlikely\.|startup\.)?([A-Za-z_]\w*)\S*\s+0x[0-9a-f]+\s+0x([0-9a-f]+)\s+(\S+)", line):
            key = (m[1], m[3])
            out[key] = out.get(key, False) or (not discarded and int(m[2], 16) > 0)
    return [{"function": f, "object": o, "kept": k} for (f, o), k in sorted(out.items())]


FUNCTION_SECTIONS = "function string, object string, kept boolean"


def gnu_map(text: str) -> list[dict]:
    """Objects of a GNU or LLVM link map: those kept, and those of which every section was discarded."""
    kept: set[tuple[str | None, str]] = set()
    gone: set[tuple[str | None, str]] = set()
    part = ""
    for line in text.splitlines():
        if line.startswith("Discarded input sections"):
            part = "gone"
        elif line.startswith(("Linker script and memory map", "Memory Configuration")):
            part = "map" if line[0] == "L" else ""
        elif re.match(r"\s*VMA\s+LMA\s+Size", line):
            part = "map"
        m = re.search(r"(?:^|\s)((?:[A-Za-z]:)?[^\s()]+\.(?:a|lib))\(([^()\s]+)\)|(?:^|\s)(\S+\.(?:o|obj))(?=$|[\s:(])", line)
        if not m or not part:
            continue
        size = re.search(r"0x[0-9a-f]+\s+0x([0-9a-f]+)\s", line)
        item = (m[1], m[2]) if m[1] else (None, m[3])
        if part == "gone":
            gone.add(item)
        elif not size or int(size[1], 16):
            kept.add(item)
    return _rows(kept, gone)


def kconfig(text: str) -> list[dict]:
    """``symbol, value, state``: set (true), explicitly not set (false); anything else stays unknown by absence."""
    out = []
    for line in text.splitlines():
        if m := re.match(r"(CONFIG_\w+)=(.*)$", line.strip()):
            value = m[2].strip().strip('"')
            out.append({"symbol": m[1], "value": value, "state": value != "n"})
        elif m := re.match(r"#\s*(CONFIG_\w+) is not set$", line.strip()):
            out.append({"symbol": m[1], "value": None, "state": False})
    return out


KCONFIG = "symbol string, value string, state boolean"


def gated_off(components: DataFrame, values: DataFrame) -> DataFrame:
    """Components all of whose alternatives are known and off; an unknown symbol keeps the component."""
    rows = components.select("component", F.explode("alternatives").alias("symbol")).join(values.select("symbol", "state"), "symbol", "left")
    off = rows.groupBy("component").agg(F.every(F.coalesce(~F.col("state"), F.lit(False))).alias("off"))
    return off.filter("off").select("component")


def compile_commands(text: str) -> list[dict]:
    return [{"file": e["file"], "directory": e.get("directory", ""), "output": e.get("output")} for e in json.loads(text or "[]") if e.get("file")]


COMPILE_COMMANDS = "file string, directory string, output string"


def linked_sources(sources: DataFrame, members: DataFrame) -> DataFrame:
    """``sources(path)`` with ``linked``: by object name, else stem; ambiguous or unlisted is null, kept beats discarded."""
    stem = lambda c: F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.(c|cc|cpp|cxx|s|S)?\.?(o|obj)$", "")
    objects = members.select(F.regexp_replace(stem(F.col("member")), r"\.(c|cc|cpp|cxx|s|S)$", "").alias("stem"), "archive", "kept")
    found = objects.groupBy("stem").agg(F.bool_or("kept").alias("any_kept"), F.count_distinct(F.coalesce("archive", F.lit(""))).alias("archives"))
    named = sources.withColumn("stem", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.(c|cc|cpp|cxx|s|S)$", ""))
    return named.join(found, "stem", "left").select("path", F.when((F.col("archives") == 1) | F.col("any_kept"), F.col("any_kept")).alias("linked"))


def ide_project(text: str) -> list[dict]:
    """Source files of IAR, Keil and CCS project files with whether each is excluded from the build."""
    from xml.etree import ElementTree

    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError:
        return []
    out = []
    if root.tag == "project" and root.find("fileVersion") is not None:  # IAR
        def walk(node, off):
            off = off or node.find("excluded") is not None
            for f in node.findall("file"):
                out.append({"source": f.findtext("name", "").replace("$PROJ_DIR$", ".").replace("\\", "/"), "excluded": off or f.find("excluded") is not None})
            for g in node.findall("group"):
                walk(g, off)
        walk(root, False)
    for f in root.iter("File"):  # Keil
        if p := f.findtext("FilePath"):
            flag = f.findtext(".//CommonProperty/IncludeInBuild")
            out.append({"source": p.replace("\\", "/"), "excluded": flag == "0"})
    for entry in root.iter("entry"):  # CCS
        if entry.get("kind") == "sourcePath" and entry.get("excluding"):
            out += [{"source": x, "excluded": True} for x in entry.get("excluding", "").split("|") if x]
    return out


IDE_FILES = "source string, excluded boolean"
