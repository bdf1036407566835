"""Machine-learning files by their first bytes or their suffix, and the header of GGUF files."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed: formats as (name, offset and magic in hexadecimal or none, suffixes).
FORMATS = (
    ("GGUF", (0, "47475546"), (".gguf",)), ("TFLite", (4, "54464C33"), (".tflite",)), ("ExecuTorch", (4, "45543132"), (".pte",)), ("ONNX", None, (".onnx",)), ("safetensors", None, (".safetensors",)),
    ("PyTorch", None, (".pt", ".pth")), ("Keras/HDF5", None, (".h5", ".keras")), ("Core ML", None, (".mlmodel",)), ("RKNN", None, (".rknn",)), ("MNN", None, (".mnn",)),
)


def sniffed(files: DataFrame) -> DataFrame:
    """``path, format, by``: a magic number outranks a suffix."""
    magic = F.lit(None).cast("string")
    suffix = F.lit(None).cast("string")
    for name, sign, ends in reversed(FORMATS):
        if sign:
            at, hexa = sign
            magic = F.when(F.hex(F.substring("content", at + 1, len(hexa) // 2)) == hexa, name).otherwise(magic)
        for e in ends:
            suffix = F.when(F.lower("path").endswith(e), name).otherwise(suffix)
    return files.select("path", F.coalesce(magic, suffix).alias("format"), F.when(magic.isNotNull(), "magic").otherwise("suffix").alias("by")).filter("format is not null")


def gguf_header(data: bytes, most: int = 64) -> dict[str, str]:
    """The first text and number fields of a GGUF header."""
    if data[:4] != b"GGUF" or len(data) < 24:
        return {}
    _, _, pairs = struct.unpack_from("<IQQ", data, 4)
    at, out = 24, {}
    sizes = {0: "B", 1: "b", 2: "H", 3: "h", 4: "I", 5: "i", 6: "f", 7: "?", 10: "Q", 11: "q", 12: "d"}

    def text() -> str:
        nonlocal at
        (n,) = struct.unpack_from("<Q", data, at)
        at += 8 + n
        if at > len(data):
            raise struct.error
        return data[at - n : at].decode(errors="replace")

    try:
        for _ in range(min(pairs, most)):
            key = text()
            (kind,) = struct.unpack_from("<I", data, at)
            at += 4
            if kind == 8:
                out[key] = text()
            elif kind in sizes:
                (value,) = struct.unpack_from("<" + sizes[kind], data, at)
                at += struct.calcsize("<" + sizes[kind])
                out[key] = str(value)
            else:  # arrays end the part that is read
                break
    except struct.error:
        pass
    return out


def gguf_details(files: DataFrame) -> DataFrame:
    """``path, details`` (a map) of GGUF files among ``files(path, content)``."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([list(gguf_header(x.as_py()).items()) for x in b.column("content")], pa.map_(pa.string(), pa.string()))], ["path", "details"])

    return files.filter(F.hex(F.substring("content", 1, 4)) == "47475546").select("path", "content").mapInArrow(run, "path string, details map<string,string>")
