"""Packing by power-of-two decomposition.

A document's tokens are its ids followed by one separator.  They are cut into as
many pieces of ``longest`` tokens as fit and then by the binary digits of the
rest, largest first.  Every piece is a sequence of its own: its length is a
power of two, so nothing is padded and no sequence crosses documents; sequences
of one length share a bucket, from which batches are drawn.  There is no shuffle:
each task tokenises, cuts and numbers its own rows.

Defined cases: a null or empty text is the separator alone; repeated rows and
null ids are documents of their own; other columns are ignored.  Sequence ids are unique and the same
for the same partitions of the input; a piece and its id are made together, so a task that runs again
replaces both.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.slots import tidy

LONGEST = 1024
SEPARATOR = 0
#: Unbroken runs beyond this many bytes go to the library whose merges take n log n steps.
LONG_RUN = 1000
BATCH_IDS = 1 << 18
#: Fixed: the splitting pattern that a vocabulary file means by ``ByteLevel`` with ``use_regex``.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def plain_byte_level(spec: dict) -> bool:
    """Does a vocabulary file ask for nothing but the pattern and merges in the order of their ids."""
    split, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if spec.get("normalizer") or split.get("type") != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space"):
        return False
    if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return False
    made = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    return None not in made and all(a < b for a, b in zip(made, made[1:], strict=False)) and not any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") or x.get("normalized") for x in spec["added_tokens"])


class Encoder:
    """Ids of a BPE vocabulary file, special tokens in a text included.

    A file that is no plain byte-level BPE is left to the library that reads it; one without ids is refused.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if not spec["model"].get("vocab"):
            raise ValueError(f"{path} has no vocabulary")
        self.fast = None
        if not plain_byte_level(spec):
            return
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        # byte-level alphabets write the printable bytes as themselves and the others from U+0100 on
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
        ranks = {bytes(byte[c] for c in token): k for token, k in spec["model"]["vocab"].items() if token not in special}
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        words = text.split()
        if self.fast is None or words and max(map(len, words)) > LONG_RUN or len(text) - sum(map(len, words)) - len(words) > LONG_RUN:
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def piece_lengths(n: int, longest: int) -> list[int]:
    """``n`` as whole pieces of ``longest`` and then falling powers of two."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("offset", pa.int64())])


def _batch(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _PIECE.types, strict=True)], schema=_PIECE)


def pieces(batches, path: str, longest: int, separator: int):
    tokens = encoder(path)
    end = separator.to_bytes(4, "little")
    for batch in batches:
        out: list[tuple] = []
        held = 0
        for doc, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
            whole = tokens.ids(text.as_py()).tobytes() + end
            n, start, doc = len(whole) // 4, 0, doc.as_py()
            for m in piece_lengths(n, longest):
                out.append((doc, start, m, whole[start * 4 : (start + m) * 4], n, 0))
                start += m
            held += n
            if held > BATCH_IDS:
                yield _batch(out)
                out, held = [], 0
        if out:
            yield _batch(out)
        tidy()


def pack(docs: DataFrame, tokenizer: str, longest: int = LONGEST, separator: int = SEPARATOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece, which is a sequence: ``doc_id, start, length, ids (unsigned little-endian 32-bit), doc_tokens, sequence_id, offset``.

    ``length`` is also the bucket.  ``tokenizer`` is the path of a vocabulary file.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")

    def cut(batches):
        return pieces(batches, tokenizer, longest, separator)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long, offset long")
    return rows.select("doc_id", "start", "length", "ids", "doc_tokens", F.monotonically_increasing_id().alias("sequence_id"), "offset")


def write_buckets(packed: DataFrame, path: str) -> None:
    """The sequences as Parquet, a folder for each length."""
    packed.withColumn("bucket", F.col("length")).write.partitionBy("bucket").parquet(path)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    out = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
