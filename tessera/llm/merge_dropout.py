"""SentencePiece encoding with seeded merge-dropout, and decoding.

A segment (white-space marks with the characters after them) is merged by agenda:
of all neighbouring symbols whose union is a piece, the pair with the best score and
then the leftmost is taken; a keyed hash of (seed, variant, document id, place of the segment in the text,
segment, where the pair begins, meets and ends) decides whether this candidate is skipped, for good.
Without dropout the ids are those of the library.  So each occurrence of a word is segmented by
itself, copies of a text differently, and another seed segments the whole corpus anew.
(``variant`` is one of ``variants``, by a keyed hash of the id.)

Which of a segment's possible candidates are skipped is all that tells two of its occurrences apart.  Those
that skip the same have equal ids, so each distinct segment with its set of skips is
merged once in a chunk, all of them side by side: a round merges one pair in every segment that still
has one.  Long segments take a heap of their own, each occurrence alone.  What a segment skips is asked beforehand
only where it occurs again in the chunk: no other merge could be shared.

Characters without a piece become their bytes.  So does a literal U+2581, which would otherwise
decode to a space: decoding gives back every text.

Defined cases: a null or empty text has no ids and decodes to the empty text; repeated rows and
null ids are encoded each by itself; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.slots import tidy
from tessera.llm.textbits import U64, flat, mix, powers

DROPOUT = 0.1
VARIANTS = 4
SEED = 1
CHUNK = 2_000_000
#: Segments of more symbols are merged by a heap.
LONG = 48
SPACE = "▁"
_NONE = np.int32(-1)
NEVER = np.int32(0x7FFFFFFF)


class Pieces:
    """The vocabulary of a model file as arrays: characters, pairs, scores and bytes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        plain = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(size)]
        self.byte = np.zeros(256, np.int32)
        raw: list[bytes] = []
        for i, name in enumerate(names):
            if model.is_byte(i):
                self.byte[int(name[3:5], 16)] = i
                raw.append(bytes([int(name[3:5], 16)]))
            else:
                raw.append(name.replace(SPACE, " ").encode() if plain[i] else b"")
        self.raw = raw
        self.raw_size = np.array([len(x) for x in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        self.raw_bytes = np.frombuffer(b"".join(raw), np.uint8)
        index = {n: i for i, n in enumerate(names) if plain[i]}
        if any(SPACE in n.lstrip(SPACE) for n in index):
            raise ValueError("a piece has a space inside: segments would not be independent")
        self.char = np.full(0x110000, _NONE, np.int32)
        for n, i in index.items():
            if len(n) == 1:
                self.char[ord(n)] = i
        # which hashes pieces can have, by their first 22 bits, and how many characters pieces have
        known = [n for n in index if len(n) <= LONG]
        joined = np.frombuffer("".join(known).encode("utf-32-le"), np.uint32)
        stop = np.cumsum([len(n) for n in known])
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[code_hash(joined, np.append(0, stop[:-1]), stop) >> U64(42)] = True
        self.sizes = sorted({len(n) for n in known})
        # every pair of pieces whose union is a piece
        pairs = [(index[n[:k]], index[n[k:]], i) for n, i in index.items() for k in range(1, len(n)) if n[:k] in index and n[k:] in index]
        order = np.argsort([-model.get_score(i) for i in range(size)], kind="stable")
        self.rank = np.full(size + 1, NEVER, np.int32)  # equal scores have equal ranks; the last is that of no piece
        score = np.array([model.get_score(i) for i in range(size)])
        self.rank[order] = np.cumsum(np.append(0, score[order][1:] != score[order][:-1]))
        # an open-addressed table from pair to piece
        self.bits = 20
        self.keys = np.full(1 << self.bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.unions = np.full(1 << self.bits, _NONE, np.int32)
        self.pairs = {(a, b): c for a, b, c in pairs}
        key = np.array([(a << 32) | b for a, b, _ in pairs], np.uint64)
        union = np.array([c for *_, c in pairs], np.int32)
        at = (mix(key) >> U64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(key))
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.keys[at[left]] == np.uint64(0xFFFFFFFFFFFFFFFF)
            _, first = np.unique(at[left], return_index=True)
            put = np.zeros(len(left), bool)
            put[first] = True
            put &= free
            now = left[put]
            self.keys[at[now]], self.unions[at[now]] = key[now], union[now]
            left = left[~put]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def union(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, -1 for none."""
        key = (a.astype(np.uint64) << U64(32)) | b.astype(np.uint64)
        at = (mix(key) >> U64(64 - self.bits)).astype(np.int64)
        out = np.full(len(key), _NONE, np.int32)
        todo = np.arange(len(key))
        for _ in range(self.probes):
            got = self.keys[at[todo]]
            hit = got == key[todo]
            out[todo[hit]] = self.unions[at[todo[hit]]]
            todo = todo[~hit & (got != np.uint64(0xFFFFFFFFFFFFFFFF))]
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        return out


_PIECES: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def secret(seed: int, variant: int) -> int:
    return int.from_bytes(hashlib.blake2b(b"%d|%d" % (seed, variant), digest_size=8).digest(), "little")


def skipped(salt: np.ndarray, begin: np.ndarray, meet: np.ndarray, end: np.ndarray, bar: int) -> np.ndarray:
    """Whether each candidate is skipped; ``salt`` is the keyed hash of its segment."""
    return drawn(salt, places(begin, meet, end), bar)


def places(begin: np.ndarray, meet: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of where a candidate lies in its segment."""
    return mix(begin.astype(np.uint64) * U64(0x9E3779B97F4A7C15) + meet.astype(np.uint64) * U64(0xC2B2AE3D27D4EB4F) + end.astype(np.uint64) * U64(0x165667B19E3779F9))


def drawn(salt: np.ndarray, place: np.ndarray, bar: int) -> np.ndarray:
    """``skipped`` for candidates whose places are hashed already."""
    return (mix(salt ^ place) >> U64(11)) < U64(bar)


def merge(vocabulary: Pieces, ids: np.ndarray, first: np.ndarray, salt: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """Merge the segments ``ids[first[k]:first[k + 1]]``; ids of all and the count of each."""
    bar = round(dropout * (1 << 53))
    n = len(first) - 1
    count = np.diff(first)
    done_ids: list[np.ndarray] = []
    done_owner: list[np.ndarray] = []
    large = np.flatnonzero(count > LONG)
    for k in large.tolist():
        out = agenda(vocabulary, ids[first[k] : first[k + 1]], salt[k], bar)
        done_ids.append(out)
        done_owner.append(np.full(len(out), k, np.int32))
    owner = np.repeat(np.arange(n, dtype=np.int32), count)
    begin = (np.arange(len(ids)) - first[:-1][owner]).astype(np.int32)
    if len(large):
        small = (count <= LONG)[owner]
        ids, owner, begin = ids[small], owner[small], begin[small]
    ids, stop = ids.copy(), begin + 1
    union = rank = None
    while len(ids):
        if union is None:
            union = np.full(len(ids), _NONE, np.int32)
            pair = np.flatnonzero((owner[:-1] == owner[1:]) & (ids[:-1] >= 0) & (ids[1:] >= 0))
            union[pair] = candidates(vocabulary, ids, owner, begin, stop, pair, salt, bar)
            rank = vocabulary.rank[union]
        # the best pair of each segment, the leftmost of equals
        edge = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        best = np.minimum.reduceat(rank, edge)
        size = np.diff(np.append(edge, len(ids)))
        live = best < NEVER
        if not live.all():
            still = np.repeat(live, size)
            done_ids.append(ids[~still])
            done_owner.append(owner[~still])
            ids, owner, begin, stop, union, rank = (x[still] for x in (ids, owner, begin, stop, union, rank))
            best, size = best[live], size[live]
            if not len(ids):
                break
        at = np.flatnonzero(rank == np.repeat(best, size))
        at = at[np.append(True, owner[at][1:] != owner[at][:-1])]
        ids[at] = union[at]
        stop[at] = stop[at + 1]
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        ids, owner, begin, stop, union, rank = (x[keep] for x in (ids, owner, begin, stop, union, rank))
        at -= np.arange(len(at))
        # only the pairs that the new symbols are in have changed
        changed = np.zeros(len(ids), bool)
        changed[at] = True
        changed[at[at > 0] - 1] = True
        changed[-1] = False
        pair = np.flatnonzero(changed)
        pair = pair[owner[pair] == owner[pair + 1]]
        union[at] = _NONE
        ok = (ids[pair] >= 0) & (ids[pair + 1] >= 0)
        union[pair] = _NONE
        union[pair[ok]] = candidates(vocabulary, ids, owner, begin, stop, pair[ok], salt, bar)
        rank[at] = NEVER
        rank[pair] = vocabulary.rank[union[pair]]
    if not done_ids:
        return np.zeros(0, np.int32), np.zeros(n, np.int64)
    ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
    order = np.argsort(owner, kind="stable")
    return ids[order], np.bincount(owner, minlength=n)


def candidates(vocabulary: Pieces, ids, owner, begin, stop, pair, salt, bar: int) -> np.ndarray:
    """What the pairs make, but for those that are skipped."""
    made = vocabulary.union(ids[pair], ids[pair + 1])
    if bar:
        some = np.flatnonzero(made >= 0)
        p = pair[some]
        made[some[skipped(salt[owner[p]], begin[p], begin[p + 1], stop[p + 1], bar)]] = _NONE
    return made


def agenda(vocabulary: Pieces, ids: np.ndarray, salt: np.uint64, bar: int) -> np.ndarray:
    """The same for one segment, by a heap: n log n steps."""
    n = len(ids)
    piece = ids.tolist()
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    stop = list(range(1, n + 1))
    heap: list[tuple[int, int, int, int, int]] = []

    def push(found: list[int]) -> None:
        found = [i for i in found if i >= 0 and right[i] < n and piece[i] >= 0 and piece[right[i]] >= 0]
        made = [(i, vocabulary.pairs.get((piece[i], piece[right[i]]))) for i in found]
        made = [x for x in made if x[1] is not None]
        if not made:
            return
        i = np.array([x[0] for x in made])
        meet = np.array([right[x[0]] for x in made])
        end = np.array([stop[right[x[0]]] for x in made])
        drop = skipped(np.full(len(made), salt, np.uint64), i, meet, end, bar) if bar else np.zeros(len(made), bool)
        for (k, c), m, e, d in zip(made, meet.tolist(), end.tolist(), drop.tolist(), strict=True):
            if not d:
                heapq.heappush(heap, (int(vocabulary.rank[c]), k, m, e, c))

    push(list(range(n)))
    gone = [False] * n
    while heap:
        _, i, meet, end, c = heapq.heappop(heap)
        if gone[i] or right[i] != meet or stop[meet] != end:
            continue
        piece[i] = c
        gone[meet] = True
        right[i] = right[meet]
        stop[i] = end
        if right[i] < n:
            left[right[i]] = i
        push([left[i], i])
    return np.array([piece[i] for i in range(n) if not gone[i]], np.int32)


def span_hashes(code: np.ndarray):
    """A function of starts and stops: the 64-bit hash of each span of code points."""
    forward, back = powers(U64(0x9E3779B97F4A7C15), len(code) + 1)
    prefix = np.zeros(len(code) + 1, np.uint64)
    np.cumsum((code.astype(np.uint64) + U64(1)) * U64(0xD6E8FEB86659FD93) * forward[: len(code)], out=prefix[1:])
    return lambda start, stop: mix((prefix[stop] - prefix[start]) * back[start])


def code_hash(code: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of code points."""
    return span_hashes(code)(start, stop)


def possible(vocabulary: Pieces, code: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``segment, begin, meet, end`` of all two neighbouring spans of a segment that are pieces and make one, ordered by segment; and of a few others."""
    length = stop - start
    first = np.append(0, np.cumsum(length))
    segment = np.repeat(np.arange(len(start)), length)
    at = start[segment] + np.arange(first[-1]) - first[segment]
    left = stop[segment] - at
    symbol = code[at]
    hashes = span_hashes(np.where(symbol == 0x20, np.uint32(ord(SPACE)), symbol))
    piece: dict[int, np.ndarray] = {}
    fits = np.arange(len(at))
    for size in vocabulary.sizes:
        fits = fits[left[fits] >= size]
        if not len(fits):
            break
        piece[size] = np.zeros(len(at) + size, bool)
        piece[size][fits] = vocabulary.maybe[hashes(fits, fits + size) >> U64(42)]
    out = []
    for size in piece:
        whole = np.flatnonzero(piece[size])
        for k in piece:
            if size - k in piece:
                p = whole[piece[k][whole] & piece[size - k][whole + k]]
                b = at[p] - start[segment[p]]
                out.append((segment[p], b, b + k, b + size))
    columns = [np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out, strict=True) if out else [()] * 4)]
    order = np.argsort(columns[0], kind="stable")
    return tuple(x[order] for x in columns)


def skip_sets(vocabulary: Pieces, code: np.ndarray, start: np.ndarray, stop: np.ndarray, kind: np.ndarray, one: np.ndarray, salt: np.ndarray, bar: int) -> np.ndarray:
    """A 64-bit hash of the possible candidates that each segment skips; ``kind`` is its number among the distinct ones, which ``one`` has a place of."""
    segment, begin, meet, end = possible(vocabulary, code, start[one], stop[one])
    first = np.append(0, np.cumsum(np.bincount(segment, minlength=len(one))))
    place = places(begin, meet, end)
    mark = mix(begin.astype(np.uint64) * U64(0xD6E8FEB86659FD93) ^ mix(meet.astype(np.uint64) << U64(32) | end.astype(np.uint64)))
    count = np.diff(first)[kind]
    total = np.append(0, np.cumsum(count))
    out = np.zeros(len(kind), np.uint64)
    lo = 0
    while lo < len(kind):  # about a million candidates at a time
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + 1_000_000, side="right")) - 1)
        n = count[lo:hi]
        owner = np.repeat(np.arange(lo, hi), n)
        at = np.repeat(first[kind[lo:hi]] - (total[lo:hi] - total[lo]), n) + np.arange(len(owner))
        hit = np.flatnonzero(drawn(np.repeat(salt[lo:hi], n), place[at], bar))
        np.add.at(out, owner[hit], mark[at[hit]])
        lo = hi
    return out


def encode(vocabulary: Pieces, texts: list[str], variant: np.ndarray, seed: int, dropout: float, variants: int, doc_id: np.ndarray | None = None) -> list[np.ndarray]:
    """Ids of each text; ``doc_id`` keys the skips of each, zero where it is left out."""
    full = [f" {t}" if t else "" for t in texts]
    joined = "".join(full)
    if not joined:
        return [np.zeros(0, np.int32) for _ in texts]
    code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    size = np.array([len(t) for t in full], np.int64)
    offset = np.append(0, np.cumsum(size))
    space = code == 0x20
    # a segment begins at the first of a run of spaces, or with a text
    begin = space.copy()
    begin[1:] &= ~space[:-1]
    begin[offset[:-1][size > 0]] = True
    start = np.flatnonzero(begin)
    stop = np.append(start[1:], len(code))
    row = np.searchsorted(offset, start, side="right") - 1
    secrets = np.array([secret(seed, v) for v in range(variants)], np.uint64)
    word = code_hash(code, start, stop)
    if bar := round(dropout * (1 << 53)):
        ids = np.zeros(len(texts), np.uint64) if doc_id is None else doc_id.astype(np.int64).view(np.uint64)
        where = mix(mix(ids + secrets[variant])[row] + (start - offset[row]).astype(np.uint64))
        salt = mix(word + where)
        _, one, kind, often = np.unique(word, return_index=True, return_inverse=True, return_counts=True)
        # nobody shares the merge of a long segment or of one that occurs once
        shared = (stop - start <= LONG) & (often > 1)[kind]
        short = one[shared[one]]
        number = np.full(len(one), -1)
        number[shared[one]] = np.arange(len(short))
        key = salt.copy()
        key[shared] = mix(word[shared] + skip_sets(vocabulary, code, start[shared], stop[shared], number[kind[shared]], (np.cumsum(shared) - 1)[short], salt[shared], bar))
    else:
        salt = key = word
    _, at, inverse = np.unique(key, return_index=True, return_inverse=True)
    salts = salt[at]
    # symbols of the distinct segments
    length = stop[at] - start[at]
    first = np.append(0, np.cumsum(length))
    where = np.repeat(start[at] - first[:-1], length) + np.arange(first[-1])
    symbol = code[where].astype(np.int64)
    ids = vocabulary.char[np.where(symbol == 0x20, ord(SPACE), symbol)]
    ids[symbol == ord(SPACE)] = _NONE
    merged, count = merge(vocabulary, np.where(ids >= 0, ids, -2 - symbol).astype(np.int32), first, salts, dropout)
    if (merged < 0).any():  # characters without a piece, as bytes
        lone = np.flatnonzero(merged < 0)
        lists = [vocabulary.byte[list(chr(-2 - int(x)).encode())] for x in merged[lone]]
        more = np.ones(len(merged), np.int64)
        more[lone] = [len(x) for x in lists]
        owner = np.repeat(np.arange(len(count)), count)
        end = np.cumsum(more)
        out = np.repeat(merged, more)
        for k, x in zip(lone.tolist(), lists, strict=True):
            out[end[k] - len(x) : end[k]] = x
        merged, count = out, np.bincount(owner, more, len(count)).astype(np.int64)
    base = np.cumsum(count) - count
    take = count[inverse]
    total = np.append(0, np.cumsum(take))
    every = merged[np.repeat(base[inverse] - total[:-1], take) + np.arange(total[-1])]
    cut = total[np.searchsorted(start, offset)]
    return [every[a:z] for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def decode(vocabulary: Pieces, ids: np.ndarray) -> str:
    """The text of ``ids``: bytes of pieces, without the space that opens every text."""
    size = vocabulary.raw_size[ids]
    total = np.append(0, np.cumsum(size))
    return vocabulary.raw_bytes[np.repeat(vocabulary.raw_at[ids] - total[:-1], size) + np.arange(total[-1])].tobytes().decode()[1:]


def encoded(docs: DataFrame, model: str, seed: int = SEED, dropout: float = DROPOUT, variants: int = VARIANTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, variant, ids (array<int>)``; ``model`` is the path of a vocabulary file."""
    if not 0 <= dropout < 1 or variants < 1:
        raise ValueError("dropout must be in [0, 1) and variants at least 1")
    doc_id = F.col(f"`{id_col}`").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(variants)).cast("int").alias("variant"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))

    def run(batches):
        vocabulary = pieces(model)
        for b in batches:
            _, offsets = flat(b.column("text"))
            i = 0
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1)
                part = b.slice(i, j - i)
                ids = encode(vocabulary, part.column("text").to_pylist(), part.column("variant").to_numpy(), seed, dropout, variants, part.column("doc_id").fill_null(-1).to_numpy())
                size = np.array([len(x) for x in ids], np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("variant"), lists], ["doc_id", "variant", "ids"])
                i = j
            tidy()

    return rows.mapInArrow(run, "doc_id long, variant int, ids array<int>")


def decoded(rows: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` from ``ids``."""

    def run(batches):
        vocabulary = pieces(model)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                texts = [decode(vocabulary, np.array(x.values.to_numpy(zero_copy_only=False), np.int64)) if x.is_valid and len(x) else "" for x in part.column("ids")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])
            tidy()

    return rows.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str, seed: int = SEED, dropout: float = DROPOUT, variants: int = VARIANTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, variant, ids, text``: encoded and, from the ids alone, decoded."""
    rows = encoded(docs, model, seed, dropout, variants, id_col, text_col)

    def run(batches):
        vocabulary = pieces(model)
        for b in batches:
            texts = [decode(vocabulary, np.array(x.values.to_numpy(zero_copy_only=False), np.int64)) if len(x) else "" for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "variant", "ids")), pa.array(texts, pa.string())], ["doc_id", "variant", "ids", "text"])

    return rows.mapInArrow(run, "doc_id long, variant int, ids array<int>, text string")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_merge_dropout(spark, sf_dir: str) -> DataFrame:
    out = round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_path())
    return out.select("doc_id", "variant", F.size("ids").cast("long").alias("n_pieces"), F.hash("ids").alias("ids_hash"), F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))
