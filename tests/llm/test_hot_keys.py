"""One passage in many documents, each time inside another text: no key may gather them all."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.llm import cover_dedup, slots, suffix_dedup
from tests.llm.test_dedup import brute_cover, brute_suffix

SENTENCE = "permission is hereby granted free of charge to any person who obtains a copy of this software today"


def planted(n, words):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    middle = SENTENCE if words < 30 else SENTENCE + " " + " ".join(f"w{k}" for k in range(25))
    return [(k, " ".join([*(word() for _ in range(words)), middle, *(word() for _ in range(words))])) for k in range(n)]


def test_surroundings_do_not_meet(docs):
    rows = planted(400, 12)
    got = {r.doc_id: (r.n_bytes, sum(s.length for s in r.spans)) for r in suffix_dedup.suffix_dedup(docs(rows)).collect()}
    assert got == {k: v[:2] for k, v in brute_suffix(rows, 50).items()}


def phases(rows, n=64):
    """What each bucket gets for its keys in suffix_dedup, phase by phase, in this process."""
    tables = {}
    for i, t in rows:
        tables.setdefault(i % 8, []).append((i, t))
    tables = {k: pa.table({"slot": pa.array([k] * len(v), pa.int32()), "doc_id": pa.array([x[0] for x in v], pa.int64()), "text": pa.array([x[1] for x in v])}) for k, v in tables.items()}
    copies = slots.Copies(bytes, n)

    def exchange(send, answer, *before):
        sent = pa.concat_tables([send(t, *[slots_of(b, k) for b in before]) if before else send(t) for k, t in tables.items()])
        answers = [answer(sent.filter(pc.equal(sent.column("bucket"), b))) for b in set(sent.column("bucket").to_pylist())]
        return sent, (pa.concat_tables(answers) if answers else slots.back(0, []))

    def slots_of(answers, k):
        return answers.filter(pc.equal(answers.column("slot"), k))

    def kinds(*answers):
        return pa.concat_tables([a.append_column("kind", pa.array([k] * a.num_rows, pa.int32())) for k, a in enumerate(answers)])

    how = {"copies": copies, "length": 50, "n": n}
    _, known = exchange(copies.send, copies.answer)
    _, keys = exchange(lambda t, a: suffix_dedup.send_keys(t, a, **how), slots.shared_counted, known)
    _, heavy = exchange(lambda t, a: suffix_dedup.send_heavy(t, a, **how), slots.shared_values, kinds(known, keys))
    sent, _ = exchange(lambda t, a: suffix_dedup.send_runs(t, a, **how), lambda t: suffix_dedup.decide_runs(t, 50), kinds(known, keys, heavy))
    seen = {}
    for bucket, body in zip(sent.column("bucket").to_pylist(), sent.column("body").to_pylist(), strict=True):
        m = int.from_bytes(body[:4], "little")
        head, at = np.frombuffer(body, suffix_dedup._ENTRY, m, 4), 4 + m * suffix_dedup._ENTRY.itemsize
        for low, size in zip(head["low"].tolist(), head["n"].tolist(), strict=True):
            seen.setdefault((bucket, low), set()).add(body[at : at + size + 49])
            at += size + 49
    return max(map(len, seen.values()))


def test_no_key_gathers_all_surroundings():
    few, many = phases(planted(500, 12)), phases(planted(2000, 12))
    assert few <= slots.HEAVY and many <= slots.HEAVY


def test_cover_with_heavy_keys_is_exact(docs):
    rows = planted(300, 40) + [(1000 + k, t) for k, (_, t) in enumerate(planted(20, 40))]
    got = {r.doc_id: (r.n_words, sum(s.length for s in r.spans), r.kept) for r in cover_dedup.cover_dedup(docs(rows)).collect()}
    want = brute_cover(rows, 35)
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
