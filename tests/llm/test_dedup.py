import hashlib
import math
import random
from collections import Counter
from unittest import mock

import numpy as np
import pyarrow as pa

import tessera.llm.ngram_join as ngram_module
from tessera.llm import slots
from tessera.llm.cover_dedup import COVER, PERIOD, cover_dedup, covers, numbered_windows
from tessera.llm.ngram_join import ngram_dedup, ngram_join, overlaps
from tessera.llm.suffix_dedup import suffix_dedup

WORDS = [f"w{k}" for k in range(400)]


def corpus(seed, n=60):
    """Texts with copies, near copies, shared passages, repetition and odd cases."""
    rng = random.Random(seed)
    passage = " ".join(rng.choice(WORDS) for _ in range(60))
    out = [(0, None), (1, ""), (2, " \n\t "), (3, "one two"), (4, "One  TWO"), (5, "a" * 300), (6, "ab" * 150), (7, "é" * 60), (8, "x" + "é" * 60)]
    for k in range(9, n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(1, 120))]
        kind = k % 6
        if kind == 1:
            words = words[:20] + passage.split() + words[20:]
        elif kind == 2 and out[k - 1][1]:
            words = out[k - 1][1].split()
            words[len(words) // 2] = "changed"
        elif kind == 3 and out[k - 2][1]:
            words = out[k - 2][1].split()
        elif kind == 4:
            words = words[:40] * 3
        out.append((k, (" " if k % 5 else "\n").join(words)))
    return out


def brute_suffix(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        windows = [b[p : p + length] for p in range(len(b) - length + 1)]
        cover = [False] * len(b)
        for p, w in enumerate(windows):
            if w in seen:
                cover[p : p + length] = [True] * length
        seen.update(windows)
        spans = sum(c and (not k or not cover[k - 1]) for k, c in enumerate(cover))
        out[i] = (len(b), sum(cover), spans, hashlib.sha256(bytes(x for x, c in zip(b, cover, strict=True) if not c)).hexdigest())
    return out


def test_suffix_dedup_is_exact(docs):
    for length in (50, 12):
        rows = corpus(length)
        got = {r.doc_id: (r.n_bytes, sum(s.length for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup(docs(rows), length).collect()}
        assert got == brute_suffix(rows, length)


def test_suffix_dedup_odd_rows(docs, spark):
    long = "passage " * 20
    rows = docs([(2, long, 7, 8), (1, long, 9, 1), (1, long, 9, 1), (None, long, 0, 0), (3, "short", 1, 2)], ", slot int, body int")
    got = sorted((r.doc_id if r.doc_id is not None else 99, len(r.kept), r.carry.slot) for r in suffix_dedup(rows, carry=["slot", "body"]).collect())
    assert got == [(1, 160, 9), (1, 160, 9), (2, 0, 7), (3, 5, 1), (99, 0, 0)]
    assert suffix_dedup(docs([]).limit(0)).count() == 0


def brute_cover(rows, length):
    words = [(t or "").encode().split() for _, t in rows]
    count = Counter(tuple(w[p : p + length]) for w in words for p in range(len(w) - length + 1))
    out = {}
    for (i, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for p in range(len(w) - length + 1):
            if count[tuple(w[p : p + length])] > 1:
                gone[p : p + length] = [True] * length
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    return out


def test_cover_dedup_is_exact(docs):
    assert covers(COVER, PERIOD) and not covers((0, 1), 5)
    rows = corpus(3)
    for how in ({}, {"length": 9, "period": 7, "cover": (0, 1, 3)}):
        got = {r.doc_id: (r.n_words, sum(s.length for s in r.spans), r.kept) for r in cover_dedup(docs(rows), **how).collect()}
        assert got == brute_cover(rows, how.get("length", 35))


def test_cover_dedup_repeated_rows_and_clashing_names(docs):
    text = " ".join(WORDS[:40])
    rows = docs([(1, text, 5), (1, text, 6), (None, "a b", 7)], ", slot int")
    got = sorted((r.kept, r.carry.slot) for r in cover_dedup(rows, carry=["slot"]).collect())
    assert got == [("", 5), ("", 6), ("a b", 7)]
    assert cover_dedup(docs([]).limit(0)).count() == 0


def brute_groups(rows, percent=80, n=5):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    moved = True
    while moved:
        moved = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and label[a] != label[b]:
                    low = min(label[a], label[b])
                    label[a] = label[b] = low
                    moved = True
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_ngram_join_is_exact(docs):
    rows = corpus(5, 90)
    rng = random.Random(9)
    base = [rng.choice(WORDS) for _ in range(80)]
    for k in range(40):  # a family of near copies, chained
        base = base.copy()
        base[rng.randrange(80)] = f"n{k}"
        rows.append((200 + k, " ".join(base)))
    want = brute_groups(rows)
    for block in (256, 4, 2):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(docs(rows), block=block).collect()}
        assert got == want


def test_ngram_join_odd_rows(docs):
    rows = docs([(3, "a b c d e f"), (1, "A  B c d e f"), (None, "a b c d e f"), (7, None), (8, "")])
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in ngram_join(rows).collect() if r.doc_id)
    assert got == [(1, 2, 1), (3, 2, 1), (7, 0, 7), (8, 0, 8)]
    assert ngram_join(docs([]).limit(0)).count() == 0


def test_ngram_dedup_keeps_one_of_each_group(docs):
    rows = corpus(7, 90)
    want = {i for i, (_, c) in brute_groups(rows).items() if c == i}
    got = [(r.doc_id, r.text, r.carry.slot) for r in ngram_dedup(docs([(i, t, i) for i, t in rows], ", slot long"), carry=["slot"]).collect()]
    assert {i for i, _, _ in got} == want and len(got) == len(want)
    texts = dict(rows)
    assert all(t == (texts[i] or "") and s == i for i, t, s in got)
    again = ngram_dedup(docs([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "")])).collect()
    assert sorted((r.doc_id or 0, r.text) for r in again) == [(0, "a b c d e f"), (1, "a b c d e f"), (2, "")]


def test_two_hops_give_the_same(docs, monkeypatch):
    rows = corpus(11)
    table = docs(rows)
    want = brute_suffix(rows, 50), brute_cover(rows, 35), brute_groups(rows)
    monkeypatch.setattr(slots, "DIRECT", 8)
    for slot_bytes in (4 << 20, 200):
        monkeypatch.setattr(slots, "SLOT_BYTES", slot_bytes)
        got = {r.doc_id: (r.n_bytes, sum(s.length for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup(table).collect()}
        assert got == want[0]
        assert {r.doc_id: (r.n_words, sum(s.length for s in r.spans), r.kept) for r in cover_dedup(table).collect()} == want[1]
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(table).collect()} == want[2]


def test_rows_between_slots_grow_linearly():
    """First-hop rows of one slot are one for each district; parcels of many senders are joined."""
    rng = np.random.default_rng(1)
    for n in (64, 500, 4000):
        sent = []
        for slot in range(20):
            values = np.sort(rng.integers(0, 1 << 63, 30_000, dtype=np.uint64) * np.uint64(2))
            sent.append(slots.posted(slots.send_values(slot, values, n), "bucket", "slot", n))
        assert all(t.num_rows <= math.isqrt(n - 1) + 1 for t in sent)
        second = [b for t in [pa.concat_tables(sent)] for b in slots.regroup(t.to_batches(), "bucket", "slot")]
        assert sum(b.num_rows for b in second) <= n
        every = slots.unpacked(pa.Table.from_batches(second), "bucket", "slot")
        assert sum(map(len, every.column("body").to_pylist())) == 20 * 30_000 * 4


def test_null_and_repeated_ids_are_spread(docs):
    table, n = slots.slotted(docs([(None, f"text {k}") for k in range(1000)] + [(7, f"other {k}") for k in range(1000)]), "doc_id", "text")
    count = [r["count"] for r in table.groupBy("slot").count().collect()]
    assert n == 64 and len(count) == 64 and max(count) < 80


def test_windows_are_numbered_exactly():
    rng = np.random.default_rng(2)
    ids = np.concatenate([rng.integers(0, 3, 400), np.tile(rng.integers(0, 3, 50), 4)])
    for length in (1, 2, 5, 35):
        number = numbered_windows(ids, length)
        kinds = {}
        want = [kinds.setdefault(tuple(ids[p : p + length]), len(kinds)) for p in range(len(ids) - length + 1)]
        assert len(set(number)) == len(kinds) and len({(a, b) for a, b in zip(number.tolist(), want, strict=True)}) == len(kinds)


def test_sparse_product_is_exact():
    rng = np.random.default_rng(3)
    base = rng.choice(5000, 120, replace=False)
    sets = [np.unique(np.concatenate([base[rng.random(120) < 0.95], rng.integers(5000, 9000, rng.integers(1, 30))])).astype(np.uint64) for _ in range(80)]
    brute = np.array([[100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)) for b in sets] for a in sets])
    for pairs in (50, 2_000_000):
        with mock.patch.object(ngram_module, "PAIRS", pairs):
            assert (overlaps(sets, None, 80) == brute).all()
            assert (overlaps(sets[:30], sets[30:], 80) == brute[:30, 30:]).all()


def test_one_template_in_all_documents(docs):
    """A passage that all share builds no link, and the near copies beside it are found."""
    rng = random.Random(4)
    template = " ".join(f"t{k}" for k in range(60))
    rows = [(k, template + " " + " ".join(f"u{rng.randrange(10**9)}" for _ in range(30))) for k in range(150)]
    rows += [(1000 + k, f"{rows[k][1]} end") for k in range(0, 150, 10)]
    got = {r.doc_id: r.component_id for r in ngram_join(docs(rows), block=16).collect()}
    assert got == {i: i % 1000 if i >= 1000 else i for i, _ in rows}
