"""Operators that look at one document at a time, and chats."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, merge_dropout, packing, pii, quality
from tessera.llm import outliers as mcd
from tessera.llm.outliers import outliers
from tessera.llm.stats import COUNTS, column_counts

pa = pytest.importorskip("pyarrow")
pytest.importorskip("public_tokenizers")
WHITE = r"[^\x20\x09-\x0D]+"
ODD = ["", None, " ", "\n\n", "a", "<|endoftext|> b", "a<|endoftext|>", "é \u0085ß", "日本語 text　", "🙂 ​", "don't 's 'LL", "x" * 3000, " " * 3000 + "y", "▁ ▁▁ literal", "tab\there\r\n", "\x1c\x0b\x0c"]


def texts(n=40):
    rng = random.Random(4)
    parts = ["word", "é", " ", "  ", "\n", "12", "!", "日", "’", "Ab", "..", "\t", "in", "er"]
    return ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 400))) for _ in range(n)]


def test_packing(docs):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    rows = list(enumerate(texts()))
    got = packing.pack(docs(rows), path).collect()
    exact = Tokenizer.from_file(path)
    ids = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        whole = ids.setdefault(r.doc_id, [])
        assert r.start == len(whole) and r.length == len(r.ids) // 4 <= 1024 and r.length & (r.length - 1) == 0 and r.offset == 0
        whole += np.frombuffer(r.ids, "<u4").tolist()
        assert len(whole) <= r.doc_tokens
    assert ids == {i: exact.encode(t or "", add_special_tokens=False).ids + [0] for i, t in rows}
    assert len({r.sequence_id for r in got}) == len(got)
    assert packing.piece_lengths(2 * 1024 + 13, 1024) == [1024, 1024, 8, 4, 1]
    assert packing.pack(docs([]).limit(0), path).count() == 0


def test_merge_dropout(docs):
    import sentencepiece

    path = merge_dropout.model_path()
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = list(enumerate(texts()))
    plain = {r.doc_id: r.ids for r in merge_dropout.encoded(docs(rows), path, dropout=0.0).collect()}
    assert plain == {i: (model.encode(t or "") if "▁" not in (t or "") else plain[i]) for i, t in rows}
    first = {r.doc_id: (r.ids, r.text) for r in merge_dropout.round_trip(docs(rows), path, seed=1, dropout=0.4).collect()}
    assert all(first[i][1] == (t or "") for i, t in rows)
    assert first == {r.doc_id: (r.ids, r.text) for r in merge_dropout.round_trip(docs(rows).repartition(3), path, seed=1, dropout=0.4).collect()}
    other = {r.doc_id: r.ids for r in merge_dropout.encoded(docs(rows), path, seed=2, dropout=0.4).collect()}
    assert sum(other[i] != first[i][0] for i in first) > 30
    again = merge_dropout.decoded(merge_dropout.encoded(docs(rows), path), path).collect()
    assert {r.doc_id: r.text for r in again} == {i: t or "" for i, t in rows}


def test_heap_and_rounds_agree(monkeypatch):
    p = merge_dropout.pieces(merge_dropout.model_path())
    some = [t or "" for t in texts()]
    rounds = merge_dropout.encode(p, some, np.zeros(len(some), int), 5, 0.3, 1)
    monkeypatch.setattr(merge_dropout, "LONG", 2)
    heap = merge_dropout.encode(p, some, np.zeros(len(some), int), 5, 0.3, 1)
    assert all((a == b).all() for a, b in zip(rounds, heap, strict=True))


def test_each_occurrence_draws_its_own_skips():
    p = merge_dropout.pieces(merge_dropout.model_path())
    text = " ".join(["understanding"] * 1000)
    a, b = merge_dropout.encode(p, [text, text], np.zeros(2, int), 1, 0.1, 1, np.array([1, 2]))
    assert a.tolist() != b.tolist()
    cuts = Counter(tuple(x.split("|")) for x in "|".join(p.raw[i].decode() for i in a).replace("| ", "\n").split("\n"))
    assert len(cuts) > 4


def test_equal_skips_merge_as_each_alone(monkeypatch):
    p = merge_dropout.pieces(merge_dropout.model_path())
    some = [t or "" for t in texts()] + [" ".join(["understanding the whole"] * 200)]
    ids = np.arange(len(some)) - 3
    shared = merge_dropout.encode(p, some, np.zeros(len(some), int), 5, 0.3, 1, ids)
    monkeypatch.setattr(merge_dropout, "skip_sets", lambda v, c, a, z, k, o, salt, bar: salt)
    alone = merge_dropout.encode(p, some, np.zeros(len(some), int), 5, 0.3, 1, ids)
    assert all((a == b).all() for a, b in zip(shared, alone, strict=True))


def test_skips_are_asked_only_where_merges_can_be_shared(monkeypatch):
    p = merge_dropout.pieces(merge_dropout.model_path())
    once = " ".join(f"word{k}ing" for k in range(300)) + " " + "x" * 60
    asked = []
    skip_sets = merge_dropout.skip_sets
    monkeypatch.setattr(merge_dropout, "skip_sets", lambda v, c, a, z, k, o, salt, bar: (asked.append((len(a), len(o))), skip_sets(v, c, a, z, k, o, salt, bar))[1])
    both = merge_dropout.encode(p, [once, "again and again"], np.zeros(2, int), 5, 0.3, 1, np.array([1, 2]))
    assert asked == [(2, 1)]  # the two of "again" behind a space
    # the same ids whatever else lies in the chunk, and when all segments occur again
    for k, text in enumerate([once, "again and again"]):
        assert merge_dropout.encode(p, [text], np.zeros(1, int), 5, 0.3, 1, np.array([k + 1]))[0].tolist() == both[k].tolist()
    first = merge_dropout.encode(p, [once, once], np.zeros(2, int), 5, 0.3, 1, np.array([1, 9]))[0]
    assert asked[-1] == (600, 300) and first.tolist() == both[0].tolist()


def brute_counts(x):
    words, lines = re.findall(WHITE, x), [s for s in x.split("\n") if re.search(WHITE, s)]
    c = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    cover = {k + j for k in range(len(words) - 2) if c[tuple(words[k : k + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(cover), len(set(words)), len(x)


def test_counts():
    some = [t or "" for t in texts()] + ["a b c a b c", "l\nl\n l\nl", "#*$%&|<> x", "a b a b a", "\nq\n\nq"]
    got = column_counts(pa.array(some))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_chars")
    assert list(zip(*(got[k].tolist() for k in names), strict=True)) == [brute_counts(x) for x in some]
    assert all(len(column_counts(pa.array([], pa.string()))[c]) == 0 for c in COUNTS)


def test_outliers(docs, spark):
    rng = random.Random(1)
    clean = [" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(60, 200))) + "." for _ in range(150)]
    rows = list(enumerate(clean)) + [(500 + k, " ".join("#$%&" + w for w in clean[k].split())) for k in range(20)] + [(600, None), (601, "few words")]
    got = {r.doc_id: r for r in outliers(docs(rows)).collect()}
    assert sum(got[i].kept for i in range(150)) >= 148
    assert not any(got[500 + k].kept for k in range(20))
    assert got[600].base_failed and got[601].base_failed and not got[601].kept and got[600].n_words == 0
    small = outliers(docs(rows[:3]).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(small) == 3 and all(r.kept == (not r.base_failed) for r in small)
    assert outliers(docs([]).limit(0)).count() == 0


def brute_mcd(rows, core=0.5, inner=0.975, outer=0.999):
    """Squared distance and verdict for the texts of one group, in memory."""
    counts = column_counts(pa.array([t or "" for _, t in rows]))
    failed = (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])
    every = mcd.vector(counts)
    x = every[~failed]
    lowest = lambda v, q: np.sort(v)[int(np.ceil(q * len(v))) - 1]
    floor = mcd.noise(lowest(counts["n_words"][~failed], 0.5), lowest(counts["n_lines"][~failed], 0.5))
    near = lambda v: np.round(v * 10_000) / 10_000
    middle = np.array([lowest(near(c), 0.5) for c in x.T])
    scale = np.array([lowest(near(np.abs(c - m)), 0.5) for c, m in zip(x.T, middle, strict=True)]) * 1.4826
    scale = scale**2 + floor

    def estimate(y, factor):
        return y.mean(axis=0), np.cov(y.T, bias=True) * factor + np.diag(floor)

    def squared(y, m, c):
        return np.einsum("ij,jk,ik->i", y - m, np.linalg.inv(c), y - m)

    radius = np.sqrt(((x - middle) ** 2 / scale).sum(axis=1))
    drawn = middle + np.minimum(1, np.sqrt(mcd.chi_square(0.5)) / np.maximum(radius, 1e-9))[:, None] * (x - middle)
    def step(m, c):
        d = np.floor(np.log(np.maximum(squared(x, m, c), 1e-12)) * 1000)
        m, c = estimate(x[d <= lowest(d, core)], mcd.consistency(core))
        return round(float(np.linalg.slogdet(c)[1]), 6), m, c

    det, m, c = min((step(*step(*e)[1:]) for e in ((middle, np.diag(scale)), estimate(x, 1), estimate(drawn, 1))), key=lambda e: e[0])
    for _ in range(18):
        last = det
        det, m, c = step(m, c)
        if not det < last - 1e-4:
            break
    inside = x[squared(x, m, c) <= mcd.chi_square(inner)]
    d = squared(every, *estimate(inside, mcd.consistency(inner)))
    return {i: (v, not f and v <= mcd.chi_square(outer)) for (i, _), v, f in zip(rows, d, failed, strict=True)}


def test_outliers_as_in_memory(docs):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    rows = []
    for k in range(240):
        words = [word() for _ in range(rng.randint(60, 200))]
        if k % 9 == 0:
            words = [w.upper() + "!" if rng.random() < k / 240 else w for w in words]
        elif k % 11 == 0:
            words = ["#" + w if rng.random() < 0.5 else w for w in words]
        rows.append((k, (" " if k % 2 else "\n").join(words)))
    rows += [(300 + k, rows[5][1]) for k in range(90)] + [(400, None)]  # a third are copies of one text
    want = brute_mcd(rows)
    got = {r.doc_id: r for r in outliers(docs(rows)).collect()}
    assert {i: r.kept for i, r in got.items()} == {i: bool(k) for i, (_, k) in want.items()}
    assert all(abs(got[i].distance - d) < 1e-3 * max(1, d) for i, (d, _) in want.items())
    assert 15 < sum(not k for _, k in want.values()) < 90
    assert {r.doc_id: r.kept for r in outliers(docs(rows).repartition(7)).collect()} == {i: r.kept for i, r in got.items()}


def test_chi_square():
    for p, d, q in ((0.5, 7, 6.346), (0.975, 7, 16.013), (0.999, 7, 24.322), (0.95, 1, 3.841), (0.99, 10, 23.209)):
        assert abs(mcd.chi_square(p, d) - q) < 1e-3


def test_outliers_odd_rows(docs):
    text = " ".join(f"w{k}" for k in range(60))
    rows = docs([(None, text, 1), (7, text, 2), (7, text, 3), (7, None, 4)], ", salt int")
    got = outliers(rows).collect()
    assert len(got) == 4 and sum(r.kept for r in got) == 3 and sum(r.doc_id is None for r in got) == 1


def test_quality(docs, spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    rows, labels = [], []
    for k in range(400):
        words = [word() for _ in range(rng.randint(20, 150))]
        bad = k % 5 == 0
        rows.append((k, " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words) + "."))
        labels.append((k, int(not bad), 0))
    labels += [(None, 1, 0), (1, None, 0), (2, 0, 0), (9999, 1, 0)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    ranking = quality.fit(docs(rows), table)
    got = {r.doc_id: r.score for r in quality.score(docs(rows + [(500, None), (501, "")]), ranking).collect()}
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 4 == 2]  # the fold that is not learned from
    assert sum((got[k] >= 0.7) == (k % 5 != 0) for k in held) / len(held) > 0.97
    assert all(0 <= s <= 1 for s in got.values()) and got[500] == got[501]
    blank = quality.fit(docs(rows), table.filter("quality = 1"))
    assert {r.score for r in quality.score(docs(rows), blank).collect()} == {0.7}
    assert quality.score(docs([]).limit(0), ranking).count() == 0


PRIVATE = {
    "email": "mail Ann.Lee@corp.co.uk now", "card": "pay 4111 1111 1111 1111 now", "phone": "call +1 (499) 555-6503 now", "ip": "host 188.54.39.104, up", "iban": "to GB82 WEST 1234 5698 7654 32 now",
    "ssn": "id 078-05-1120 now", "secret": 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x', "hex": "x 04dbebab91ab85687d33eeaaf9ac699e1188f962 y", "name": "met Mrs. Anna Smith there",
}


def test_surrogates_keep_form():
    s = pii.Surrogates(b"k")
    for kind, text in PRIVATE.items():
        new, entities = pii.replace(text, s)
        assert [e["kind"] for e in entities] == [kind]
        e = entities[0]
        old, got = text[e["start"] : e["start"] + e["length"]], new[e["new_start"] : e["new_start"] + e["new_length"]]
        assert old != got and old not in new
        assert text[: e["start"]] == new[: e["start"]] and text[e["start"] + e["length"] :] == new[e["new_start"] + e["new_length"] :]
        assert pii.replace(text, s)[0] == new != pii.replace(text, pii.Surrogates(b"other"))[0]
    card = re.sub(r"\D", "", pii.replace(PRIVATE["card"], s)[0])
    assert pii.luhn(card[:-1]) == int(card[-1])
    iban = re.search(r"GB[\w ]+(?= now)", pii.replace(PRIVATE["iban"], s)[0])[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert pii.replace(PRIVATE["name"], s)[0].split()[2] in pii.GIVEN["f", "latin"]
    assert pii.replace("Licensed under CC BY-NC 4.0. Version 2.0, 1999.", s) == ("Licensed under CC BY-NC 4.0. Version 2.0, 1999.", [])


def test_surrogates_are_distinct_and_coreferent():
    s = pii.Surrogates(b"k")
    assert len({s.of("ssn", f"{k:03d}-00-0000") for k in range(1000)}) == 1000
    assert len({s.keyed.permute(k, 257, b"t") for k in range(257)}) == 257
    text = "call +1 (499) 555-6503 or +1 499 555 6503; Ann@x.org, ann@x.org"
    digits = [re.sub(r"\D", "", m) for m in re.findall(r"\+1[ \d()\-]+\d", pii.replace(text, s)[0])]
    assert len(set(digits)) == 1 and digits[0] != "14995556503"
    mails = re.findall(r"\S+@\S+[a-z]", pii.replace(text, s)[0])
    assert mails[0].lower() == mails[1].lower()


def test_whole_names_all_letters_and_no_clash():
    s = pii.Surrogates(b"k")
    for name in ("Mary Jane Smith", "John F. Kennedy", "Mr. John R. R. Tolkien", "Mrs. Anna Maria Luisa Garcia Lopez", "Mr. İpek", "Frau Łoś"):
        text = f"met {name} there. Then"
        new, (e,) = pii.replace(text, s)
        assert text[e["start"] : e["start"] + e["length"]] == name
        assert name not in new and name.split()[-1] not in new and new.endswith(" there. Then")
    for value in ("密码密码密码", "!!!###!!!", "пароль", "٣٤٥٦٧٨", "ﬀﬁﬂﬃﬄﬅ"):
        new, (e,) = pii.replace(f'password = "{value}"', s)
        assert value not in new and e["kind"] == "secret"
    # more names than their form has members: still all distinct, none of them real
    for names in ([f"Mr. {c}" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"], [f"192.168.{a}.{b}" for a in range(256) for b in range(0, 256, 4)]):
        text = "\n".join(names)
        got = pii.replace(text, s)[0].split("\n")
        assert len(set(got)) == len(names) and not set(got) & set(names)


def planted(rng):
    """A text with one entity of each kind, in forms and words of its own, and what they are."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    name = lambda: f"{letters(rng.randint(3, 8)).capitalize()} {letters(rng.randint(4, 9)).capitalize()}"
    card = digits(15)
    card += str(pii.luhn(card))
    key = lambda n: "".join(rng.choice("ABCDEFabcdef0123456789") for _ in range(n))
    some = {
        "email": rng.choice([f"{letters(5)}.{letters(6)}@{letters(7)}.com", f"{letters(4)}{digits(2)}@{letters(5)}.{letters(4)}.org"]),
        "card": rng.choice([card, " ".join(card[k : k + 4] for k in range(0, 16, 4))]),
        "phone": rng.choice([f"+{digits(2)} {rng.randint(100, 999)} {digits(3)} {digits(4)}", f"(2{digits(2)}) {digits(3)}-{digits(4)}", f"020 {digits(4)} {digits(4)}"]),
        "ip": ".".join(str(rng.randint(1, 254)) for _ in range(4)),
        "ipv6": ":".join(f"{rng.randrange(4096, 65536):x}" for _ in range(8)),
        "ssn": f"{digits(3)}-{digits(2)}-{digits(4)}",
        "jwt": f"eyJ{key(12)}.eyJ{key(20)}.{key(24)}",
        "key": rng.choice([f"sk_live_{key(24)}", "AKIA" + "".join(rng.choice("ABCDEFGH234567") for _ in range(16)), f"ghp_{key(36)}"]),
        "secret": rng.choice([f'password = "{letters(6)}{digits(2)}"', f"pwd: {letters(6)}{digits(2)}", f"token={key(16)}1a"]),
        "name": name(),
    }
    said = rng.choice(["Dear {}, hello", "Contact: {} today", "then {} said so", "we met {} there", "Mr. {} came"]).format(some["name"])
    if said.startswith("Mr."):
        some["name"] = "Mr. " + some["name"]
    parts = [said, *(f"see {v} here" for k, v in some.items() if k != "name")]
    rng.shuffle(parts)
    return "; ".join(parts), some


def test_recall_and_precision_for_each_kind():
    rng = random.Random(77)
    hit, found, true = Counter(), Counter(), Counter()
    for _ in range(300):
        text, some = planted(rng)
        got = {(text[a:z], kind) for a, z, kind in pii.detect(text)}
        for kind, value in some.items():
            true[kind] += 1
            hit[kind] += (value, kind) in got
        for value, kind in got:
            found[kind] += 1
    for kind in true:
        assert hit[kind] >= 0.9 * true[kind], (kind, hit[kind])
        assert hit[kind] >= 0.9 * found[kind], (kind, hit[kind], found[kind])
    for clean in ("Section 1.2.3 of 12:30:45", "std::vector<int> a::b", "the number 1234567890123 counts", "isbn 978-3-16-148410-0 ok", "key: value and token: nothing", "9807915762804490 items"):
        assert pii.detect(clean) == []


def test_distinct_over_the_whole_corpus():
    """Bijections without fixed points: distinct entities of all texts stay distinct, none is itself, the same everywhere."""
    s = pii.Surrogates(b"k")
    for size in (2, 3, 26, 257, 1000):
        moved = [s.keyed.moved(x, size, b"t") for x in range(size)]
        assert sorted(moved) == list(range(size)) and all(x != y for x, y in enumerate(moved))
        assert [s.keyed.unpermute(s.keyed.permute(x, size, b"t"), size, b"t") for x in range(size)] == list(range(size))
    rng = random.Random(3)
    to: dict = {}
    for _ in range(400):
        text, _ = planted(rng)
        new, entities = pii.replace(text, s)
        for e in entities:
            old = (e["kind"], pii.normal(e["kind"], text[e["start"] : e["start"] + e["length"]]))
            got = pii.normal(e["kind"], new[e["new_start"] : e["new_start"] + e["new_length"]])
            assert got != old[1] and to.setdefault(old, got) == got
    by_kind = Counter((k, v) for (k, _), v in to.items())
    assert max(by_kind.values()) == 1 and len(to) > 3500


def test_texts_that_leaked():
    s = pii.Surrogates(b"k")
    for text, secret in (('token="------"', "------"), ('token = "١٢٣٤٥٦٧٨"', "١٢٣٤٥٦٧٨"), ("Dr. Łukasz Żółć", "Żółć"), ("İnan@corp.com", "İnan"), ("Zelda Smith met Bob Jones", "Smith"), ("at 2001:db8::8a2e:370:7334 now", "8a2e")):
        new, entities = pii.replace(text, s)
        assert entities and secret not in new


def test_surrogate_rows(docs):
    rows = docs([(1, "a@b.com", 3), (1, "a@b.com", 3), (2, None, 4), (None, "", 5), (3, "x" * 500_000 + " a@b.com", 6)], ", c0 int")
    got = {(r.doc_id, r.c0): (r.text, len(r.entities)) for r in pii.surrogate_pii(rows, "k", keep=["doc_id", "c0"]).collect()}
    assert got[2, 4] == (None, 0) and got[None, 5] == ("", 0) and got[1, 3][1] == 1 and "a@b.com" not in got[1, 3][0]
    assert got[3, 6][1] == 1 and got[3, 6][0] == "x" * 500_000 + " " + got[1, 3][0]
    assert pii.surrogate_pii(docs([]).limit(0), "k").count() == 0


def test_reply_trees(spark):
    nodes = [("t", 1, None, "system", "s", 0.0), ("t", 2, 1, "user", "u", 0.0), ("t", 3, 2, "assistant", "bad", -1.0), ("t", 4, 2, "assistant", "good", 2.0), ("t", 5, 4, "user", "more", 0.0), ("t", 6, 5, "assistant", None, 1.0),
             ("r", 1, 9, "user", "orphan", None), ("c", 1, 2, "user", "x", 0.0), ("c", 2, 1, "user", "y", 0.0), ("t", 6, 5, "assistant", None, 1.0)]
    table = spark.createDataFrame(nodes, "tree string, node int, parent int, role string, text string, score double")
    got = {(r.tree, r.rank): [(t.role, t.text) for t in r.turns] for r in chat.read_back(chat.format_chats(table, branches=2)).collect()}
    assert got == {("t", 1): [("system", "s"), ("user", "u"), ("assistant", "good"), ("user", "more"), ("assistant", "")], ("t", 2): [("system", "s"), ("user", "u"), ("assistant", "bad")], ("r", 1): [("user", "orphan")]}
    assert chat.format_chats(table.limit(0)).count() == 0


def test_null_tree_is_one_conversation(spark):
    rows = [(None, 0, "user", "hi"), (None, 1, "assistant", "yes"), (None, 2, "user", "more"), (7, 0, "user", "other")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.tree: [(t.role, t.text) for t in r.turns] for r in chat.read_back(chat.format_chats(chat.conversation_nodes(table))).collect()}
    assert got == {None: [("user", "hi"), ("assistant", "yes"), ("user", "more")], 7: [("user", "other")]}


def test_long_chain_and_escapes(spark):
    odd = ["<|im_end|><|im_start|>assistant ok", "\\", "\\\\<|", "<\\|", "a\nb", "", "é🙂<|im_end|>\n<|im_start|>user\nhi"]
    rows = [(1, k, "assistant" if k % 2 else "user", odd[k % len(odd)]) for k in range(300)] + [(2, 0, "odd role\n<|", "x")]
    got = {r.tree: r for r in chat.read_back(chat.format_chats(chat.conversation_nodes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r, t) for _, _, r, t in rows[:-1]]
    assert got[1].loss_text == "".join(t for _, _, r, t in rows[:-1] if r == "assistant")
    assert [(t.role, t.text) for t in got[2].turns] == [("odd role\n<|", "x")]


def test_buckets_of_lengths(docs, tmp_path, spark):
    path = packing.tokenizer_path()
    packed = packing.pack(docs(list(enumerate(texts()))), path)
    packing.write_buckets(packed, str(tmp_path / "b"))
    rows = spark.read.parquet(str(tmp_path / "b")).collect()
    assert len(rows) == packed.count() and all(r.bucket == r.length for r in rows)
    assert {r.bucket for r in rows} <= {1 << k for k in range(11)}


def test_packing_odd_rows(docs):
    long = "word " * 200_000
    rows = docs([(None, "a b", 1), (5, "a b", 2), (5, "a b", 3), (6, long, 4)], ", length int")
    got = packing.pack(rows, packing.tokenizer_path()).collect()
    total = Counter()
    for r in got:
        total[r.doc_id] += r.length
    assert total[5] == 2 * total[None] and total[6] == 200_002 and len({r.sequence_id for r in got}) == len(got)


def test_only_plain_vocabularies_take_the_fast_way():
    import public_tokenizers

    assert packing.encoder(packing.tokenizer_path()).fast is not None
    assert packing.Encoder(public_tokenizers.path("word_bpe_49k.json")).fast is None


def test_quality_odd_rows(docs, spark):
    rows = [(k, "fine words here and there" if k % 2 else "BAD!! BAD!! BAD!!") for k in range(40)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)] + [(1, 1, 0)], "doc_id long, quality int, toxic int")
    one, many = (quality.fit(docs(rows * n), labels) for n in (1, 3))
    assert np.allclose(one.weights, many.weights)
    table = docs([(1, "fine words here and there", 0.5), (1, "fine words here and there", 0.5), (None, "x" * 500_000, 0.1)], ", label double")
    got = quality.score(table, one, keep=["doc_id", "label"]).collect()
    assert len(got) == 3 and got[0].score == got[1].score


def reference_merge(model, text, skip):
    """SentencePiece merging of one segment as the method is described, each candidate asked once."""
    piece = list(text)
    begin = list(range(len(piece)))
    asked = {}
    while True:
        best = None
        for k in range(len(piece) - 1):
            union = piece[k] + piece[k + 1]
            if union not in model:
                continue
            end = begin[k + 2] if k + 2 < len(piece) else len(text)
            where = (begin[k], begin[k + 1], end)
            if where not in asked:
                asked[where] = skip(*where)
            if not asked[where] and (best is None or model[union] > best[0]):
                best = (model[union], k)
        if best is None:
            return piece
        k = best[1]
        piece[k : k + 2] = [piece[k] + piece[k + 1]]
        del begin[k + 1]


def test_dropout_as_the_method_is_described(monkeypatch):
    import sentencepiece

    path = merge_dropout.model_path()
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    model = {m.id_to_piece(i): m.get_score(i) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))}
    p = merge_dropout.pieces(path)
    bar = round(0.3 * (1 << 53))
    salts = []
    merge = merge_dropout.merge
    monkeypatch.setattr(merge_dropout, "merge", lambda v, ids, first, salt, d: (salts.append(salt), merge(v, ids, first, salt, d))[1])
    for k, word in enumerate(["understanding", "internationalization", "merging", "aaaaaaaa", "thethethe"] * 8):
        (ids,) = merge_dropout.encode(p, [word], np.zeros(1, int), 5, 0.3, 1, np.array([k]))
        salt = salts[-1]
        skip = lambda b, c, e: bool(merge_dropout.skipped(salt[:1], np.array([b]), np.array([c]), np.array([e]), bar)[0])  # noqa: B023, E731
        assert [m.id_to_piece(int(i)) for i in ids] == reference_merge(model, "▁" + word, skip)
