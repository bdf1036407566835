"""Surrogates end on every text, in time linear in it."""

import itertools
import time

import pytest

from tessera.llm import pii

FULL = {
    "key without another member": "key AIza" + "-" * 32,
    "chat key of hyphens": "xoxb-" + "-" * 12 + " end",
    "token of lines": "eyJ______.______.______",
    "every address of a form": " ".join(f"1::{x:x}:{y:02x}" for x, y in itertools.product(range(16), range(256))),
    "every address of one group": " ".join(f"1:2:3:4:5:6:7:{x:x}" for x in range(16)) + " " + " ".join(f"2:2:3:4:5:6:7:{x:x}" for x in range(16)),
    "letters only": " ".join(f"Mr {a}. {b}." for a, b in itertools.product("ABCDEFGHIJKLM", repeat=2)),
    "secrets of signs": "password='______' token=\"------\" pwd='++++++'",
    "one iban form": " ".join(f"GB{k:02d}0000 0000 0000" for k in range(100)),
}


@pytest.mark.parametrize("text", FULL.values(), ids=FULL)
def test_forms_without_members_end(text):
    start = time.perf_counter()
    new, entities = pii.replace(text, pii.Surrogates(b"k"))
    assert entities and time.perf_counter() - start < 20
    old = {(e["kind"], pii.normal(e["kind"], text[e["start"] : e["start"] + e["length"]])) for e in entities}
    made = {(e["kind"], pii.normal(e["kind"], new[e["new_start"] : e["new_start"] + e["new_length"]])) for e in entities}
    assert len(old) == len(made) and not {x for _, x in old} & {x for _, x in made}


@pytest.mark.parametrize("kind", ["email", "phone", "card", "ssn", "ip", "ipv6", "iban", "hex", "jwt", "key", "secret", "name"])
def test_every_kind_can_grow(kind):
    real = {"email": "a@b.example", "phone": "555-123-4567", "card": "4111111111111111", "ssn": "123-45-6789", "ip": "8.8.8.8", "ipv6": "1::2:3", "iban": "GB82WEST12345698765432", "hex": "a" * 32, "jwt": "eyJaaaaaa.bbbbbb.cccccc", "key": "AIza" + "-" * 32, "secret": "pwd=abc123", "name": "A. B."}[kind]
    drawn = {pii.Surrogates(b"k").of(kind, real, n) for n in range(pii.DRAWS, pii.DRAWS + 40)}
    assert len(drawn) == 40 and real not in drawn


LONG = {
    "salutations": "Dear Ab ",
    "initials": "by Ab A. A. ",
    "passwords": "-pwd=x",
    "quoted": 'pwd="aaaaa',
    "tokens": "-eyJabcdefg",
    "dotted tokens": "eyJabcdef.",
    "capitals": "Aa'Bb",
    "numbers": "1-2 ",
    "colons": "a:b",
    "signs": "a@b-",
    "spaces": "pwd  ",
    "digits": "12 34 ",
    "verbs": "Xa said ",
    "labels": "Name: ab cd ef ",
}


@pytest.mark.parametrize("part", LONG.values(), ids=LONG)
def test_a_megabyte_is_linear(part):
    text = part * (1_000_000 // len(part))
    s = pii.Surrogates(b"k")
    start = time.perf_counter()
    new, _ = pii.replace(text, s)
    assert time.perf_counter() - start < (15 if part[0].isdigit() else 5)
    assert new


@pytest.mark.parametrize("text", ["a" * 1_000_000 + "@example.com", "x" * 500_000 + "@" + "ab." * 100_000 + "com", "f" * 1_000_000, "Mr " + "Ab" * 500_000, "password='" + "aB3" * 300_000 + "'", "eyJ" + "a" * 900_000 + ".bbbbbb.cccccc"])
def test_one_long_entity_is_linear(text):
    start = time.perf_counter()
    new, (entity, *_) = pii.replace(text, pii.Surrogates(b"k"))
    assert time.perf_counter() - start < 10
    assert new != text and entity["length"] > 300_000


def test_blocks_are_one_to_one():
    keyed = pii.Keyed(b"k")
    base = "ab1" * 60
    seen = {keyed.text(base, b"t")}
    for k in range(len(base)):
        other = base[:k] + ("c" if base[k] != "1" else "2") + base[k + 1 :]
        new = keyed.text(other, b"t")
        assert new != other and new not in seen
        seen.add(new)


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("Müller wrote to us.", ["Müller"]),
        ("name: jane van doe\nnext", ["jane van doe"]),
        ("姓名：王小明，住在", ["王小明"]),
        ("请找李先生。", ["李"]),
        ("hash " + "a1" * 65 + " end", ["a1" * 65]),
        ("x " * 5 + "Alexandra " + "Verylongname" * 20 + " Schmidt said", ["Alexandra " + "Verylongname" * 20 + " Schmidt"]),
        ("The Great Gatsby said", []),
        ("He said that They wrote", []),
    ],
)
def test_names_of_other_forms(text, names):
    assert [text[a:z] for a, z, _ in pii.detect(text)] == names


def test_letters_stay_in_their_alphabet():
    new, _ = pii.replace("Dear Zażółć Gęślą,", pii.Surrogates(b"k"))
    assert all(c.isascii() or 0xC0 <= ord(c) < 0x180 for c in new)
