"""PII: keyed surrogates.

Detected e-mail addresses, phone numbers, card numbers (with a valid check digit, or in the groups of
cards), IPv4 and IPv6 addresses, IBANs, national ids, secrets, access tokens and names of people are
replaced by surrogates of the same type and form.  A surrogate is a keyed bijection on the entity's own
format (letters stay letters of their script and case, digits digits, check
digits and country codes valid), so equal entities get equal surrogates everywhere and
distinct entities distinct ones, with no table shared between tasks.  The bijection is a permutation
that is followed by one step and undone, ``P^-1(P(x) + 1)``: it maps nothing to itself.
Given names move inside a list of one gender and script.  In each
document a collision check then compares surrogates with each other and with the document's
real entities; a clash takes another step, and this one entity is then called otherwise than in other documents. Forms with few members (a lone initial,
signs only) give way after ``DRAWS`` draws to letters or digits that grow with the draws, whatever the kind, so a free one is always found.

Names are found by titles, by known given names, and by context: two capitalised words or more after words such
as "Dear", "Contact:" or "met", or before "said", "wrote" and the like, one capitalised word before verbs of speech,
words in any case after a label such as "Name:", and Han names with a known surname beside a title or label.  A run that begins with an
article names a thing, not a person.

Each text is handled whole and alone: a map without a shuffle.  Searches go over a text once, and long entities are moved a
block at a time, each under a digest of those before it, so time is linear in the text.

Defined cases: a null text stays null and has no entities; an empty text stays
empty; overlapping matches: the first to start, then the longest; repeated rows are
replaced alike; other columns are kept as they are when named in ``keep``.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.slots import tidy

#: Fixed: honorifics by gender, and given names by gender and script.
MALE_TITLES = ("Mr", "Mister", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "Sir", "господин", "г-н")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Señorita", "Sra", "Doña", "госпожа", "г-жа")
TITLES = ("Dr", "Prof", "Professor")
_TITLES = {*MALE_TITLES, *FEMALE_TITLES, *TITLES}
GIVEN = {
    ("f", "latin"): ("Alice", "Anna", "Barbara", "Carmen", "Charlotte", "Claire", "Elena", "Emma", "Hannah", "Ingrid", "Isabel", "Julia", "Karen", "Laura", "Linda", "Lucía", "Maria", "María", "Marie", "Mary", "Nina", "Olivia", "Patricia", "Sarah", "Sofia", "Susan"),
    ("m", "latin"): ("Andreas", "Antoine", "Carlos", "Charles", "Daniel", "David", "Diego", "Edward", "Felix", "Hans", "Henry", "Jack", "James", "Javier", "John", "José", "Klaus", "Luis", "Michael", "Miguel", "Paul", "Peter", "Pierre", "Robert", "Thomas", "William"),
    ("f", "cyrillic"): ("Анна", "Вера", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Светлана", "Софья", "Татьяна"),
    ("m", "cyrillic"): ("Алексей", "Андрей", "Дмитрий", "Иван", "Игорь", "Михаил", "Николай", "Олег", "Павел", "Сергей"),
}
#: Letters that take each other's place; letters and digits of other scripts do so within their script, others, marks included, stay.
CLASSES = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóúàèìòùâêîôûäëïöü", "çñ", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ"]
_CLASS = {c: k for k, x in enumerate(CLASSES) for c in x}
_AT = {c: n for x in CLASSES for n, c in enumerate(x)}
#: Draws before a form gives way.
DRAWS = 64
#: Characters that are moved as one number; longer texts in blocks of so many.
BLOCK = 96
#: Short texts whose surrogates a task keeps at hand.
KNOWN = 4096
FEW = len(CLASSES)


def _all_scripts() -> None:
    """Adds a class for all other letters and digits of each script: with capitals, without, digits."""
    found: dict[tuple, list[str]] = {}
    for c in map(chr, range(0xAA, 0x110000)):
        kind = unicodedata.category(c)
        if kind not in ("Ll", "Lo", "Nd") or c in _CLASS or (kind == "Lo" and len(c.lower()) != 1):
            continue
        upper, script = c.upper(), unicodedata.name(c, "?").split()[0]
        # Latin has letters of names and signs of phonetics: those of one half of a block stay together
        block = ord(c) >> 7 if script == "LATIN" else 0
        found.setdefault((script, kind, len(upper) == 1 and upper != c and upper.lower() == c, block), []).append(c)
    for key in sorted(found):
        for n, c in enumerate(found[key]):
            _CLASS[c], _AT[c] = len(CLASSES), n
        CLASSES.append("".join(found[key]))


def _lower(c: str) -> str:
    """One character for one: of a longer lower case (capital I with dot) the letter without its marks."""
    return c.lower()[0]


_WORD = r"[^\W\d_](?:[^\W\d_]|['’\-](?=[^\W\d_]))*"
_TITLE = rf"(?:{'|'.join(map(re.escape, sorted({*MALE_TITLES, *FEMALE_TITLES, *TITLES}, key=len, reverse=True)))})\.?"
_GIVEN = rf"(?:{'|'.join(sorted({n for x in GIVEN.values() for n in x}, key=len, reverse=True))})"
#: What a name begins with, and each word or initial that may follow.
NAMES = re.compile(rf"(?<!\w)(?:{_TITLE}|{_GIVEN})(?=[  ][^\W\d_])")
_PART = re.compile(rf"[  ]((?:[^\W\d_]\.)+(?!\w)|{_WORD}(?!\w))")
_HINTS = re.compile("|".join(rf"{re.escape(t)}\b" for t in sorted({*MALE_TITLES, *FEMALE_TITLES, *TITLES, *(n for x in GIVEN.values() for n in x)})))
#: Fixed: words that announce a name, before and after it.
LABELS = ("Name", "Contact", "Author", "Attn", "Attention", "Customer", "Patient", "Employee", "Signed", "Owner", "Cc")
BEFORE = ("Dear", "met", "with", "by", "from", "named", "called", "asked", "told", "Sincerely,", "Regards,")
AFTER = ("met", "said", "says", "wrote", "writes", "called", "asked", "told", "replied", "lives", "works", "emailed", "was born")
_CAPITAL = r"(?=[^\W\d_])[A-ZÀ-ÖØ-ÞĀĂĄĆĈĊČĎĐĒĖĘĚĞĢĪİĶĹĽŁŃŇŌŐŒŘŚŞŠŤŪŮŰŹŻŽА-ЯЁ]"
_TAIL = r"(?:['’\-][^\W\d_]++)*+"
_NAME_WORD = rf"{_CAPITAL}(?:\.|[^\W\d_]++{_TAIL}(?![\w.]*@))"
_NAMED = rf"{_CAPITAL}[^\W\d_]++{_TAIL}(?:[  ]{_NAME_WORD})*[  ]{_CAPITAL}[^\W\d_]++{_TAIL}"
_CUE = re.compile(rf"(?<!\w)(?:(?:{'|'.join(LABELS)})[ ]?:[ ]?|(?:{'|'.join(BEFORE)})\s)(?={_CAPITAL})")
_VERB = re.compile(rf"(?<=[^\W\d_])(?=[  ](?:{'|'.join(AFTER)})(?!\w))")
_FORWARD = re.compile(rf"{_NAMED}(?![\w@])")
#: Runs of capitalised words that can stand before a verb.
_RUN = re.compile(rf"(?<![\w'’\-@.]){_NAMED}(?![\w@])")
#: Fixed: verbs of speech, before which one capitalised word is a name unless it is one of these words.
SPEECH = ("said", "says", "wrote", "writes", "told", "asked", "replied", "emailed")
_SINGLE = re.compile(rf"(?<![\w'’\-@.])({_CAPITAL}[^\W\d_]++{_TAIL})(?=[  ](?:{'|'.join(SPEECH)})(?!\w))")
ARTICLES = ("The", "A", "An", "This", "That", "These", "Those", "Our", "Their", "His", "Her", "My", "Your", "Its", "Some", "Any", "Every", "Each", "No", "All", "Der", "Die", "Das", "Le", "La", "Les", "El", "Los", "Las")
NO_NAMES = {*ARTICLES, "He", "She", "It", "They", "We", "You", "I", "Who", "What", "Which", "Someone", "Somebody", "Nobody", "Everyone", "Everybody", "People", "Others", "One", "Two", "Many", "Most", "Few", "Several", "And", "But", "Or", "So", "Then", "As", "When", "If", "Also", "Once", "Never", "Not", "Just", "There", "Here", "Well"}
#: After a label, words that begin in lower case, to the end of the line or the next sign; capitalised ones are found without it.
_LABEL_END = re.compile(rf"(?<!\w)(?i:{'|'.join(LABELS)})[ ]?$")
_LABEL_REACH = max(map(len, LABELS)) + 2
_ANY_CASE = re.compile(r"[^\W\d_]{2,}+(?:[  ][^\W\d_]++){1,3}+(?=[ \t]*(?:$|[\n\r,;.<|]))")
#: Fixed: frequent Han surnames, titles after names, labels before them.
HAN_SURNAMES = "王李张張刘劉陈陳杨楊黄黃赵趙吴吳周徐孙孫马馬朱胡郭何林高罗羅郑鄭梁谢謝宋唐许許邓鄧冯馮韩韓曹曾彭萧蕭蔡潘田董袁于余叶葉蒋蔣杜苏蘇魏程吕呂丁沈任姚卢盧傅钟鐘姜崔谭譚廖范汪陆陸金石戴贾賈韦韋夏邱方侯邹鄒熊孟秦白江阎閻薛尹段雷黎史龙龍陶贺賀顾顧毛郝龚龔邵万萬钱錢严嚴"
HAN_TITLES = ("先生", "女士", "小姐", "太太", "教授", "医生", "醫生", "老师", "老師", "经理", "經理", "博士", "同学", "同學")
HAN_LABELS = ("姓名", "联系人", "聯絡人", "作者", "客户", "客戶", "患者", "员工", "員工")
_HAN = re.compile(rf"[{HAN_SURNAMES}][\u4e00-\u9fff]{{0,2}}(?={'|'.join(HAN_TITLES)})")
_HAN_LABEL = re.compile(rf"(?:{'|'.join(HAN_LABELS)})[：:]([{HAN_SURNAMES}][\u4e00-\u9fff]{{1,3}})(?![\u4e00-\u9fff])")
_LOCAL = re.compile(r"[\w.%+\-]")
_DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}")
_GROUP = r"[0-9A-Fa-f]{1,4}"
IPV6 = rf"(?:{_GROUP}:){{7}}{_GROUP}|(?:{_GROUP}:){{1,6}}(?::{_GROUP}){{1,6}}|(?:{_GROUP}:){{1,7}}:|::(?:{_GROUP}:){{0,6}}{_GROUP}"
#: What stands before the value of a secret.
_SECRET_KEY = re.compile(r"(?<![\w@])(?i:api[_-]?key|access[_-]?key|token|secret|password|passwd|pwd)\s*+[=:]\s*+")
_QUOTED = re.compile(r"[\"'][^\"'\s]{6,}+[\"']")
_BARE = re.compile(r"[^\s\"',;]++")
_KEY = re.compile(r"(?<![\w@])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|(?:sk|pk|rk)_(?:live|test)_[A-Za-z0-9]{8,}+|sk-[A-Za-z0-9]{20,}+|xox[abprs]-[A-Za-z0-9\-]{10,}+|AIza[A-Za-z0-9_\-]{30,}+)")
#: Text in which three parts joined by dots can be a signed token, and where such a token can begin.
_DOTTED = re.compile(r"[A-Za-z0-9_\-.]*+")
_SIGNED = re.compile(r"(?<![\w@])eyJ(?=[A-Za-z0-9_\-]{6})")
#: What a text with one of these has in it; cheap to look for.
_SECRET_WORDS, _SECRET_STARTS = ("key", "token", "secret", "passw", "pwd"), ("AKIA", "ASIA", "gh", "k_live_", "k_test_", "sk-", "xox", "AIza", "eyJ")
HEX = re.compile(r"(?<![\w@])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?!\w)")
NUMBERS = re.compile(
    r"(?<![\w@])(?=[\d+(]|[A-Z][A-Z]\d)(?:"
    r"(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w))"
    r"|(?P<ip>(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d))"
    r"|(?P<card>\d(?:[ \-]?\d){12,18}(?!\d))"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4}(?!\d))"
    r"|(?P<phone>\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]?\d{2,4}){1,4}(?!\d)|0\d{1,4}[ \-]\d{3,4}[ \-]\d{3,4}(?![\d\-])|\(?\d{3}\)?[ .\-]\d{3}[ .\-]\d{4}(?!\d))"
    r")"
)
_IPV6 = re.compile(rf"(?<![\w:.])(?:{IPV6})(?![\w:]|\.\w)")
_COLONS = re.compile(r"(?<![\w:.])[0-9A-Fa-f]*:[0-9A-Fa-f:]*:[0-9A-Fa-f]*")
_CARD = re.compile(r"\d{4}([ \-])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ \-])\d{6}\2\d{5}")


class Keyed:
    """Keyed permutations of any range of integers: Feistel rounds over two near-equal halves, walked until inside."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.known: dict[tuple[str, bytes], str] = {}

    def _round(self, tweak: bytes, n: int, half: int, size: int) -> int:
        raw = half.to_bytes(half.bit_length() // 8 + 1, "little")
        return int.from_bytes(hashlib.shake_256(b"%b|%b|%d|%b" % (self.key, tweak, n, raw)).digest(size.bit_length() // 8 + 9), "little") % size

    def permute(self, x: int, size: int, tweak: bytes) -> int:
        if size < 2:
            return x
        a = math.isqrt(size - 1) + 1
        b = -(-size // a)
        while True:
            left, right = divmod(x, b)
            for n in range(4):
                left = (left + self._round(tweak, 2 * n, right, a)) % a
                right = (right + self._round(tweak, 2 * n + 1, left, b)) % b
            x = left * b + right
            if x < size:
                return x

    def unpermute(self, x: int, size: int, tweak: bytes) -> int:
        """The inverse of ``permute``."""
        a = math.isqrt(size - 1) + 1
        b = -(-size // a)
        while True:
            left, right = divmod(x, b)
            for n in reversed(range(4)):
                right = (right - self._round(tweak, 2 * n + 1, left, b)) % b
                left = (left - self._round(tweak, 2 * n, right, a)) % a
            x = left * b + right
            if x < size:
                return x

    def moved(self, x: int, size: int, tweak: bytes) -> int:
        """A keyed bijection without a fixed point, but for a range of one."""
        return x if size < 2 else self.unpermute((self.permute(x, size, tweak) + 1) % size, size, tweak)

    def text(self, s: str, tweak: bytes) -> str:
        """``s`` with each character moved inside its class; forms (classes and cases) never change."""
        if len(s) > BLOCK:
            return self._blocks(s, tweak, self.text)
        key = (s, tweak)
        if key not in self.known:
            if len(self.known) >= KNOWN:
                self.known.clear()
            self.known[key] = self._text(s, tweak)
        return self.known[key]

    def _blocks(self, s: str, tweak: bytes, one) -> str:
        """Each block under a digest of what stands before it: one to one, as the blocks can be undone in turn."""
        state, out = hashlib.blake2b(b"%d|" % len(s) + tweak, key=self.key, digest_size=16), []
        for at in range(0, len(s), BLOCK):
            part = s[at : at + BLOCK]
            out.append(one(part, state.digest()))
            state.update(part.encode("utf-8", "surrogatepass"))
        return "".join(out)

    def _text(self, s: str, tweak: bytes) -> str:
        low = "".join(map(_lower, s))
        if len(CLASSES) == FEW and any(c not in _CLASS and not c.isascii() and c.isalnum() for c in low):
            _all_scripts()
        if len(tweak) > BLOCK:
            tweak = hashlib.blake2b(tweak, digest_size=16).digest()
        x, size = 0, 1
        for c in low:
            if c in _CLASS:
                n = len(CLASSES[_CLASS[c]])
                x, size = x * n + _AT[c], size * n
        shape = "".join(chr(_CLASS[c]) if c in _CLASS else c for c in low)
        if odd := [c for c in s if len(c.lower()) != 1]:
            shape += "|" + "".join(odd)
        x = self.moved(x, size, tweak + shape.encode())
        out = []
        for c, was in zip(reversed(low), reversed(s), strict=True):
            if c in _CLASS:
                letters = CLASSES[_CLASS[c]]
                x, k = divmod(x, len(letters))
                c = letters[k]
            out.append(c.upper() if was != was.lower() else c)
        return "".join(reversed(out))

    def hexadecimal(self, s: str, tweak: bytes) -> str:
        if len(s) > BLOCK:
            out = self._blocks(s.lower(), tweak, self.hexadecimal)
        else:
            out = format(self.moved(int(s, 16), 16 ** len(s), tweak + b"%d" % len(s)), f"0{len(s)}x")
        return out.upper() if s != s.lower() else out


def luhn(digits: str) -> int:
    """The check digit that ``digits`` call for."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (2 if k % 2 == 0 else 1)
        total += d - 9 * (d > 9)
    return -total % 10


def iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


def is_card(s: str) -> bool:
    """A valid check digit, or the groups in which cards are written."""
    d = "".join(c for c in s if c.isdigit())
    return luhn(d[:-1]) == int(d[-1]) or bool(_CARD.fullmatch(s))


def _refill(shape: str, digits: str, skip: int = 0) -> str:
    """``shape`` with its digits, but the first ``skip``, taken from ``digits``."""
    rest, out = iter(digits), []
    for c in shape:
        if c.isdigit():
            skip -= 1
            c = c if skip >= 0 else next(rest)
        out.append(c)
    return "".join(out)


_KEY_HEAD = re.compile(r"[A-Za-z]+_(?:live_|test_)?|sk-|xox[a-z]-|.{4}")
#: A secret: what stands before its value, the value, the quote after it.
_VALUE = re.compile(r"(?s)([^=:]*[=:]\s*[\"']?)(.*?)([\"']?)")


class Surrogates:
    def __init__(self, key: bytes):
        self.keyed = Keyed(key)

    def of(self, kind: str, s: str, attempt: int = 0) -> str:
        t = b"%b%d" % (kind.encode(), attempt)
        if attempt >= DRAWS:
            return getattr(self, f"_wide_{kind}")(s, t, 1 + (attempt - DRAWS) // 8)
        return getattr(self, f"_{kind}")(s, t)

    # Where the form has no free member: letters or digits in its place, longer with each few draws.

    def _letters(self, s: str, t: bytes, more: int, letters: str = "abcdefghijklmnopqrstuvwxyz") -> str:
        raw = hashlib.shake_256(b"%b|%b|%b" % (self.keyed.key, t, s.encode())).digest(len(s) + more)
        return "".join(letters[c % len(letters)] for c in raw)

    def _wide_email(self, s: str, t: bytes, more: int) -> str:
        local, at, _ = s.partition("@")
        return self._letters(local, t, more) + at + self._email(s, t).partition("@")[2]

    def _wide_phone(self, s: str, t: bytes, more: int) -> str:
        return self._phone(s, t) + self._letters("", t + s.encode(), more, "0123456789")

    def _wide_ip(self, s: str, t: bytes, more: int) -> str:
        x = int.from_bytes(bytes(map(int, s.split("."))), "big")
        return ".".join(map(str, self.keyed.moved(x, 256**4, t + b"wide").to_bytes(4, "big")))

    def _wide_secret(self, s: str, t: bytes, more: int) -> str:
        m = _VALUE.fullmatch(s)
        return m[1] + self._letters(m[2], t, more) + m[3]

    def _wide_hex(self, s: str, t: bytes, more: int) -> str:
        out = self._letters(s, t, more, "0123456789abcdef")
        return out.upper() if s != s.lower() else out

    def _wide_ipv6(self, s: str, t: bytes, more: int) -> str:
        x = self._letters("", t + s.encode(), 31, "0123456789abcdef")
        return ":".join(("2" + x)[k : k + 4] for k in range(0, 32, 4))

    def _wide_jwt(self, s: str, t: bytes, more: int) -> str:
        return "eyJ" + ".".join(self._letters(x, t + b"%d" % k, more) for k, x in enumerate(s[3:].split(".")))

    def _wide_key(self, s: str, t: bytes, more: int) -> str:
        start = _KEY_HEAD.match(s).end()
        return s[:start] + self._letters(s[start:], t, more, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")

    def _wide_iban(self, s: str, t: bytes, more: int) -> str:
        body = self._letters(s.replace(" ", "")[4:], t, more, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
        return s[:2] + iban_check(s[:2], body) + body

    def _wide_card(self, s: str, t: bytes, more: int) -> str:
        body = self._letters("".join(c for c in s if c.isdigit())[1:], t, more, "0123456789")
        return body + str(luhn(body))

    def _wide_ssn(self, s: str, t: bytes, more: int) -> str:
        return self._ssn(s, t) + self._letters("", t + s.encode(), more, "0123456789")

    def _wide_name(self, s: str, t: bytes, more: int) -> str:
        words = re.split(r"([  ])", s)
        return "".join(w if k % 2 or w.rstrip(".") in _TITLES else self._letters(w, t + b"%d" % k, more).capitalize() for k, w in enumerate(words))

    def _email(self, s: str, t: bytes) -> str:
        local, _, domain = s.partition("@")
        labels = domain.split(".")
        if labels[-2].lower() == "example":  # reserved names stand for nobody
            hosts = [self.keyed.text(x, t + b"host") for x in labels[:-2]] + labels[-2:]
        else:
            hosts = [*self.keyed.text(domain, t + b"domain").split("."), "example"]
        return f"{self.keyed.text(local, t + domain.lower().encode())}@{'.'.join(hosts)}"

    def _card(self, s: str, t: bytes) -> str:
        d = "".join(c for c in s if c.isdigit())
        body = str(self.keyed.moved(int(d[:-1]), 10 ** (len(d) - 1), t + b"%d" % len(d))).zfill(len(d) - 1)
        # a valid number stays valid, another stays off by as much
        return _refill(s, body + str((luhn(body) + int(d[-1]) - luhn(d[:-1])) % 10))

    def _phone(self, s: str, t: bytes) -> str:
        d = "".join(c for c in s if c.isdigit())
        country = re.match(r"\+(\d{1,3})(?=[ .\-(])", s)
        code = len(country[1]) if country else min(3, max(0, len(d) - 10))
        body = d[code:]
        return _refill(s, str(self.keyed.moved(int(body), 10 ** len(body), t + b"%d" % len(body))).zfill(len(body)), code)

    def _ssn(self, s: str, t: bytes) -> str:
        return _refill(s, str(self.keyed.moved(int(s.replace("-", "")), 10**9, t)).zfill(9))

    def _ip(self, s: str, t: bytes) -> str:
        a = [int(x) for x in s.split(".")]
        fixed = 1 if a[0] in (10, 127) else 2 if (a[0] == 192 and a[1] == 168) or (a[0] == 172 and 16 <= a[1] < 32) or (a[0] == 169 and a[1] == 254) else 0
        if fixed:
            size, x = 256 ** (4 - fixed), int.from_bytes(bytes(a[fixed:]), "big")
            return ".".join(map(str, a[:fixed] + list(self.keyed.moved(x, size, t + bytes(a[:fixed])).to_bytes(4 - fixed, "big"))))
        return ".".join(map(str, self.keyed.moved(int.from_bytes(bytes(a), "big"), 256**4, t).to_bytes(4, "big")))

    def _iban(self, s: str, t: bytes) -> str:
        flat = s.replace(" ", "")
        body = self.keyed.text(flat[4:], t + flat[:2].encode())
        rest = iter(flat[:2] + iban_check(flat[:2], body) + body)
        return "".join(c if c == " " else next(rest) for c in s)

    def _hex(self, s: str, t: bytes) -> str:
        return self.keyed.hexadecimal(s, t)

    def _ipv6(self, s: str, t: bytes) -> str:
        # group by group, so that the way it is written stays; a leading 2000::/3 stays one
        parts = re.split("(:)", s)
        return "".join(x if k % 2 or not x else x[:1] * (k == 0) + (self.keyed.hexadecimal(x[k == 0 :], t + b"%d" % k) if x[k == 0 :] else "") for k, x in enumerate(parts))

    def _jwt(self, s: str, t: bytes) -> str:
        return "eyJ" + ".".join(self.keyed.text(x, t + b"%d" % k) for k, x in enumerate(s[3:].split(".")))

    def _key(self, s: str, t: bytes) -> str:
        start = _KEY_HEAD.match(s).end()
        return s[:start] + self.keyed.text(s[start:], t)

    def _secret(self, s: str, t: bytes) -> str:
        m = _VALUE.fullmatch(s)
        value = m[2]
        plain = re.fullmatch(r"[0-9a-f]{8,}|[0-9A-F]{8,}", value)
        return m[1] + (self.keyed.hexadecimal(value, b"hex" + t[6:]) if plain else self.keyed.text(value, t)) + m[3]

    def _name(self, s: str, t: bytes) -> str:
        words = re.split(r"([  ])", s)
        head = words[0].rstrip(".")
        out, gender = [], "m" if head in MALE_TITLES else "f" if head in FEMALE_TITLES else None
        for k, w in enumerate(words):
            if k % 2 or w.rstrip(".") in _TITLES:
                out.append(w)
                continue
            known = next((v for v in GIVEN.items() if w in v[1] and gender in (None, v[0][0])), None)
            if known:
                gender = known[0][0]
                out.append(known[1][self.keyed.moved(known[1].index(w), len(known[1]), t + "".join(known[0]).encode())])
            else:
                out.append(self.keyed.text(w, b"surname" + t[4:]))
        return "".join(out)


def addresses(text: str) -> list[tuple[int, int, str]]:
    """E-mail addresses, from each sign to both sides: linear in the text, however long its words are."""
    found: list[tuple[int, int, str]] = []
    at = text.find("@")
    last = 0
    while at >= 0:
        if at > last and (text[at - 1].isalnum() or text[at - 1] == "_") and (m := _DOMAIN.match(text, at + 1)):
            lo = at
            while lo > last and _LOCAL.match(text[lo - 1]):
                lo -= 1
            while not (text[lo].isalnum() or text[lo] == "_"):
                lo += 1
            found.append((lo, m.end(), "email"))
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", last)
    return found


def secrets(text: str) -> list[tuple[int, int, str]]:
    """Values behind words for secrets, signed tokens, and access keys by their first letters."""
    found = [(m.start(), m.end(), "key") for m in _KEY.finditer(text)]
    end = letter = digit = 0  # of the unbroken text around the last value: where it ends, its last letter, its last digit
    past = 0
    for m in _SECRET_KEY.finditer(text):
        at = m.end()
        if m.start() < past:
            continue
        if q := _QUOTED.match(text, at):
            past = q.end()
            found.append((m.start(), past, "secret"))
            continue
        if at >= end and (bare := _BARE.match(text, at)):
            end, run = bare.end(), bare[0]
            letter, digit = (next((at + k for k in range(len(run) - 1, -1, -1) if test(run[k])), -1) for test in (str.isalpha, str.isdecimal))
        if at < end and end - at >= 6 and letter >= at and digit >= at:
            past = end
            found.append((m.start(), end, "secret"))
    last = 0
    for m in _SIGNED.finditer(text):
        if m.start() < last:
            continue
        run = _DOTTED.match(text, m.start())
        last = run.end()
        found += [(run.start() + a, run.start() + z, "jwt") for a, z in signed(run[0])]
    return found


def signed(run: str) -> list[tuple[int, int]]:
    """Signed tokens in unbroken text: three parts of some length joined by dots, of which the first has a known beginning."""
    out, parts, at, k = [], run.split("."), 0, 0
    starts = []
    for p in parts:
        starts.append(at)
        at += len(p) + 1
    while k + 2 < len(parts):
        m = next((m.start() for m in _SIGNED.finditer(parts[k])), None)
        if m is not None and len(parts[k]) - m >= 9 and len(parts[k + 1]) >= 6 and len(parts[k + 2]) >= 6:
            out.append((starts[k] + m, starts[k + 2] + len(parts[k + 2])))
            k += 3
        else:
            k += 1
    return out


def near_names(text: str) -> list[tuple[int, int, str]]:
    """Names by what stands beside them."""
    near: list[tuple[int, int]] = []
    last = 0
    for cue in _CUE.finditer(text):
        if cue.end() >= last and (m := _FORWARD.match(text, cue.end())):
            near.append(m.span())
            last = m.end()
    verbs = {m.start() for m in _VERB.finditer(text)}
    if verbs:
        ends = set()
        for m in _RUN.finditer(text):
            if m.end() in verbs:
                ends.add(m.end())
                if m[0].partition(" ")[0] not in ARTICLES:
                    near.append(m.span())
        near += [m.span(1) for m in _SINGLE.finditer(text) if m[1] not in NO_NAMES and m.end() not in ends and not text.endswith(_TITLE_ENDS, 0, m.start())]
    at = text.find(":")
    while at >= 0:
        if at and (text[at - 1].isalpha() or text[at - 1] == " ") and _LABEL_END.search(text[max(0, at - _LABEL_REACH) : at]) and (m := _ANY_CASE.match(text, at + 1 + text.startswith(" ", at + 1))) and not m[0][0].isupper():
            near.append(m.span())
        at = text.find(":", at + 1)
    found = [(a, z, "name") for a, z in near if not any(w.rstrip(".") in _TITLES for w in text[a:z].split())]
    if not text.isascii():
        found += [(*m.span(), "name") for m in _HAN.finditer(text)] + [(*m.span(1), "name") for m in _HAN_LABEL.finditer(text)]
    return found


#: A capitalised word behind another is the end of a run, and no single name.
_TITLE_ENDS = tuple(f"{t} " for t in sorted(_TITLES)) + tuple(f"{t}. " for t in sorted(_TITLES))


def detect(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of each entity, in order, without overlap."""
    found: list[tuple[int, int, str]] = []
    found += addresses(text)
    low = text.lower()
    if any(x in low for x in _SECRET_WORDS) or any(x in text for x in _SECRET_STARTS):
        found += secrets(text)
    if _HEX_RUN.search(text):
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if _DIGIT.search(text):
        at = 0
        while m := NUMBERS.search(text, at):
            at = m.end()
            if m.lastgroup == "card" and not is_card(m[0]):
                # the digits are no card; something shorter may begin behind the first group
                at = m.start() + len(re.match(r"\d+", m[0])[0])
                continue
            found.append((m.start(), m.end(), m.lastgroup))
    if text.count(":") > 1:
        for part in _COLONS.finditer(text):
            m = _IPV6.match(text, part.start())
            if m and (m[0].count(":") > 3 or len(m[0]) > 6) and re.search(r"\d", m[0]):
                found.append((m.start(), m.end(), "ipv6"))
    if _HINTS.search(text):
        at = 0
        while m := NAMES.search(text, at):
            # a name goes on as long as capitalised words and initials follow; the search goes on from there
            end = m.end()
            while (w := _PART.match(text, end)) and w[1][0].isupper() and w[1].rstrip(".") not in _TITLES:
                end = w.end()
            at = end
            if end > m.end():
                found.append((m.start(), end, "name"))
    found += near_names(text)
    found.sort(key=lambda x: (x[0], -x[1]))
    out, last = [], 0
    for a, z, kind in found:
        if a < last < z and kind == "name" and (m := _REST.match(text, last, z)):  # what another entity has left of a name
            a = m.end()
        if a >= last and z > a:
            out.append((a, z, kind))
            last = z
    return out


_REST = re.compile(r"[  ]+(?=[^\W\d_])")


_DIGIT = re.compile(r"\d")
_HEX_RUN = re.compile(r"[0-9A-Fa-f]{32}")
_FORM = re.compile(r"[^\W_]")


def normal(kind: str, s: str) -> str:
    """Spellings of one entity that refer to the same."""
    if kind in ("email", "hex"):
        return s.lower()
    if kind in ("phone", "card", "ssn"):
        return "".join(c for c in s if c.isdigit())
    return s.replace(" ", "") if kind == "iban" else s


def replace(text: str, surrogates: Surrogates) -> tuple[str, list[dict]]:
    """The text with surrogates, and its entities: kind, start and length in it, start and length in the result."""
    spans = detect(text)
    if not spans:
        return text, []
    real = {normal(k, text[a:z]) for a, z, k in spans}
    attempts: dict[tuple[str, str], int] = {}
    used: dict[str, tuple[str, str]] = {}
    crowded: set[tuple[str, str]] = set()  # forms of which this text has (nearly) all members
    out, at, length, entities = [], 0, 0, []
    for a, z, kind in spans:
        s = text[a:z]
        entity = (kind, normal(kind, s))
        if entity not in attempts:
            form = (kind, _FORM.sub(lambda m: "0" if m[0].isdecimal() else "a", s[:BLOCK]))
            n = DRAWS if form in crowded else 0
            new = normal(kind, surrogates.of(kind, s, n))
            while (new in real or used.get(new, entity) != entity):
                n += 1
                new = normal(kind, surrogates.of(kind, s, n))
            if n >= DRAWS:
                crowded.add(form)
            attempts[entity] = n
            used[new] = entity
        new = surrogates.of(kind, s, attempts[entity])
        out += [text[at:a], new]
        length += a - at
        entities.append({"kind": kind, "start": a, "length": z - a, "new_start": length, "new_length": len(new)})
        length += len(new)
        at = z
    return "".join(out) + text[at:], entities


ENTITIES = "array<struct<kind:string,start:long,length:long,new_start:long,new_length:long>>"
_ENTITY = pa.list_(pa.struct([("kind", pa.string()), *((c, pa.int64()) for c in ("start", "length", "new_start", "new_length"))]))


def surrogate_pii(docs: DataFrame, key: str, text_col: str = "text", keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``text`` with surrogates and ``entities``."""
    keep = list(keep)
    names = [f"c{k}" for k in range(len(keep))]

    def rewrite(batches):
        surrogates = Surrogates(key.encode())
        for b in batches:
            # a few megabytes at a time
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                texts, entities = [], []
                for x in part.column("text"):
                    x = x.as_py()
                    new, found = (None, []) if x is None else replace(x, surrogates)
                    texts.append(new)
                    entities.append(found)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(texts, pa.string()), pa.array(entities, _ENTITY)], [*names, "text", "entities"])
            tidy()

    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = "".join(f"{n} {rows.schema[n].dataType.simpleString()}, " for n in names)
    out = rows.mapInArrow(rewrite, f"{schema}text string, entities {ENTITIES}")
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], "text", "entities")


KEY = "tessera"


def op9_pii(spark, sf_dir: str) -> DataFrame:
    out = surrogate_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"), KEY)
    return out.select("doc_id", F.size("entities").cast("long").alias("n_entities"), F.array_join(F.array_sort(F.array_distinct(F.transform("entities", lambda e: e["kind"]))), ",").alias("kinds"), "text")
