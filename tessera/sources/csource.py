"""C sources: tokens, functions and conditional compilation, over whole files in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed: smallest function body and smallest one that is abstracted, in tokens, and C's words.
MIN_BODY, MIN_ABSTRACT = 6, 24
KEYWORDS = frozenset("auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while".split())
_TOKEN = re.compile(r"/\*.*?(?:\*/|\Z)|//(?:\\\n|[^\n])*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|[A-Za-z_]\w*|\.?\d(?:[eEpP][+-]|[\w.])*|\.\.\.|->|\+\+|--|<<=|>>=|<<|>>|[<>=!+\-*/%&|^]=|&&|\|\||##|\S", re.S)
_NUMBER = re.compile(r"^(0[xX][0-9a-fA-F]+|[\d.]+(?:[eE][+-]?\d+)?)[uUlLfF]*$")


def tokenize(text: str) -> Iterator[tuple[str, int]]:
    """``(token, offset)``: comments dropped, strings whole, suffixes of numbers cut."""
    for m in _TOKEN.finditer(text):
        t = m[0]
        if t.startswith(("/*", "//")):
            continue
        if t[0].isdigit() or (t[0] == "." and len(t) > 1 and t[1].isdigit()):
            n = _NUMBER.match(t)
            t = n[1] if n else t
        yield t, m.start()


def _blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def without_directives(text: str) -> str:
    """Preprocessor lines blanked, and all but the first branch of each conditional, so that braces balance."""
    out, depth = [], []  # depth: for each open conditional, whether a later branch is being skipped
    joined = False
    for line in text.split("\n"):
        stripped = line.lstrip()
        if joined or stripped.startswith("#"):
            word = re.match(r"#\s*(\w+)", stripped)
            if not joined and word:
                if word[1] in ("if", "ifdef", "ifndef"):
                    depth.append(False)
                elif word[1] in ("else", "elif") and depth:
                    depth[-1] = True
                elif word[1] == "endif" and depth:
                    depth.pop()
            joined = line.rstrip().endswith("\\")
            out.append(_blank(line))
        else:
            out.append(_blank(line) if any(depth) else line)
    return "\n".join(out)


def functions(text: str) -> list[dict]:
    """Definitions at file level: name, tokens from name to closing brace, and first line."""
    toks = list(tokenize(without_directives(text)))
    words = [t for t, _ in toks]
    out, i, n = [], 0, len(words)
    while i < n:
        # a block that only wraps declarations is entered
        if words[i] == "namespace" or (words[i] == "extern" and i + 1 < n and words[i + 1] == '"C"'):
            j = i + 1
            while j < n and words[j] not in ("{", ";"):
                j += 1
            i = j + 1
            continue
        if re.match(r"[A-Za-z_]", words[i]) and words[i] not in KEYWORDS and i + 1 < n and words[i + 1] == "(":
            close = _matching(words, i + 1, "(", ")")
            body = close + 1
            # old-style parameter declarations, attributes and qualifiers may come between
            while body < n and body - close < 64 and words[body] not in ("{", "}", "(", "=", ","):
                if words[body] == ";" and (body + 1 >= n or body == close + 1):
                    break
                body += 1
            if body < n and words[body] == "{":
                end = _matching(words, body, "{", "}")
                if end < n and end - body - 1 >= MIN_BODY:
                    out.append({"name": words[i], "tokens": words[i : end + 1], "line": text.count("\n", 0, toks[i][1]) + 1})
                i = end + 1
                continue
            i = close + 1
            continue
        if words[i] == "{":
            i = _matching(words, i, "{", "}") + 1
            continue
        i += 1
    return out


def _matching(words: list[str], at: int, opens: str, closes: str) -> int:
    depth = 0
    for k in range(at, len(words)):
        depth += (words[k] == opens) - (words[k] == closes)
        if not depth:
            return k
    return len(words)


def abstract(tokens: list[str]) -> list[str] | None:
    """Names as ``@``, so that renaming changes nothing; null for short functions."""
    return None if len(tokens) < MIN_ABSTRACT else [("@" if re.match(r"[A-Za-z_]", t) and t not in KEYWORDS else t) for t in tokens]


# ---- conditional compilation, three-valued ---------------------------------------------------

_EXPRESSION = re.compile(r"\s*(?:(defined)\b\s*\(?\s*([A-Za-z_]\w*)\s*\)?|(IS_ENABLED|IS_BUILTIN)\s*\(\s*([A-Za-z_]\w*)\s*\)|([A-Za-z_]\w*)|(0[xX][0-9a-fA-F]+|\d+)[uUlL]*|(&&|\|\||[!=<>]=|<<|>>|[-+*/%()!<>&|^~?:]))")


class Undecided(Exception):
    """An expression outside the grammar."""


def evaluate(expression: str, macros: dict[str, int | None]) -> bool | None:
    """Truth of ``#if expression``: None where a macro is unknown (``macros`` maps a name that may be defined to None; absent names are undefined)."""
    tokens: list = []
    at = 0
    expression = re.sub(r"/\*.*?\*/|//.*", " ", expression).rstrip()
    while at < len(expression):
        m = _EXPRESSION.match(expression, at)
        if not m or m.end() == at:
            return None
        at = m.end()
        if m[1] or m[3]:
            name = m[2] or m[4]
            value = macros[name] if name in macros else 0
            tokens.append(("v", None if name in macros and value is None else int(name in macros) if m[1] else int(bool(value))))
        elif m[5]:
            tokens.append(("v", macros.get(m[5], 0)))
        elif m[6]:
            tokens.append(("v", int(m[6], 0)))
        else:
            tokens.append(("o", m[7]))
    pos = 0
    levels = [["||"], ["&&"], ["|"], ["^"], ["&"], ["==", "!="], ["<", ">", "<=", ">="], ["<<", ">>"], ["+", "-"], ["*", "/", "%"]]

    def peek():
        return tokens[pos] if pos < len(tokens) else ("e", None)

    def unary():
        nonlocal pos
        kind, x = peek()
        pos += 1
        if kind == "v":
            return x
        if x == "(":
            v = binary(0)
            if peek() != ("o", ")"):
                raise Undecided
            pos += 1
            return v
        if x in ("!", "-", "+", "~"):
            v = unary()
            return None if v is None else {"!": int(not v), "-": -v, "+": v, "~": ~v}[x]
        raise Undecided

    def binary(level: int):
        nonlocal pos
        if level == len(levels):
            return unary()
        a = binary(level + 1)
        while peek()[0] == "o" and peek()[1] in levels[level]:
            op = tokens[pos][1]
            pos += 1
            a = apply(op, a, binary(level + 1))
        return a

    try:
        value = binary(0)
        if pos != len(tokens):
            return None
    except (Undecided, ZeroDivisionError, ValueError):
        return None
    return None if value is None else bool(value)


def apply(op: str, a: int | None, b: int | None) -> int | None:
    """Kleene's and/or; anything else with an unknown is unknown."""
    if op == "&&":
        return 0 if a == 0 or b == 0 else None if a is None or b is None else 1
    if op == "||":
        return 1 if a or b else None if a is None or b is None else 0
    if a is None or b is None:
        return None
    return int({"|": a | b, "^": a ^ b, "&": a & b, "==": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b, "+": a + b, "-": a - b, "*": a * b}[op]) if op not in ("/", "%", "<<", ">>") else int({"/": lambda: a // b, "%": lambda: a % b, "<<": lambda: a << b, ">>": lambda: a >> b}[op]())


def inactive_lines(text: str, macros: dict[str, int | None]) -> list[int]:
    """Lines that are surely not compiled; what cannot be decided stays."""
    stack: list[list] = []  # [state of this branch, whether an earlier branch was surely taken, an earlier may have been]
    off: list[int] = []
    for number, line in enumerate(text.split("\n"), 1):
        m = re.match(r"\s*#\s*(ifdef|ifndef|if|elif|else|endif)\b(.*)", line)
        outer_off = any(s[0] is False for s in (stack[:-1] if m and m[1] in ("elif", "else", "endif") else stack))
        if m:
            word, rest = m[1], m[2].strip()
            if word in ("if", "ifdef", "ifndef"):
                state = evaluate(rest if word == "if" else f"defined({rest.split()[0] if rest else ''})", macros)
                if word == "ifndef" and state is not None:
                    state = not state
                stack.append([state, state is True, state is None])
            elif stack and word in ("elif", "else"):
                _, sure, maybe = stack[-1]
                state = False if sure else True if word == "else" else evaluate(rest, macros)
                if maybe and state is True:
                    state = None
                stack[-1] = [state, sure or state is True, maybe or state is None]
            elif stack and word == "endif":
                stack.pop()
            if outer_off:
                off.append(number)
        elif any(s[0] is False for s in stack):
            off.append(number)
    return off


FUNCTIONS = "array<struct<name:string,line:int,n_tokens:int,body:string,abstract:string>>"


def function_rows(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``path, name, line, n_tokens, exact, abstract``: a row per function, hashes of its tokens with and without names.

    Equal contents are analysed once and joined back by their digest.
    """

    def extract(batches):
        for b in batches:
            rows = []
            for x in b.column("text"):
                found = functions(x.as_py() or "")
                rows.append([{"name": f["name"], "line": f["line"], "n_tokens": len(f["tokens"]), "body": " ".join(f["tokens"]), "abstract": " ".join(a) if (a := abstract(f["tokens"])) else None} for f in found])
            yield pa.RecordBatch.from_arrays([b.column("sha"), pa.array(rows, pa.list_(pa.struct([("name", pa.string()), ("line", pa.int32()), ("n_tokens", pa.int32()), ("body", pa.string()), ("abstract", pa.string())])))], ["sha", "functions"])

    keyed = files.select(F.col(path).alias("path"), F.col(text).alias("text"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("sha"))
    once = keyed.dropDuplicates(["sha"]).select("sha", "text").mapInArrow(extract, f"sha string, functions {FUNCTIONS}")
    rows = once.select("sha", F.explode("functions").alias("f"))
    hashed = rows.select("sha", "f.name", "f.line", "f.n_tokens", F.sha2("f.body", 256).alias("exact"), F.sha2("f.abstract", 256).alias("abstract"))
    return keyed.select("path", "sha").join(hashed, "sha").drop("sha")
