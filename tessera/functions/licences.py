"""Licence expressions, texts and compatibility as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.bind import let

# Fixed: licence classes from the least demanding, and ids of the first.
CLASSES = ("permissive", "weak", "strong", "network", "unknown")
PERMISSIVE = ("0BSD", "Apache-1.1", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "BSL-1.0", "CC0-1.0", "FTL", "ISC", "MIT", "MIT-0", "NCSA", "OpenSSL", "PSF-2.0", "Unlicense", "X11", "Zlib", "curl", "libpng-2.0")
# Fixed: what a licence asks for that others forbid, by SPDX id, and which of these cannot be met at once.
TRAITS = {
    "patent peace": r"Apache-2\.0",
    "advertising": r"OpenSSL|BSD-4-Clause",
    "own copyleft": r"CDDL.*|EPL-1\.0",
    "network copyleft": r"AGPL.*",
    "second only": r"A?GPL-2\.0-only",
    "third only": r"GPL-3\.0-only",
    "copyleft": r"A?GPL-\d\.0(?:-only|-or-later|\+)",
}
CONFLICTS = (("patent peace", "second only"), ("second only", "third only"), ("network copyleft", "second only"), ("advertising", "copyleft"), ("own copyleft", "copyleft"))
# Fixed: clauses from the licences' texts, in lower case without punctuation, by SPDX id; a text with all clauses of several
# licences is of the one whose clauses are longest together.
_BSD = "redistribution and use in source and binary forms"
CLAUSES = {
    "0BSD": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "the software is provided as is and the author disclaims all warranties"),
    "AGPL-3.0-only": ("gnu affero general public license", "remote network interaction"),
    "Apache-2.0": ("apache license", "version 2 0"),
    "BSD-2-Clause": (_BSD,),
    "BSD-3-Clause": (_BSD, "neither the name"),
    "BSD-4-Clause": (_BSD, "all advertising materials mentioning features or use of this software must display"),
    "BSL-1.0": ("boost software license version 1 0",),
    "CC0-1.0": ("cc0 1 0 universal", "affirmer"),
    "EPL-2.0": ("eclipse public license v 2 0",),
    "GPL-2.0-only": ("gnu general public license", "version 2 june 1991"),
    "GPL-3.0-only": ("gnu general public license", "version 3 29 june 2007"),
    "ISC": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "provided that the above copyright notice and this permission notice appear in all copies"),
    "LGPL-2.1-only": ("gnu lesser general public license", "version 2 1 february 1999"),
    "LGPL-3.0-only": ("gnu lesser general public license", "version 3 29 june 2007"),
    "MIT": ("permission is hereby granted free of charge to any person obtaining a copy",),
    "MPL-2.0": ("mozilla public license", "2 0"),
    "Unlicense": ("this is free and unencumbered software released into the public domain",),
    "Zlib": ("the origin of this software must not be misrepresented", "altered source versions must be plainly marked as such"),
}


def id_class(spdx: Column) -> Column:
    """Rank in ``CLASSES``."""
    base = F.regexp_replace(spdx, r"\++$", "")
    return F.when(base.isin(*PERMISSIVE), 0).when(base.startswith("AGPL"), 3).when(base.rlike("^(LGPL|MPL-|EPL-|CDDL-|EUPL-|CPL-)"), 1).when(base.startswith("GPL"), 2).otherwise(4)


def alternatives(expression: Column) -> Column:
    """OR branches, each the ids that apply together; parentheses are flattened, exceptions dropped."""
    flat = F.regexp_replace(F.regexp_replace(expression, r"[()]", " "), r"(?i)\bWITH\s+[A-Za-z0-9.+\-]+", " ")
    branches = F.transform(F.split(flat, r"(?i)(?<![A-Za-z0-9.+\-])OR(?![A-Za-z0-9.+\-])"), lambda b: F.filter(F.regexp_extract_all(b, F.lit(r"[A-Za-z0-9.+\-]+"), F.lit(0)), lambda t: F.upper(t) != "AND"))
    return F.filter(branches, lambda b: F.size(b) > 0)


def expression_class(expression: Column) -> Column:
    """The least over alternatives of the most demanding id in each."""
    rank = F.array_min(F.transform(alternatives(expression), lambda b: F.array_max(F.transform(b, id_class))))
    return F.element_at(F.array(*[F.lit(c) for c in CLASSES]), F.coalesce(rank, F.lit(4)) + 1)


def traits(spdx: Column) -> Column:
    """Which of ``TRAITS`` an id has."""
    return F.array_compact(F.array(*[F.when(spdx.rlike(f"^(?:{pattern})$"), name) for name, pattern in TRAITS.items()]))


def incompatible(a: Column, b: Column) -> Column:
    """Symmetric: can the two not be combined in one work."""

    def clash(x: Column) -> Column:
        both = F.lit(False)
        for p, q in CONFLICTS:
            has = lambda side, trait: F.array_contains(x[side], trait)  # noqa: E731, B023
            both = both | (has("a", p) & has("b", q)) | (has("b", p) & has("a", q))
        return both

    return F.when(a.isNotNull() & b.isNotNull(), let(F.struct(traits(a).alias("a"), traits(b).alias("b")), clash))


def text_licence(text: Column) -> Column:
    """SPDX id of a licence text: of the licences with all their clauses in it the most specific one, null if there is none."""

    def named(words: Column) -> Column:
        found = []
        for spdx, clauses in CLAUSES.items():
            fits = F.lit(True)
            for c in clauses:
                fits = fits & F.contains(words, F.lit(f" {c} "))
            found.append(F.when(fits, F.struct(F.lit(sum(map(len, clauses))).alias("size"), F.lit(spdx).alias("spdx"))))
        return F.array_max(F.array_compact(F.array(*found)))["spdx"]

    return let(F.concat(F.lit(" "), F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), F.lit(" ")), named)


TAG = "SPDX-License-Identifier:"


def spdx_headers(text: Column, head: int = 1024) -> Column:
    """Expressions of the lines with the SPDX tag among the first characters, without what closes the comment."""
    lines = F.filter(F.split(F.substring(text, 1, head), r"\r\n|\r|\n"), lambda x: F.contains(x, F.lit(TAG)))
    said = F.transform(lines, lambda x: F.substring_index(F.substring_index(F.substring_index(x, TAG, -1), "*", 1), "-->", 1))
    return F.filter(F.transform(said, lambda x: F.rtrim(F.trim(x), F.lit("."))), lambda x: x != "")
