"""Whose code it is and which release it names: holders, name prefixes and version macros."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.bind import let
from tessera.functions.licences import spdx_headers, text_licence

# Fixed: after "copyright", words of ordinary prose in which nobody is named.
PROSE = ("notice", "notices", "holder", "holders", "owner", "owners", "law", "laws", "statement", "statements", "information", "protection", "and", "or", "of", "in", "is", "on", "to", "for", "as", "this", "that")
# Fixed: words around a holder's name: legal forms, fillers, and the rest of the formula.
AROUND = ("c", "by", "the", "all", "rights", "reserved", "and", "or", "its", "their", "affiliates", "contributors", "authors", "author", "copyright", "inc", "ltd", "llc", "gmbh", "ag", "co", "corp", "corporation", "limited", "company")
# Fixed: first words of names that any project has.
COMMON = ("main", "init", "test", "get", "set", "is", "do", "on", "run", "static", "new")


def _lines(text: Column) -> Column:
    return F.split(text, r"\r\n|\r|\n")


def _claim(line: Column) -> Column:
    """Words of a line behind its first "copyright", in lower case, without years, addresses, and signs around them; empty for prose."""
    tail = F.regexp_replace(F.lower(line), r"^.*?copyright(?!\w)", "")
    bare = F.transform(F.split(tail, r"[\s,;]+"), lambda w: F.when(w.rlike(r"@|://|^<.*>$"), "").otherwise(F.regexp_replace(w, r"^[^a-z0-9]+|[^a-z0-9+]+$", "")))
    words = F.filter(bare, lambda w: w.rlike(r"^[a-z][a-z0-9+-]*"))
    return let(words, lambda w: F.when(F.coalesce(F.get(w, F.lit(0)).isin(*PROSE), F.lit(True)), F.array().cast("array<string>")).otherwise(w))


def holder(text: Column) -> Column:
    """At most two words of the first copyright holder, else ``license:<id>``, else null."""
    marked = F.filter(_lines(text), lambda x: F.lower(x).rlike(r"copyright(?!\w)"))
    claims = F.filter(F.transform(marked, _claim), lambda c: F.size(c) > 0)
    words = F.filter(F.get(claims, F.lit(0)), lambda w: (F.length(w) > 1) & ~w.isin(*AROUND))
    name = let(words, lambda w: F.when(F.size(w) > 0, F.array_join(F.slice(w, 1, 2), " ")))
    first = F.lower(F.get(F.split(F.get(spdx_headers(text), F.lit(0)), r"\s+"), F.lit(0)))
    return F.coalesce(name, F.concat(F.lit("license:"), F.coalesce(first, F.lower(text_licence(text)))))


def name_prefix(name: Column) -> Column:
    """What stands before the first ``_`` of a name, or before its first capital; null for a prefix that says nothing."""
    head = lambda group: F.regexp_extract(name, r"^_*(?:([A-Za-z0-9]+)_|([a-z]+)(?=[A-Z]))", group)
    prefix = F.lower(F.concat(head(1), head(2)))
    return F.when((F.length(prefix) > 1) & ~prefix.isin(*COMMON), prefix)


def version_macros(text: Column) -> Column:
    """``name=1.2.3`` for each macro that defines a dotted version in one piece; the name is without its word for version."""
    defined = F.filter(F.transform(_lines(text), lambda x: F.split(F.trim(F.regexp_replace(x, r"^\s*#\s*define\s+", "#")), r"\s+", 3)), lambda p: F.get(p, F.lit(0)).startswith("#") & (F.size(p) > 1))

    def named(p: Column) -> Column:
        whole = F.regexp_replace(F.lower(F.substr(F.get(p, F.lit(0)), F.lit(2))), "_?(?:string|str)$", "")
        value = F.regexp_extract(F.get(p, F.lit(1)), r'^"?[vV]?(\d+(?:\.\d+){1,3})', 1)
        return F.struct(whole.alias("whole"), F.regexp_replace(whole, "_*(?:version|ver)$", "").alias("name"), value.alias("value"))

    found = F.filter(F.transform(defined, named), lambda x: (x["name"] != x["whole"]) & x["name"].rlike("^[a-z]") & (x["value"] != ""))
    return F.transform(found, lambda x: F.concat(x["name"], F.lit("="), x["value"]))
