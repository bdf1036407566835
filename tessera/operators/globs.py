"""Paths against many globs: an index by what a glob says literally, and its pattern only where that is met."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed: characters of a pattern that are not themselves.
WILD = r"[*?\[]"
_ESCAPED = r"([.+^$(){}|\\])"


def glob_pattern(glob: Column) -> Column:
    """The anchored regular expression of a glob: ``**/`` any folders, ``**`` anything, ``*`` and ``?`` inside one name, ``[...]`` a set."""
    out = F.regexp_replace(glob, _ESCAPED, r"\\$1")
    # signs that no path has stand for what is done, so that later steps leave it alone
    for old, new in (("**/", "\x01"), ("**", "\x02"), ("*", "[^/]*"), ("?", "[^/]"), ("[!", "[^"), ("\x01", "([^/]+/)*"), ("\x02", ".*")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.concat(F.lit("^"), out, F.lit("$"))


def glob_key(glob: Column) -> Column:
    """``kind, word``: the most telling literal of a glob: its whole last name, else all of it but one sign at its end, else the longest of its folders, else what follows its last dot, else nothing."""
    parts = F.split(glob, "/")
    last = F.element_at(parts, -1)
    plain = F.filter(F.slice(parts, 1, F.size(parts) - 1), lambda x: ~x.rlike(WILD) & (x != ""))
    longest = F.element_at(F.array_sort(F.transform(plain, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("w")))), 1)["w"]
    end = F.substring_index(last, ".", -1)
    key = lambda kind, word: F.struct(F.lit(kind).alias("kind"), word.alias("word"))
    return F.when(~last.rlike(WILD), key("name", last)).when(last.rlike(r"^[^*?\[]*\?$"), key("stem", F.regexp_replace(last, r"\?$", ""))).when(F.size(plain) > 0, key("folder", longest)).when(F.contains(last, F.lit(".")) & ~end.rlike(WILD), key("end", end)).otherwise(key("any", F.lit("")))


def path_keys(path: Column) -> Column:
    """Every key under which a glob that matches ``path`` can be."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    key = lambda kind, word: F.struct(F.lit(kind).alias("kind"), word.alias("word"))
    folders = F.transform(F.array_distinct(F.slice(parts, 1, F.size(parts) - 1)), lambda x: key("folder", x))
    ends = F.when(F.contains(last, F.lit(".")), F.array(key("end", F.substring_index(last, ".", -1)))).otherwise(F.expr("cast(array() as array<struct<kind:string,word:string>>)"))
    return F.concat(F.array(key("name", last), key("stem", F.substring(last, F.lit(1), F.length(last) - 1)), key("any", F.lit(""))), folders, ends)


def matched(paths: DataFrame, globs: DataFrame) -> DataFrame:
    """``<paths>, <globs>`` where ``globs(glob, ...)`` matches ``paths(path, ...)``; rows meet by equal keys, and patterns run on those alone.

    A glob has one key and a path each key once, so a pair meets once. Repeated globs and paths are met each time: give different ones
    where only a count is asked.
    """
    a = paths.withColumn("_k", F.explode(path_keys(F.col("path"))))
    b = globs.withColumn("_k", glob_key(F.col("glob"))).withColumn("_p", glob_pattern(F.col("glob")))
    return a.join(b, "_k").filter(F.rlike(F.col("path"), F.col("_p"))).drop("_k", "_p")
