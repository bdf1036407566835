"""Composed rows: loose files into groups, declarations onto findings, merged bills of materials, minimum elements."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed: what counts as absent, and the confidence of a declaration.
PLACEHOLDERS = ("", "noassertion", "none", "unknown", "n/a", "na", "-", "null")
DECLARED = 0.90


def present(value: Column) -> Column:
    return F.coalesce(~F.lower(F.trim(value)).isin(*PLACEHOLDERS), F.lit(False))


def minimum_elements(components: DataFrame) -> DataFrame:
    """``standard, element, passed, total, share`` of component elements, old and new list.

    ``components`` has ``name, version, supplier, purl, cpe, hashes, licenses`` (the last two arrays).
    """
    identifier = present(F.col("purl")) | present(F.col("cpe"))
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    common = {"name": present(F.col("name")), "version": present(F.col("version")), "identifier": identifier, "supplier": present(F.col("supplier"))}
    lists = {"ntia-2021": common, "cisa-2026": common | {"hash": some("hashes"), "license": some("licenses")}}
    checks = [(s, e, c) for s, x in lists.items() for e, c in x.items()]
    wide = components.agg(F.count("*").alias("total"), *[F.count_if(c).alias(f"c{k}") for k, (_, _, c) in enumerate(checks)])
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("standard"), F.lit(e).alias("element"), F.col(f"c{k}").alias("passed")) for k, (s, e, _) in enumerate(checks)]))
    return wide.select("total", rows.alias("x")).select("x.standard", "x.element", "x.passed", "total", F.when(F.col("total") > 0, F.col("x.passed") / F.col("total")).otherwise(0.0).alias("share"))


# Fixed: the elements of both standards by what they are asked of; the second renames those of the first and adds to them.
ELEMENTS = {
    "ntia-2021": {"component": ("supplier", "name", "version", "identifier"), "document": ("dependency", "author", "timestamp")},
    "cisa-2026": {"component": ("supplier", "name", "version", "identifier", "hash", "license"), "document": ("dependency", "author", "timestamp", "tool", "context", "format")},
}


def bill_elements(components: DataFrame, bills: DataFrame) -> DataFrame:
    """``bill, standard, element, level, passed, total``: all nineteen checks of each of ``bills``.

    ``components(bill, name, version, supplier, purl, cpe, hashes, licenses)``; ``bills(bill, dependencies, authors, tools array<struct<name,version>>,
    timestamp, context, format, spec_version)``.  Elements of a document pass once or not at all; a bill without components has none that pass.
    """
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    of_component = {"supplier": present(F.col("supplier")), "name": present(F.col("name")), "version": present(F.col("version")), "identifier": present(F.col("purl")) | present(F.col("cpe")), "hash": some("hashes"), "license": some("licenses")}
    counts = components.groupBy("bill").agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in of_component.items()])
    full_tool = F.exists("tools", lambda t: present(t["name"]) & present(t["version"]))
    of_document = {
        "dependency": F.col("dependencies") > 0,
        "author": some("authors") | some("tools"),
        "timestamp": present(F.col("timestamp")),
        "tool": full_tool,
        "context": present(F.col("context")),
        "format": present(F.col("format")) & present(F.col("spec_version")),
    }
    said = bills.select("bill", *[F.coalesce(c, F.lit(False)).cast("long").alias(n) for n, c in of_document.items()])
    both = said.join(counts, "bill", "left").fillna(0, ["total", *of_component])
    rows = [F.struct(F.lit(s).alias("standard"), F.lit(e).alias("element"), F.lit(level).alias("level"), F.col(e).alias("passed"), (F.col("total") if level == "component" else F.lit(1).cast("long")).alias("total")) for s, levels in ELEMENTS.items() for level, names in levels.items() for e in names]
    return both.select("bill", F.explode(F.array(*rows)).alias("x")).select("bill", "x.*")


def standard_score(elements: DataFrame) -> DataFrame:
    """Mean share of a standard's elements, out of ten, to one decimal (half to even)."""
    return elements.groupBy("standard").agg(F.bround(F.avg("share") * 10, 1).alias("out_of_ten"))


def with_declarations(findings: DataFrame, declared: DataFrame) -> DataFrame:
    """Full outer join on directory: a declaration of another name or version is evidence, never an overwrite.

    ``findings(directory, name, version, identity)``, ``declared(directory, name, version)``.
    """
    f = findings.select("directory", F.col("name").alias("f_name"), F.col("version").alias("f_version"), "identity")
    d = declared.select("directory", F.col("name").alias("d_name"), F.col("version").alias("d_version"))
    both = f.join(d, "directory", "full_outer")
    same = F.lower("f_name") == F.lower("d_name")
    outcome = F.when(F.col("f_name").isNull(), "declared").when(F.col("d_name").isNull(), "found").when(~same, "disputed").when(F.col("f_version").isNull(), "completed").when(F.col("d_version").isNull() | (F.col("f_version") == F.col("d_version")), "confirmed").otherwise("disagrees")
    return both.withColumn("outcome", outcome).select(
        "directory", F.coalesce("f_name", "d_name").alias("name"),
        F.when(F.col("outcome").isin("declared", "completed"), F.col("d_version")).otherwise(F.col("f_version")).alias("version"),
        F.when(F.col("outcome") == "declared", DECLARED).when(F.col("outcome").isin("confirmed", "completed"), F.greatest("identity", F.lit(DECLARED))).otherwise(F.col("identity")).alias("identity"), "outcome",
    )


def merged_boms(components: DataFrame) -> DataFrame:
    """One component per identity over several documents: the first value that is there, all properties, all sources.

    ``components(document, ordinal, ref, name, version, purl, supplier, properties map)``; identity is the purl, else name and version.
    """
    key = F.lower(F.coalesce(F.col("purl"), F.concat_ws("@", "name", F.coalesce("version", F.lit("")))))
    w = Window.partitionBy("key").orderBy("document", "ordinal").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = components.withColumn("key", key)
    first = [F.first(F.when(present(F.col(c)), F.col(c)), ignorenulls=True).over(w).alias(c) for c in ("name", "version", "purl", "supplier")]
    filled = rows.select("key", "document", "ordinal", "ref", "properties", *first, F.first("ref").over(w).alias("kept_ref"))
    entries = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.map_entries(F.coalesce("properties", F.create_map().cast("map<string,string>")))))))
    return filled.groupBy("key").agg(*[F.first(c).alias(c) for c in ("name", "version", "purl", "supplier", "kept_ref")], entries.alias("properties"), F.array_sort(F.collect_set("document")).alias("documents"), F.array_sort(F.collect_set("ref")).alias("refs"))


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Numbers of a column's values (-1: null), and the values."""
    whole = column.combine_chunks().dictionary_encode()
    whole = whole.combine_chunks() if isinstance(whole, pa.ChunkedArray) else whole
    return whole.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), whole.dictionary


def _by(key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of ``key``, and where each of its ``n`` values begins."""
    return np.argsort(key, kind="stable"), np.append(0, np.cumsum(np.bincount(key, minlength=n)))


def _assigned(table: pa.Table, named: int, unnamed: int) -> pa.Table:
    """The groups of one directory from ``owner, path, held, files, named``; a null path is all that nobody else asks for."""
    (who, names), (path, paths) = _codes(table.column("owner")), _codes(table.column("path"))
    held, files = table.column("held").to_numpy(), table.column("files").to_numpy()
    by_name = table.column("named").to_numpy().astype(np.int64)
    n = len(names)
    rows, first = _by(who, n)
    asked, begin = _by(path + 1, len(paths) + 1)
    total, count, called = (np.zeros(n, np.int64) for _ in range(3))
    for sums, x in ((total, held), (count, files), (called, by_name)):
        np.add.at(sums, who, x)
    name = names.to_pylist()
    taken = np.zeros(table.num_rows, bool)
    rank = lambda k: (0 if called[k] else 1, -int(total[k]), name[k], k)
    heap = [rank(k) for k in range(n)]
    heapq.heapify(heap)
    out = []
    while heap:
        key = heapq.heappop(heap)
        k = key[3]
        now = rank(k)
        if now != key:  # files went to others since: back to its place
            if count[k]:
                heapq.heappush(heap, now)
            continue
        if -key[1] >= (unnamed if key[0] else named):
            out.append((name[k], int(count[k]), -key[1]))
            mine = rows[first[k] : first[k + 1]]
            for p in path[mine[~taken[mine]]].tolist():
                if p >= 0:
                    rivals = asked[begin[p + 1] : begin[p + 2]]
                    rivals = rivals[~taken[rivals]]
                    taken[rivals] = True
                    for sums, x in ((total, held), (count, files), (called, by_name)):
                        np.subtract.at(sums, who[rivals], x[rivals])
    directory = table.column("directory").slice(0, 1).to_pylist() * len(out)
    columns = [directory, *(list(c) for c in zip(*out, strict=True))] if out else [[]] * 4
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["directory", "owner", "files", "functions"])


def loose_groups(claims: DataFrame, share: float = 0.80, least: int = 3, named: int = 8, unnamed: int = 40) -> DataFrame:
    """``directory, owner, files, functions``: loose files to one owner each, greedily and per directory.

    ``claims(directory, path, owner, held, own, named)``: of a file's ``own`` functions the owner has ``held``.
    A file joins at ``share`` and ``least`` functions (or by its name); owners with a named file go
    first, then the larger, then by id; a group needs ``named`` functions where a file is named after it, else ``unnamed``.
    """
    fit = claims.filter((F.col("held") >= share * F.col("own")) & ((F.col("held") >= least) | F.col("named")))

    # a path that one owner alone asks for is settled beforehand: its owner has one row for all of those
    asked = F.count("*").over(Window.partitionBy("directory", "path"))
    fit = fit.select("directory", "path", "owner", F.col("held").cast("long"), F.coalesce("named", F.lit(False)).alias("named"), (asked == 1).alias("alone"))
    alone = fit.filter("alone").groupBy("directory", "owner").agg(F.lit(None).cast("string").alias("path"), F.sum("held").alias("held"), F.count("*").alias("files"), F.max("named").alias("named"))
    claimed = fit.filter("not alone").select("directory", "owner", "path", "held", F.lit(1).cast("long").alias("files"), "named").unionByName(alone)
    # what an owner has only shrinks, so one that has too little from the start gets no group
    of = Window.partitionBy("directory", "owner")
    enough = F.sum("held").over(of) >= F.when(F.max("named").over(of), named).otherwise(unnamed)
    claimed = claimed.withColumn("_enough", enough).filter("_enough").drop("_enough")

    def assign(table: pa.Table) -> pa.Table:
        return _assigned(table, named, unnamed)

    # one directory's contested files: bounded by what a directory holds, as numbers with each name once
    return claimed.groupBy("directory").applyInArrow(assign, "directory string, owner string, files long, functions long")
