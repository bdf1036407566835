"""Advisory feeds as tables: NVD and OSV records, exploited-vulnerability lists and exploit scores."""

from __future__ import annotations

import bz2
import gzip
import io
import json
import lzma
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.identity import cpe_key, purl_key

_MATCH = "struct<vulnerable:boolean,criteria:string,versionStartIncluding:string,versionStartExcluding:string,versionEndIncluding:string,versionEndExcluding:string>"
_CVSS = "array<struct<cvssData:struct<baseScore:double,baseSeverity:string,vectorString:string>,baseSeverity:string>>"
CVE = f"struct<id:string,descriptions:array<struct<lang:string,value:string>>,metrics:struct<cvssMetricV31:{_CVSS},cvssMetricV30:{_CVSS},cvssMetricV40:{_CVSS},cvssMetricV2:{_CVSS}>,references:array<struct<url:string>>,configurations:array<struct<nodes:array<struct<cpeMatch:array<{_MATCH}>>>>>>"
_EVENT = "struct<introduced:string,fixed:string,last_affected:string,limit:string>"
OSV = f"id string, summary string, details string, aliases array<string>, upstream array<string>, severity array<struct<type:string,score:string>>, affected array<struct<package:struct<purl:string,ecosystem:string,name:string>,ranges:array<struct<type:string,repo:string,events:array<{_EVENT}>>>,versions:array<string>>>"


# Fixed: the arrays that hold the records of 2.0 files, of 1.1 files and of mirrors of single records.
_ARRAYS = ("vulnerabilities", "CVE_Items", "cve_items")
_OPENERS = {".xz": lzma.open, ".gz": gzip.open, ".bz2": bz2.open}


def _unpacked(path: str, content: bytes) -> io.TextIOBase:
    """The text of a file as a stream, unpacked by its suffix."""
    opener = next((f for s, f in _OPENERS.items() if path.lower().endswith(s)), None)
    raw = opener(io.BytesIO(content)) if opener else io.BytesIO(content)
    return io.TextIOWrapper(raw, "utf-8-sig", errors="replace")


def records(stream: io.TextIOBase, names: tuple[str, ...] = _ARRAYS, size: int = 1 << 20) -> Iterator[tuple[str, dict]]:
    """``array, record`` of the first array of those names, a record at a time; the file is never held as a whole. A file that breaks off raises."""
    start = re.compile(rf'"({"|".join(names)})"\s*:\s*\[')
    text = ""
    while not (m := start.search(text)):
        if not (more := stream.read(size)):
            return
        text += more
    name, at, decoder = m[1], m.end(), json.JSONDecoder()
    while True:
        while at < len(text) and (text[at].isspace() or text[at] == ","):
            at += 1
        if at < len(text):
            if text[at] == "]":
                return
            try:
                record, at = decoder.raw_decode(text, at)
                yield name, record
                continue
            except json.JSONDecodeError:
                pass
        # a record may be longer than a piece: the pieces grow, so that it is not read over and over
        more = stream.read(max(size, len(text) - at))
        if not more:
            raise ValueError(f"the file breaks off inside {name}")
        text, at = text[at:] + more, 0


def _legacy(item: dict) -> dict:
    """A record of a 1.1 file in the shape of 2.0; nested nodes become flat, as only their matches are read."""
    cve, impact = item.get("cve") or {}, item.get("impact") or {}
    nodes, waiting = [], list((item.get("configurations") or {}).get("nodes") or [])
    while waiting:
        node = waiting.pop(0)
        waiting += node.get("children") or []
        nodes.append({"cpeMatch": [{**m, "criteria": m.get("cpe23Uri") or m.get("cpe22Uri")} for m in node.get("cpe_match") or []]})
    v3, v2 = impact.get("baseMetricV3") or {}, impact.get("baseMetricV2") or {}
    metrics = {}
    if v3.get("cvssV3"):
        metrics["cvssMetricV30" if v3["cvssV3"].get("version") == "3.0" else "cvssMetricV31"] = [{"cvssData": v3["cvssV3"]}]
    if v2.get("cvssV2"):
        metrics["cvssMetricV2"] = [{"cvssData": v2["cvssV2"], "baseSeverity": v2.get("severity")}]
    return {
        "id": (cve.get("CVE_data_meta") or {}).get("ID"), "descriptions": (cve.get("description") or {}).get("description_data") or [],
        "references": (cve.get("references") or {}).get("reference_data") or [], "metrics": metrics, "configurations": [{"nodes": nodes}],
    }


def _per_file(spark: SparkSession, path: str, name: str, f) -> DataFrame:
    """A column ``name`` of the strings that ``f(path, content)`` yields; a file is a task, its text is streamed in batches."""

    def run(batches):
        for b in batches:
            for p, content in zip(b.column("path"), b.column("content"), strict=True):
                held: list[str] = []
                for x in f(p.as_py(), content.as_py()):
                    held.append(x)
                    if len(held) == 1000:
                        yield pa.RecordBatch.from_pydict({name: held})
                        held = []
                if held:
                    yield pa.RecordBatch.from_pydict({name: held})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, f"{name} string")


def _cves(path: str, content: bytes) -> Iterator[str]:
    for name, x in records(_unpacked(path, content)):
        yield json.dumps(_legacy(x) if name == "CVE_Items" else x.get("cve") if name == "vulnerabilities" else x)


def read_nvd(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of NVD 2.0 and 1.1 files and mirrors of them (plain, xz, gzip or bzip2), with the best score: 3.1, 3.0, 4.0, then 2.

    A file without records gives none.
    """
    cve = _per_file(spark, path, "json", _cves).select(F.from_json("json", CVE).alias("v")).select("v.*")
    first = lambda k: F.try_element_at(F.col(f"metrics.{k}"), F.lit(1))
    order = ("cvssMetricV31", "cvssMetricV30", "cvssMetricV40", "cvssMetricV2")
    return cve.select(
        F.col("id").alias("advisory_id"), F.coalesce(*[first(k)["cvssData"]["baseScore"] for k in order]).alias("cvss"),
        F.lower(F.coalesce(*[F.coalesce(first(k)["cvssData"]["baseSeverity"], first(k)["baseSeverity"]) for k in order])).alias("severity"),
        F.try_element_at(F.filter("descriptions", lambda d: d["lang"] == "en"), F.lit(1))["value"].alias("summary"), "configurations",
    )


def nvd_ranges(records: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """``advisory_id, key, introduced, start_excluding, fixed, last_affected`` of vulnerable CPE matches; ``wanted(key)`` keeps only those products."""
    m = records.select("advisory_id", F.explode("configurations").alias("c")).select("advisory_id", F.explode("c.nodes").alias("n")).select("advisory_id", F.explode("n.cpeMatch").alias("m")).filter("m.vulnerable")
    version = F.try_element_at(F.split("m.criteria", r"(?<!\\):"), F.lit(6))
    exact = F.when(~version.isin("*", "-"), version)
    out = m.select("advisory_id", cpe_key(F.col("m.criteria")).alias("key"), F.coalesce("m.versionStartIncluding", exact).alias("introduced"), F.col("m.versionStartExcluding").alias("start_excluding"), F.col("m.versionEndExcluding").alias("fixed"), F.coalesce("m.versionEndIncluding", exact).alias("last_affected"))
    return out.join(wanted, "key", "left_semi") if wanted is not None else out


def read_osv(spark: SparkSession, path: str) -> DataFrame:
    """One row per OSV record, from files of one record or of a list."""
    return spark.read.schema(OSV).json(path, multiLine=True).withColumn("aliases", F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("upstream", F.array().cast("array<string>"))))


def intervals(events: Column) -> Column:
    """Events in order as ``array<struct<introduced, fixed, last_affected>>``; an introduction without an end stays open."""
    empty = F.array().cast("array<struct<introduced:string,fixed:string,last_affected:string>>")
    none = F.lit(None).cast("string")
    interval = lambda i, f, l: F.struct(i.alias("introduced"), f.alias("fixed"), l.alias("last_affected"))  # noqa: E731, E741
    state = F.struct(none.alias("open"), empty.alias("done"))

    def step(s: Column, e: Column) -> Column:
        ends = F.coalesce(e["fixed"], e["last_affected"], e["limit"]).isNotNull() & s["open"].isNotNull()
        closed = F.concat(s["done"], F.array(interval(s["open"], F.coalesce(e["fixed"], e["limit"]), e["last_affected"])))
        return F.when(e["introduced"].isNotNull(), F.struct(e["introduced"].alias("open"), F.when(s["open"].isNotNull(), F.concat(s["done"], F.array(interval(s["open"], none, none)))).otherwise(s["done"]).alias("done"))).when(ends, F.struct(none.alias("open"), closed.alias("done"))).otherwise(s)

    return F.aggregate(events, state, step, lambda s: F.when(s["open"].isNotNull(), F.concat(s["done"], F.array(interval(s["open"], none, none)))).otherwise(s["done"]))


def osv_ranges(records: DataFrame) -> DataFrame:
    """``advisory_id, key, kind, intervals, tags``: version intervals, or the tags of ranges that only commits bound."""
    a = records.select(F.col("id").alias("advisory_id"), F.explode("affected").alias("a")).select("advisory_id", purl_key(F.col("a.package.purl")).alias("key"), F.col("a.versions").alias("tags"), F.explode_outer("a.ranges").alias("r"))
    return a.select("advisory_id", "key", F.when(F.col("r.type").isNull(), "EXACT").otherwise(F.col("r.type")).alias("kind"), F.when(F.col("r.type").isNotNull() & (F.col("r.type") != "GIT"), intervals(F.col("r.events"))).alias("intervals"), "tags")


def read_kev(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("cveID string, dateAdded date, knownRansomwareCampaignUse string").json(path).select(F.col("cveID").alias("id"), F.lit(True).alias("kev"), "dateAdded")


def read_epss(spark: SparkSession, path: str) -> DataFrame:
    """``id, epss, percentile`` of scores as CSV, packed or not; lines that are no score (notes, the header) are left out."""
    rows = _per_file(spark, path, "line", lambda p, content: (x.rstrip("\r\n") for x in _unpacked(p, content)))
    cell = lambda k: F.trim(F.get(F.split("line", ","), F.lit(k)))
    out = rows.filter(~F.col("line").startswith("#")).select(cell(0).alias("id"), cell(1).try_cast("double").alias("epss"), cell(2).try_cast("double").alias("percentile"))
    return out.filter("epss is not null")


def read_cn_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Chinese advisory tables as CSV; ``encoding`` may be GBK. Entries without a CVE id are kept with a null one."""
    t = spark.read.csv(path, header=True, encoding=encoding, multiLine=True, escape='"')
    names = {c: c.lstrip("﻿").strip().lower() for c in t.columns}
    t = t.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return t.withColumn("cve", F.nullif(F.regexp_extract(F.concat_ws(" ", *[F.col(f"`{n}`") for n in names.values()]), r"(CVE-\d{4}-\d{4,})", 1), F.lit("")))


def read_cn_xml(spark: SparkSession, path: str, row: str = "entry") -> DataFrame:
    return spark.read.format("xml").option("rowTag", row).load(path)
