"""Bills of materials and exchange documents, in and out; documents out are small ones, as texts (``exchange`` writes those of any size)."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.identity import cpe_key, purl_key

_COMPONENT = "type:string,name:string,version:string,purl:string,cpe:string,licenses:array<struct<license:struct<id:string,name:string>,expression:string>>,properties:array<struct<name:string,value:string>>"
CYCLONEDX = f"bomFormat string, specVersion string, components array<struct<{_COMPONENT}>>"


def read_cyclonedx(spark: SparkSession, path: str) -> DataFrame:
    """``component, version, cpes, purls, properties`` of each component."""
    c = spark.read.schema(CYCLONEDX).json(path, multiLine=True).select(F.explode("components").alias("c")).select("c.*")
    properties = F.map_from_entries(F.transform(F.coalesce("properties", F.array().cast("array<struct<name:string,value:string>>")), lambda p: F.struct(p["name"], p["value"])))
    return c.select(F.col("name").alias("component"), "version", F.array_compact(F.array("cpe")).alias("cpes"), F.array_compact(F.array("purl")).alias("purls"), properties.alias("properties"), "licenses")


def channel_keys(candidates: DataFrame) -> DataFrame:
    """``component, version, channel, key``: the product keys by which advisories reach a component."""
    rows = lambda column, channel, key: candidates.select("component", "version", F.lit(channel).alias("channel"), F.explode(column).alias("x")).select("component", "version", "channel", key(F.col("x")).alias("key"))
    return rows("cpes", "cpe", cpe_key).unionByName(rows("purls", "purl", purl_key)).filter("key is not null").distinct()


def cyclonedx_components(components: DataFrame) -> DataFrame:
    """One JSON object per component: the distributed part of a document."""
    fields = F.struct(F.lit("library").alias("type"), F.col("name"), F.col("version"), F.col("purl"), F.col("cpe"))
    return components.select(F.to_json(fields).alias("json"))


def stamp(epoch: int | None) -> str:
    return datetime.fromtimestamp(epoch or 0, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def cyclonedx(components: DataFrame, epoch: int | None = None) -> str:
    """A CycloneDX 1.6 document; byte-identical for equal rows and ``epoch``. A document is one value on the driver by nature."""
    rows = sorted((r["json"] for r in cyclonedx_components(components).collect()))
    return json.dumps({"bomFormat": "CycloneDX", "specVersion": "1.6", "version": 1, "metadata": {"timestamp": stamp(epoch)}, "components": [json.loads(r) for r in rows]}, indent=2, sort_keys=True)


def spdx(components: DataFrame, name: str, epoch: int | None = None) -> str:
    """An SPDX 2.3 document."""
    rows = sorted((r.asDict() for r in components.select("name", "version", "purl").collect()), key=lambda r: (r["name"], r["version"] or ""))
    packages = [
        {"SPDXID": f"SPDXRef-{k}", "name": r["name"], "versionInfo": r["version"] or "NOASSERTION", "downloadLocation": "NOASSERTION", "filesAnalyzed": False}
        | ({"externalRefs": [{"referenceCategory": "PACKAGE-MANAGER", "referenceType": "purl", "referenceLocator": r["purl"]}]} if r["purl"] else {})
        for k, r in enumerate(rows, 1)
    ]
    return json.dumps({"spdxVersion": "SPDX-2.3", "dataLicense": "CC0-1.0", "SPDXID": "SPDXRef-DOCUMENT", "name": name, "documentNamespace": f"urn:{name}", "creationInfo": {"created": stamp(epoch), "creators": ["Tool: tessera"]}, "packages": packages}, indent=2, sort_keys=True)


# Fixed: states of exchange formats.
OPENVEX = {"exploitable": "affected", "in_triage": "under_investigation", "not_affected": "not_affected", "resolved": "fixed", "false_positive": "not_affected"}


def openvex_status(state: Column) -> Column:
    out = F.lit("under_investigation")
    for k, v in OPENVEX.items():
        out = F.when(state == k, v).otherwise(out)
    return out


def openvex(states: DataFrame, author: str, epoch: int | None = None) -> str:
    """An OpenVEX 0.2.0 document from ``vuln_key, purl, state``, one per product and vulnerability."""
    rows = sorted((r.asDict() for r in states.select("vuln_key", "purl", openvex_status(F.col("state")).alias("status")).distinct().collect()), key=lambda r: (r["vuln_key"], r["purl"]))
    said = [{"vulnerability": {"name": r["vuln_key"]}, "products": [{"@id": r["purl"]}], "status": r["status"]} | ({"justification": "vulnerable_code_not_present"} if r["status"] == "not_affected" else {}) for r in rows]
    return json.dumps({"@context": "https://openvex.dev/ns/v0.2.0", "@id": f"urn:vex:{author}", "author": author, "timestamp": stamp(epoch), "version": 1, "statements": said}, indent=2, sort_keys=True)
