"""Exchange documents as ordered lines that Spark writes: the parts of the written text, one after the other, are the document.

Entries are never gathered on the driver. Equal rows and ``epoch`` give equal bytes; equal entries of a document are written once.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.documents import OPENVEX, stamp


def lines(pieces: list[str | DataFrame], separator: str = ",") -> DataFrame:
    """``line`` of fixed texts and tables of one ``json`` column, in the order given; rows of a table are sorted and separated."""
    spark = next(p for p in pieces if isinstance(p, DataFrame)).sparkSession
    fixed = spark.createDataFrame([(k, "", p) for k, p in enumerate(pieces) if isinstance(p, str)], "piece int, entry string, line string")
    for k, p in enumerate(pieces):
        if isinstance(p, str):
            continue
        entries = p.select("json").filter("json is not null").distinct()
        first = entries.agg(F.min("json")).first()[0]
        line = F.when(F.col("json") == first, F.col("json")).otherwise(F.concat(F.lit(separator), F.col("json")))
        fixed = fixed.unionByName(entries.select(F.lit(k).alias("piece"), F.col("json").alias("entry"), line.alias("line")))
    return fixed.orderBy("piece", "entry").select("line")


def write(document: DataFrame, path: str) -> None:
    document.write.mode("overwrite").text(path)


def _head(fields: dict, array: str) -> str:
    """The start of an object up to the opened ``array``."""
    return json.dumps(fields, sort_keys=True)[:-1] + f', "{array}": ['


def _id(kind: str, *parts: str) -> Column:
    """A name made of the content, so that it is the same in every run."""
    return F.concat(F.lit(f"urn:tessera:{kind}:"), F.sha2(F.to_json(F.array(*[F.coalesce(F.col(p), F.lit("")) for p in parts])), 256))


def _nothing() -> Column:
    return F.lit(None).cast("string")


def spdx3(components: DataFrame, depends: DataFrame, name: str, epoch: int | None = None) -> DataFrame:
    """SPDX 3.0.1 as JSON-LD. ``components(name, version, purl)``, ``depends(purl, on)``; dependencies on what is no component are left out."""
    made = "_:creation"
    info = {"@id": made, "type": "CreationInfo", "specVersion": "3.0.1", "created": stamp(epoch), "createdBy": ["urn:tessera:agent"]}
    agent = {"type": "SoftwareAgent", "spdxId": "urn:tessera:agent", "creationInfo": made, "name": "tessera"}
    document = {"type": "SpdxDocument", "spdxId": f"urn:tessera:document:{name}", "creationInfo": made, "name": name, "profileConformance": ["core", "software"]}
    packages = components.withColumn("id", _id("package", "name", "version", "purl"))
    fields = [F.lit("software_Package").alias("type"), F.col("id").alias("spdxId"), F.lit(made).alias("creationInfo"), "name", F.col("version").alias("software_packageVersion"), F.col("purl").alias("software_packageUrl")]
    ids = packages.filter("purl is not null").groupBy("purl").agg(F.min("id").alias("id"))
    links = depends.join(ids, "purl").withColumnRenamed("id", "from").join(ids.select(F.col("purl").alias("on"), F.col("id").alias("to")), "on")
    link = [F.lit("Relationship").alias("type"), _id("relationship", "from", "to").alias("spdxId"), F.lit(made).alias("creationInfo"), "from", F.lit("dependsOn").alias("relationshipType"), F.array("to").alias("to")]
    elements = packages.select(F.to_json(F.struct(*fields)).alias("json")).unionByName(links.select(F.to_json(F.struct(*link)).alias("json")))
    fixed = elements.sparkSession.createDataFrame([(json.dumps(x, sort_keys=True),) for x in (info, agent, document)], "json string")
    return lines([_head({"@context": "https://spdx.org/rdf/3.0.1/spdx-context.jsonld"}, "@graph"), fixed.unionByName(elements), "]}"])


def cyclonedx_vex(states: DataFrame, epoch: int | None = None) -> DataFrame:
    """A CycloneDX 1.6 VEX of ``vuln_key, purl, state, cvss, detail``: an entry per vulnerability and product; states are CycloneDX's own."""
    state = F.col("state")
    analysis = F.struct(state.alias("state"), F.when(state == "not_affected", "code_not_present").alias("justification"), F.col("detail").alias("detail"))
    ratings = F.when(F.col("cvss").isNotNull(), F.array(F.struct(F.col("cvss").alias("score"), F.lit("CVSSv3").alias("method"))))
    entry = F.struct(F.col("vuln_key").alias("id"), ratings.alias("ratings"), analysis.alias("analysis"), F.array(F.struct(F.col("purl").alias("ref"))).alias("affects"))
    fields = {"bomFormat": "CycloneDX", "specVersion": "1.6", "version": 1, "metadata": {"timestamp": stamp(epoch)}}
    return lines([_head(fields, "vulnerabilities"), states.select(F.to_json(entry).alias("json")), "]}"])


# Fixed: product states of CSAF by those of OpenVEX.
CSAF = {"affected": "known_affected", "under_investigation": "under_investigation", "not_affected": "known_not_affected", "fixed": "fixed"}


def csaf(states: DataFrame, publisher: str, namespace: str, epoch: int | None = None) -> DataFrame:
    """A CSAF 2.0 VEX of ``vuln_key, purl, state, detail``: an entry per vulnerability and product.

    The profile wants what is to be done about affected products and why others are not; an unknown state is under investigation.
    """
    when = stamp(epoch)
    rows = states.select("vuln_key", "purl", "state", "detail").withColumn("product", _id("product", "purl"))
    said = F.lit("under_investigation")
    for k, v in OPENVEX.items():
        said = F.when(F.col("state") == k, CSAF[v]).otherwise(said)
    rows = rows.withColumn("said", said)
    product = F.array("product")
    status = F.struct(*[F.when(F.col("said") == s, product).alias(s) for s in CSAF.values()])
    known = F.upper("vuln_key").rlike("^CVE-[0-9]{4}-[0-9]{4,}$")
    entry = F.struct(
        F.when(known, F.upper("vuln_key")).alias("cve"),
        F.when(~known, F.array(F.struct(F.lit("advisory").alias("system_name"), F.col("vuln_key").alias("text")))).alias("ids"),
        F.array(F.struct(F.lit("details").alias("category"), F.coalesce(F.col("detail"), F.lit("No detail.")).alias("text"))).alias("notes"),
        status.alias("product_status"),
        F.when(F.col("said") == "known_not_affected", F.array(F.struct(F.lit("vulnerable_code_not_present").alias("label"), product.alias("product_ids")))).alias("flags"),
        F.when(F.col("said") == "known_affected", F.array(F.struct(F.lit("none_available").alias("category"), F.lit("No remedy is recorded.").alias("details"), product.alias("product_ids")))).alias("remediations"),
    )
    names = F.struct(F.col("purl").alias("name"), F.col("product").alias("product_id"), F.struct(F.col("purl").alias("purl")).alias("product_identification_helper"))
    tracking = {"id": f"{publisher}-vex", "status": "final", "version": "1", "initial_release_date": when, "current_release_date": when, "revision_history": [{"date": when, "number": "1", "summary": "First issue"}]}
    document = {"category": "csaf_vex", "csaf_version": "2.0", "title": f"VEX of {publisher}", "publisher": {"category": "vendor", "name": publisher, "namespace": namespace}, "tracking": tracking}
    return lines([f'{{"document": {json.dumps(document, sort_keys=True)}, "product_tree": {{"full_product_names": [', rows.select(F.to_json(names).alias("json")), ']}, "vulnerabilities": [', rows.select(F.to_json(entry).alias("json")), "]}"])


def _bom(entries: DataFrame, epoch: int | None) -> DataFrame:
    return lines([_head({"bomFormat": "CycloneDX", "specVersion": "1.6", "version": 1, "metadata": {"timestamp": stamp(epoch)}}, "components"), entries, "]}"])


def _property(name: str, value: Column) -> Column:
    return F.struct(F.lit(f"tessera:{name}").alias("name"), value.cast("string").alias("value"))


def cyclonedx(components: DataFrame, depends: DataFrame, epoch: int | None = None) -> DataFrame:
    """A CycloneDX 1.6 bill with evidence, pedigree and the graph of dependencies.

    ``components(ref, name, version, purl, cpe, licence, confidence, technique, paths, ancestor, patched)``: ``paths`` are occurrences, ``ancestor``
    is the purl of the release that a changed copy comes from. ``depends(ref, on)`` makes an entry per edge, so that a component on which
    half of the bill rests is no single large row; edges from or to what is no component are left out, and nulls are not written.
    """
    one = lambda x: F.array(F.struct(*x))
    method = one([F.col("technique").alias("technique"), F.col("confidence").alias("confidence")])
    identity = F.when(F.col("confidence").isNotNull(), one([F.lit("name").alias("field"), F.col("confidence").alias("confidence"), method.alias("methods")]))
    seen = F.when(F.size("paths") > 0, F.transform(F.array_sort("paths"), lambda p: F.struct(p.alias("location"))))
    evidence = F.when(identity.isNotNull() | seen.isNotNull(), F.struct(identity.alias("identity"), seen.alias("occurrences")))
    upstream = one([F.lit("library").alias("type"), F.col("name").alias("name"), F.col("ancestor").alias("purl")])
    pedigree = F.when(F.col("ancestor").isNotNull(), F.struct(upstream.alias("ancestors"), F.when(F.col("patched"), one([F.lit("unofficial").alias("type")])).alias("patches")))
    licences = F.when(F.col("licence").isNotNull(), one([F.col("licence").alias("expression")]))
    entry = F.struct(F.lit("library").alias("type"), F.col("ref").alias("bom-ref"), "name", "version", "purl", "cpe", licences.alias("licenses"), pedigree.alias("pedigree"), evidence.alias("evidence"))
    known = components.select("ref").filter("ref is not null").distinct()
    edges = depends.join(known, "ref", "left_semi").join(known.select(F.col("ref").alias("on")), "on", "left_semi")
    edge = F.struct("ref", F.array("on").alias("dependsOn"))
    head = _head({"bomFormat": "CycloneDX", "specVersion": "1.6", "version": 1, "metadata": {"timestamp": stamp(epoch)}}, "components")
    return lines([head, components.select(F.to_json(entry).alias("json")), '], "dependencies": [', edges.select(F.to_json(edge).alias("json")), "]}"])


def cbom(assets: DataFrame, epoch: int | None = None) -> DataFrame:
    """A bill of the cryptography in use, of ``family, class, files, hits, first`` as the inventory has them."""
    seen = F.array(F.struct(F.col("first").alias("location")))
    entry = F.struct(
        F.lit("cryptographic-asset").alias("type"), F.concat(F.lit("crypto:"), F.col("family")).alias("bom-ref"), F.col("family").alias("name"),
        F.struct(F.lit("algorithm").alias("assetType")).alias("cryptoProperties"), F.struct(seen.alias("occurrences")).alias("evidence"),
        F.array(_property("class", F.col("class")), _property("files", F.col("files")), _property("hits", F.col("hits"))).alias("properties"),
    )
    return _bom(assets.select(F.to_json(entry).alias("json")), epoch)


def aibom(models: DataFrame, epoch: int | None = None) -> DataFrame:
    """A bill of the models shipped, of ``path, format, sha256, name, version, licence, architecture``; what is not known is left out."""
    licence = F.when(F.col("licence").isNotNull(), F.array(F.struct(F.struct(F.col("licence").alias("name")).alias("license"))))
    card = F.when(F.col("architecture").isNotNull(), F.struct(F.struct(F.col("architecture").alias("modelArchitecture")).alias("modelParameters")))
    entry = F.struct(
        F.lit("machine-learning-model").alias("type"), F.concat(F.lit("model:"), F.col("path")).alias("bom-ref"), F.coalesce(F.col("name"), F.element_at(F.split("path", "/"), -1)).alias("name"),
        "version", licence.alias("licenses"), F.when(F.col("sha256").isNotNull(), F.array(F.struct(F.lit("SHA-256").alias("alg"), F.col("sha256").alias("content")))).alias("hashes"),
        card.alias("modelCard"), F.array(_property("format", F.col("format"))).alias("properties"),
    )
    return _bom(models.select(F.to_json(entry).alias("json")), epoch)


def markdown(rows: DataFrame, columns: list[str], title: str) -> DataFrame:
    """A heading and a table of ``columns``, sorted; bars and line breaks inside cells are escaped, nulls are empty."""
    cell = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"([\\|])", r"\\$1"), r"\R", "<br>")
    body = rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |")).alias("json"))
    return lines([f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + "-|" * len(columns), body], separator="")
