"""Queries over source texts: functions, dead lines, link maps, declarations. Rows only: SQL has no parser for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import crypto
from tessera.plans.registry import register
from tessera.session import spread, table
from tessera.sources import build, csource, declared

_C = """#include <stdio.h>
static int add(int a, int b) { int total = a + b; if (total > {n}) { total -= 1; } return total; }
#ifdef CONFIG_FAST
int run(int x) { while (x > 0) { x = add(x, -{n}); } return x; }
#else
int run(int x) { for (;;) { if (x < {n}) break; x--; } return x; }
#endif
"""
_MAP = """Discarded input sections
 .text 0x0 0x10 libnet.a(buf.o)
Linker script and memory map
 .text 0x1000 0x20 libnet.a(core.o)
 .text 0x1020 0x{n} main.o
"""
_LOCK = """[[package]]
name = "zlib-sys"
version = "1.{n}.0"
"""


def _files(spark, sf_dir, template, name, comment="// "):
    """A file for each document: its text as a comment, then code that depends on its number."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    number = F.coalesce(F.col("doc_id") % 50 + 1, F.lit(1)).cast("string")
    text = F.concat(F.lit(comment), F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n\\]+", f"\n{comment}"), F.lit("\n"), F.replace(F.lit(template), F.lit("{n}"), number))
    return docs.select(F.concat(F.lit("/tree/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(f"/{name}")).alias("path"), text.alias("text"), "doc_id")


@register("c_functions")
def c_functions(spark, sf_dir):
    return csource.function_rows(_files(spark, sf_dir, _C, "a.c").drop("doc_id"))


@register("inactive_lines")
def inactive_lines(spark, sf_dir):
    return build.per_file(_files(spark, sf_dir, _C, "a.c").drop("doc_id"), lambda t: [{"line": n} for n in csource.inactive_lines(t, {"CONFIG_FAST": 1})], "line int")


@register("link_map_members")
def link_map_members(spark, sf_dir):
    return build.per_file(_files(spark, sf_dir, _MAP, "out.map", ";").drop("doc_id"), build.link_map, build.LINK_MEMBERS)


@register("declared_components")
def declared_components(spark, sf_dir):
    return declared.declarations(_files(spark, sf_dir, _LOCK, "Cargo.lock", "# ").drop("doc_id"))


#: Calls of a document's file, by its number: every how many documents, family, class, call.
_CALLS = ((2, "AES", "symmetric", "mbedtls_aes_init(&a);"), (3, "SHA-256", "symmetric", "wc_Sha256Update(&s);"), (5, "MD5", "broken", "EVP_md5();"), (7, "RSA", "vulnerable", "RSA_new();"))


@register(
    "crypto_inventory",
    f"""SELECT family, class, count(*) AS files, sum(1 + doc_id % 3)::BIGINT AS hits FROM documents, (VALUES {', '.join(f"({n}, '{f}', '{c}')" for n, f, c, _ in _CALLS)}) v(n, family, class) WHERE doc_id % n = 0 GROUP BY 1, 2""",
)
def crypto_inventory(spark, sf_dir):
    """Calls of some documents' files, each once to three times; texts are comments."""
    files = _files(spark, sf_dir, "void f(void) {", "c.c")
    calls = F.concat(*[F.when(F.col("doc_id") % n == 0, F.repeat(F.lit(f" {call}"), (F.col("doc_id") % 3 + 1).cast("int"))).otherwise("") for n, _, _, call in _CALLS], F.lit(" }"))
    return crypto.inventory(files.select("path", F.concat("text", calls).alias("text"))).select("family", "class", "files", "hits")
