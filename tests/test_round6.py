"""Findings of round 4 on queries over claims and texts: work for each distinct case, in one pass."""

from pyspark.sql import functions as F

from tessera.functions.versions import in_range
from tessera.operators import advisories, crypto, presence
from tessera.operators.inventory import hits
from tessera.plans import registry
from tests.conftest import SF


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_ranges_meet_versions_once(spark):
    c = spark.createDataFrame([(k, k % 2, [None, "1.2", "3.0", "git-1"][k // 2 % 4]) for k in range(16)], "component int, key int, version string")
    r = spark.createDataFrame([(n, n % 2, [None, "1.0", "0"][n % 3], None, [None, "2.0"][n // 6], None) for n in range(12)], "advisory int, key int, introduced string, start_excluding string, fixed string, last_affected string")
    df = advisories.range_join(c, r)
    b = [F.col(x) for x in ("introduced", "start_excluding", "fixed", "last_affected")]
    want = c.join(r, "key").withColumn("verdict", in_range(F.col("version"), *b))
    assert df.columns == want.columns and sorted(map(str, df.collect())) == sorted(map(str, want.collect()))
    assert "RepartitionByExpression" in plan(df)


def test_versions_are_placed_once(spark):
    assert "Aggregate" in plan(registry.queries()["tag_membership"](spark, SF))


def test_names_in_one_pass(spark):
    odd = ["mbedtls_aes_init(rsa_sign, x)", "émbedtls_aesé mbedtls_aes", "wc_Sha256Update wc_sha256update EVP_md5\nEVP_MD5_x", "xrsa_sign _rsa_sign rsa_signed", "a,des_set_key;des3_init,des_init", None, ""]
    files = spark.createDataFrame(list(enumerate(odd)), "path int, text string")
    want = hits(files, "path", "text", crypto.PATTERNS).groupBy("family").agg(F.count("*"), F.sum("n"))
    df = crypto.inventory(files)
    assert sorted(map(tuple, df.select("family", "files", "hits").collect())) == sorted(map(tuple, want.collect())) != []
    assert "regexp_extract_all" in plan(df)


def test_hashes_are_made_once(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, None), (3, "a b")], "doc_id long, text string")
    df = presence.counted(docs, "doc_id", "text", 4)
    assert plan(df).count("MapInArrow") == 1 and "hashes(" not in plan(df)
    assert sorted((r.doc_id, r.n) for r in df.collect()) == [(1, 3)] * 3 + [(3, 1)]
    assert sorted(r.h for r in df.collect()) == sorted(r.h for r in presence.hash_table(docs, ["doc_id"], "text", 4).collect())
