"""Results kept by content: what was analysed once, by the same code, is not analysed again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def stored(spark, store: str, code: str, schema: StructType) -> DataFrame:
    """``digest, result`` kept in ``store`` for ``code``; a digest that two runs wrote at once counts once.

    ``schema`` is that of ``result``; results of another shape belong to another code.
    """
    full = StructType([StructField("digest", schema.fields[0].dataType), *schema.fields[1:]])
    try:
        rows = spark.read.schema(full).parquet(f"{store}/code={code}/run=*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)
    return rows.dropDuplicates(["digest"])


def analysed(inputs: DataFrame, content: str, analyse: Callable[[DataFrame], DataFrame], store: str, code: str) -> DataFrame:
    """``inputs`` with ``digest`` and ``result``: ``analyse(digest, content)`` gives ``digest, result``, one row for each digest.

    Only contents whose digest is not in the store are analysed, each once.  Their results are
    added in a folder of this run, which Spark commits whole; a task that runs again replaces its own files, and a run that is repeated
    finds its results there.  ``code`` names the analysing code: a changed one begins with nothing.  A null content has a null result.
    """
    spark = inputs.sparkSession
    keyed = inputs.withColumn("digest", F.sha2(F.col(content).cast("binary"), 256))
    fresh = keyed.filter("digest is not null").select("digest", F.col(content).alias("content"))
    schema = analyse(fresh.limit(0)).select("digest", "result").schema
    known = stored(spark, store, code, schema)
    new = fresh.join(known.select("digest"), "digest", "left_anti").dropDuplicates(["digest"])
    analyse(new).select("digest", "result").write.parquet(f"{store}/code={code}/run={uuid.uuid4().hex}")
    return keyed.join(stored(spark, store, code, schema), "digest", "left")
