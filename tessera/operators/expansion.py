"""Calls through macros: what a function reaches when the macros that it uses are expanded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import settled


#: Macros that one function uses beyond which they are dealt to several groups.
USED = 4096


def symbol_sets(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``macro, symbols`` (numbers, distinct) and ``at, symbol``: names that are no macros in the expansion of each macro of ``bodies(macro, token)``.

    A round doubles the steps that sets know: what is within them, and the macros that are just so many steps away, whose sets
    come next.  So a chain takes as many rounds as its length has binary digits, and cycles end when no set grows.
    """
    bodies = settled(bodies.select("macro", "token").distinct())
    names = settled(bodies.select("macro").distinct().withColumn("id", F.monotonically_increasing_id()))
    inner = bodies.join(names.select(F.col("macro").alias("token"), F.col("id").alias("inner")), "token", "left")
    inner = settled(inner.join(names, "macro").select("id", "inner", F.when(F.col("inner").isNull(), F.col("token")).alias("symbol")))
    symbols = settled(inner.filter("symbol is not null").select("symbol").distinct().withColumn("at", F.monotonically_increasing_id()))
    # collect_set leaves nulls out
    state = settled(inner.join(symbols, "symbol", "left").groupBy("id").agg(F.collect_set("at").alias("s"), F.collect_set("inner").alias("f")))
    growing = True
    while growing:
        there = state.select(F.col("id").alias("x"), F.col("s").alias("xs"), F.col("f").alias("xf"))
        met = state.select("id", F.explode("f").alias("x")).join(there, "x").groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("xs"))).alias("xs"), F.array_distinct(F.flatten(F.collect_list("xf"))).alias("xf"))
        none = F.expr("cast(array() as array<bigint>)")
        step = state.join(met, "id", "left").select("id", F.size("s").alias("_n"), F.array_union("s", F.coalesce("xs", none)).alias("s"), F.coalesce("xf", none).alias("f"))
        step = settled(step.withColumn("grown", F.size("s") > F.col("_n")).drop("_n"))
        growing = not step.filter("grown").isEmpty()
        state = step.drop("grown")
    return state.join(names, "id").select("macro", F.col("s").alias("symbols")), symbols


def expanded_calls(functions: DataFrame, bodies: DataFrame) -> DataFrame:
    """``fn, symbol, through``: names that each function uses itself (``through`` null) or through a macro (the first by name).

    ``functions(fn, token)``.  Each macro is expanded once, whatever the number of its users.  Sets of numbers go to the functions,
    and are opened there.
    """
    uses = settled(functions.select("fn", "token").distinct())
    sets, symbols = symbol_sets(bodies)
    many = uses.groupBy("fn").agg(F.ceil(F.count("*") / USED).alias("parts")).filter("parts > 1")
    part = F.pmod(F.xxhash64("token"), F.coalesce("parts", F.lit(1)))
    # sets join last: they travel twice, to the macro and to the function
    dealt = uses.join(many, "fn", "left").select("fn", part.alias("part"), F.col("token").alias("macro")).join(settled(sets), "macro")
    opened = dealt.select("fn", "part", "macro", "symbols").repartition("fn", "part").select("fn", "part", "macro", F.explode("symbols").alias("at"))
    first = opened.groupBy("fn", "part", "at").agg(F.min("macro").alias("macro")).groupBy("fn", "at").agg(F.min("macro").alias("macro"))
    by_macro = first.join(symbols, "at").select("fn", "symbol", "macro", F.lit(1).alias("_by"))
    macros = bodies.select(F.col("macro").alias("token")).distinct()
    own = uses.join(macros, "token", "left_anti").select("fn", F.col("token").alias("symbol"), F.lit(None).cast("string").alias("macro"), F.lit(0).alias("_by"))
    return own.unionByName(by_macro).groupBy("fn", "symbol").agg(F.min(F.struct("_by", "macro")).alias("x")).select("fn", "symbol", F.col("x.macro").alias("through"))
