"""Findings of round 4: ties, repeated globs and overrides, sizes of what is joined."""

from pyspark.sql import functions as F

from tessera.operators import findings, globs, resolve
from tessera.plans.registry import queries


def test_tied_claims_do_not_depend_on_the_order_of_rows(spark):
    rows = [(g, 1, n, 10.0) for g in range(40) for n in (3, 5, 7, 9, 11)]
    order = [F.desc("price"), F.asc("line")]
    for given, parts in ((rows, 1), (rows[::-1], 1), (rows[::-1], 7)):
        claims = spark.createDataFrame(given, "g int, line int, name long, price double").repartition(parts)
        got = resolve.winners(claims, ["g"], order, "name", "price")
        assert got.columns == ["g", "line", "name", "price", "alternatives"]
        assert {(r.name, r.alternatives) for r in got.collect()} == {(3, "5,7,9")} and got.count() == 40


def test_overrides_that_ask_the_same_meet_a_finding_once(spark):
    found = spark.createDataFrame([(i, f"r{i % 3}", "Alpha", f"lib/a{i % 5}", "1") for i in range(200)], "id long, rule string, name string, directory string, version string")
    schema = "position long, rule string, name string, directory string, version string, status string, ends string"
    given = [(400 - k, None, None, "lib/*", None, f"s{400 - k}", None) for k in range(400)] + [(0, "r1", "ALPHA", "lib/a?", "1", "first", "2031")]
    rules = spark.createDataFrame([], "rule string, status string, ends string")
    got = findings.stamped(found, spark.createDataFrame(given, schema), rules)
    assert {(r.id % 3 == 1, r.status, r.ends) for r in got.collect()} == {(True, "first", "2031"), (False, "s1", None)} and got.count() == 200
    assert most_joined(got) <= 200


def test_rules_that_say_the_same_meet_a_path_once(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://a.example.com/de/{k}.html", "") for k in range(600)], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = queries()["rule_path_globs"](spark, str(tmp_path))
    rows = {r.rule_id: (r.glob, r.pages, r.first_page) for r in got.collect()}
    assert len(rows) == 600 and rows[0] == ("a.example.com/**", 600, 0) and rows[594] == rows[0] and rows[3] == ("**.html", 600, 0)
    assert most_joined(got) < 600 * 200


def test_a_sign_at_the_end_of_a_glob(spark):
    paths = spark.createDataFrame([(f"h{k % 20}/d/{k}",) for k in range(400)] + [("h1/d/",), ("h1/d/é𝄞",), ("1",), ("h1/d/1?",)], "path string")
    rules = spark.createDataFrame([(f"h{k % 20}/d/{k // 10}?",) for k in range(0, 400, 10)] + [("h1/d/é?",), ("?",), ("h1/d/1\\?",)], "glob string").distinct()
    got = globs.matched(paths, rules)
    pattern = globs.glob_pattern(F.col("glob"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, paths.crossJoin(rules).filter(F.rlike("path", pattern)).collect()))
    assert ("h1/d/é𝄞", "h1/d/é?") in set(map(tuple, got.collect()))
    assert most_joined(got) < 20 * 40


def most_joined(df):
    """The most rows that a join of ``df``'s final plan made."""
    df.collect()
    plan, most = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        p = plan.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            plan.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            plan.append(p.plan())
        if "Join" in name and p.metrics().contains("numOutputRows"):
            most = max(most, p.metrics().apply("numOutputRows").value())
        kids = p.children()
        plan += [kids.apply(i) for i in range(kids.size())]
    return most
