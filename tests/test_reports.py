import fixtures as X
import numpy as np
import pytest
from attrlink import match_values
from attrlink.operators import quality as Q
from attrlink.operators import report as R
from attrlink.session import stage


@pytest.fixture(scope="module")
def results(spark):
    found = match_values(X.inputs(spark, X.INPUTS + [(99, "no", "such", "key", "@@ zzzzz")]), X.presets(spark), emit_unmatched=True)
    return stage(found, "results")


def test_summary(results):
    lines = {r.metric: r.value for r in R.summary(results, "2024-01-01 00:00:00").collect()}
    assert list(lines) == R.METRICS
    assert lines["Total Comparisons"] == "14" and lines["Not Found"] == "1"
    assert lines["Exact Matches"] == "9" and lines["Similar Matches"] == "4"
    assert lines["Average Similarity Score"] == "95.16%" and lines["Lowest Similarity Score"] == "80.00%"
    assert lines["Export Date"] == "2024-01-01 00:00:00"
    assert R.summary(results.drop("similarity")).filter("value = 'N/A'").count() == 3
    assert R.summary(results.limit(0)).filter("value = 'nan%'").count() == 3


def test_breakdowns(results):
    assert [tuple(r) for r in R.status_breakdown(results).collect()] == [
        ("Exact Match", 9), ("Similar Match", 4), ("Not Found", 1)
    ]
    pivot = {r.category: tuple(r)[1:] for r in R.category_status(results).collect()}
    assert pivot["no"] == (0, 0, 1) and pivot["Switches"] == (3, 1, 0)
    assert [tuple(r) for r in R.worst_categories(results).collect()] == [("no", 1)]
    assert R.filter_choices(results).filter("field = 'status'").count() == 3


def test_filters(results):
    assert R.filter_results(results, "All", None, 0).count() == 13
    assert R.filter_results(results).count() == results.count()
    assert R.filter_results(results, "Similar Match", "Connectors", 85).count() == 2
    assert R.filter_results(results, min_similarity=100).count() == 9


@pytest.mark.parametrize("values", [[80.0, 85.0, 85.5, 100.0, 100.0], [100.0, 100.0], [75.0, 75.1]])
def test_histogram_follows_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "similarity double")
    rows = R.score_histogram(df).orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=20)
    assert [r["count"] for r in rows] == counts.tolist()
    assert [r.bin_start for r in rows] == pytest.approx(edges[:-1])


def test_load_metrics(spark):
    assert tuple(R.load_metrics(X.presets(spark)).first()) == (32, 4, 4, 12)
    assert tuple(R.load_metrics(X.presets(spark).drop("category")).first()) == (32, 0, 4, 12)
    assert tuple(R.load_metrics(X.presets(spark), approximate=True).first()) == (32, 4, 4, 12)


def test_quality(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 1, None), ("b", None, "x"), (None, 2, "")], "s string, n int, t string")
    report = {(r.column, r.metric): r.value for r in Q.quality_report(df).collect()}
    assert report["", "total_rows"] == "4" and report["", "duplicate_rows"] == "1" and report["", "total_columns"] == "3"
    assert report["t", "null_count"] == "2" and float(report["t", "null_percentage"]) == 50.0
    assert report["s", "unique_values"] == "2" and report["n", "data_type"] == "int"
    assert ("n", "unique_values") not in report
    summary = {(r.column, r.metric): r.value for r in Q.data_summary(df).collect()}
    assert summary == {("", "total_records"): "4", ("", "columns"): "3", ("s", "unique"): "2", ("s", "null"): "1", ("t", "unique"): "2", ("t", "null"): "2"}
    assert Q.data_summary(df.limit(0)).count() == 0
    assert {(r.column, r.value, r["count"]) for r in Q.most_common(df).collect()} == {("s", "a", 2), ("t", "", 1)}


def test_digest_tells_rows_apart(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c"), ("a", None), (None, "a"), ("1:a", "")], "x string, y string")
    assert Q.duplicate_rows(df).first()[0] == 0


def test_quality_of_odd_tables(spark):
    numbers = spark.createDataFrame([(1, 2.0), (3, None)], "`a.b` int, c double")
    found = {(r.column, r.metric): r.value for r in Q.quality_report(numbers).collect()}
    assert found[("", "total_rows")] == "2" and found[("c", "null_count")] == "1"
    assert Q.top_values(numbers).count() == 0
    texts = spark.createDataFrame([("x",), (None,)], "`a.b` string")
    shares = {(r.column, r.metric): r.value for r in Q.quality_report(texts).collect()}
    assert shares[("a.b", "null_percentage")] == "50.0"
    none = Q.quality_report(texts.limit(0)).collect()
    assert {r.value for r in none if r.metric == "total_rows"} == {"0"}


def test_ties_of_long_values_go_by_value(spark):
    rows = [("s" * 64 + f"{i:02d}",) for i in range(12)]
    got = Q.top_values(spark.createDataFrame(rows, "v string"), 5).orderBy("rank").collect()
    assert [r.value[-2:] for r in got] == ["00", "01", "02", "03", "04"]


def test_sketches_of_versions_merge(spark):
    from attrlink.operators import quality as Q

    first = spark.createDataFrame([(i, str(i % 7) if i % 5 else None) for i in range(3000)], "a int, b string")
    second = spark.createDataFrame([(i, "x") for i in range(2000, 5000)], "a int, b string")
    sketches = Q.distinct_sketches(first, ["a", "b"], "one").union(Q.distinct_sketches(second, ["a", "b"], "two"))
    got = {r.column: (r.rows, r.estimate) for r in Q.distinct_estimates(sketches).collect()}
    assert got["a"][0] == 6000 and abs(got["a"][1] - 5000) <= 150 and got["b"] == (6000, 8)
    none = Q.distinct_estimates(Q.distinct_sketches(first.limit(0), ["a"], "none")).first()
    assert (none.rows, none.estimate) == (0, 0)
