import pytest

from twinlake.plans.checkpoints import Checkpoint
from twinlake.plans.options import DiffOptions
from twinlake.plans.report import Report, Summary, TableRef, percentile
from twinlake.plans.router import choose
from twinlake.plans.tableplan import build_plan, find_column, pair_warnings


def plan(spark, schema, key=()):
    return build_plan(spark.createDataFrame([], schema), key=key)


@pytest.mark.parametrize(
    ("schema", "key", "same", "wish", "strategy", "warned"),
    [
        ("id int, v string", ["id"], True, "auto", "joindiff", False),
        ("id int, v string", ["id"], False, "auto", "iblt", False),
        ("id string, v string", ["id"], True, "auto", "keyeddiff", False),
        ("a int, b int, v string", ["a", "b"], False, "auto", "keyeddiff", False),
        ("id int, v string", [], True, "auto", "bucketdiff", True),
        ("id int, v string", ["id"], True, "hashdiff", "hashdiff", False),
        ("id string, v string", ["id"], True, "hashdiff", "keyeddiff", True),
        ("id int, v string", [], True, "hashdiff", "bucketdiff", True),
        ("id string, v string", ["id"], True, "iblt", "keyeddiff", True),
        ("id decimal(10,0), v string", ["id"], True, "iblt", "iblt", False),
        ("id decimal(10,2), v string", ["id"], True, "iblt", "keyeddiff", True),
        ("id int, v string", ["id"], False, "joindiff", "hashdiff", True),
        ("id string, v string", ["id"], False, "joindiff", "keyeddiff", True),
        ("id string, v string", ["id"], True, "joindiff", "joindiff", False),
        ("a int, b int", ["a", "b"], True, "joindiff", "keyeddiff", True),
        ("id int", ["id"], True, "bucketdiff", "bucketdiff", False),
        ("id int", [], True, "keyeddiff", "bucketdiff", True),
    ],
)
def test_routes(spark, schema, key, same, wish, strategy, warned):
    p = plan(spark, schema, key)
    route = choose(p, p, same_source=same, wish=wish)
    assert (route.strategy, bool(route.warnings)) == (strategy, warned)


def test_unequal_keys_mean_no_key(spark):
    a, b = plan(spark, "x int, y int", ["x"]), plan(spark, "x int, y int", ["y"])
    route = choose(a, b, same_source=True, wish="hashdiff")
    assert route.strategy == "bucketdiff" and "differ between" in route.warnings[0]


def test_plan_columns_and_warnings(spark):
    df = spark.createDataFrame([], "id int, v string, tags array<int>, f double")
    p = build_plan(df, key=["ID"], declared_key=["id"])
    assert p.key_names == ["id"] and [f.name for f in p.columns] == ["id", "v", "f"]
    assert any("tags" in w for w in p.warnings) and any("float" in w for w in p.warnings) and any("nullable" in w for w in p.warnings)
    with pytest.raises(ValueError, match="canonical text"):
        build_plan(df, columns=["tags"])
    with pytest.raises(ValueError, match="not found"):
        build_plan(df, key=["nope"])
    assert [f.name for f in build_plan(df, columns=["v", "id"]).columns] == ["id", "v"]
    assert build_plan(df, nested_json=True).columns[2].name == "tags"


def test_ambiguous_names(spark):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("A", T.IntegerType())])
    assert find_column(schema, "A").name == "A"
    with pytest.raises(ValueError, match="ambiguous"):
        find_column(T.StructType([T.StructField("aB", T.IntegerType()), T.StructField("Ab", T.IntegerType())]), "ab")


def test_pair_warnings(spark):
    a, b = plan(spark, "d date, n decimal(10,2)"), plan(spark, "d timestamp, n decimal(10,4)")
    assert len(pair_warnings(a, b)) == 2


@pytest.mark.parametrize(
    "bad",
    [{"where": "a = 1; drop"}, {"where": "a", "update_column": "b"}, {"update_since": "1 day"}, {"threads": 0}, {"bisection_factor": 1}, {"strategy": "x"}, {"consistency": "x"}, {"sample": -1}],
)
def test_options_are_checked(bad):
    with pytest.raises(ValueError):
        DiffOptions(**bad)


def test_report_numbers():
    r = Report(TableRef("l", "t"), TableRef("r", "t"), "joindiff", summary=Summary(10, 8, 1, 2, 1))
    assert r.has_diff and r.exit_code == 1 and r.summary.diff_rate == 0.4
    assert '"diff_rate": 0.4' in r.to_json() and ["diff_rate", "40.0000%"] in r.summary_rows()[1]
    assert percentile([], 0.5) == 0 and percentile([5, 1, 3], 0.5) == 3 and percentile([5, 1, 3], 0.99) == 5


def test_checkpoint_survives_bad_lines_and_other_plans(tmp_path):
    path = tmp_path / "c.jsonl"
    c = Checkpoint(path, "p1")
    c.record("[0,5)", left=3, right=2, wave="w")
    path.open("a").write('{"broken\n')
    again = Checkpoint(path, "p1")
    assert again.completed("[0,5)")["left"] == 3 and again.corrupted == 1
    assert Checkpoint(path, "p2").completed("[0,5)") is None
    assert again.finish().name == "c.done" and not path.exists()
