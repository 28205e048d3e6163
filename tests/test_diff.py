"""Random changes to a table are found alike by every strategy."""

import random

import pytest
from pyspark.sql import functions as F

from twinlake.diff import DiffOptions, diff, dry_run
from twinlake.operators import paging, sketch, strategies
from twinlake.operators.strategies import SketchOverflow, bucket_count, first_segments

SCHEMA = "id int, a string, b decimal(8,2)"


def mutated(seed, n=300):
    rng = random.Random(seed)
    rows = {i: (i, rng.choice("xyz") * rng.randint(0, 3), None if rng.random() < 0.1 else rng.randint(0, 99)) for i in rng.sample(range(-500, 4000), n)}
    other, want = dict(rows), {}
    for i in rng.sample(sorted(rows), 20):
        del other[i]
        want[i] = "MissingRight"
    for i in rng.sample(sorted(other), 15):
        other[i] = (i, "changed", other[i][2])
        want[i] = "Modified"
    for i in range(5000, 5010):
        other[i] = (i, "new", 1)
        want[i] = "MissingLeft"
    return list(rows.values()), list(other.values()), want


def frames(spark, left, right):
    def make(rows):
        return spark.createDataFrame(rows, "id int, a string, b int").withColumn("b", F.col("b").cast("decimal(8,2)"))

    return make(left), make(right)


def found(result):
    return {(r.key[0] if len(r.key) == 1 else tuple(r.key)): r.status for r in result.diffs.collect()}


@pytest.mark.parametrize("strategy", ["joindiff", "keyeddiff", "hashdiff", "iblt"])
@pytest.mark.parametrize("seed", [1, 2])
def test_strategies_agree(spark, strategy, seed):
    left, right, want = mutated(seed)
    l, r = frames(spark, left, right)
    options = DiffOptions(strategy=strategy, bisection_threshold=16, bisection_factor=4, threads=1, iblt_capacity=256, fetch_all_threshold=0)
    result = diff(l, r, options, declared_key=["id"])
    assert found(result) == want and result.report.strategy == strategy
    s = result.report.summary
    assert (s.missing_right, s.modified, s.missing_left, s.left_total, s.right_total) == (20, 15, 10, 300, 290)
    assert result.report.exit_code == 1 and len(result.report.sample_diffs) == 45
    result.close()


def test_identical_tables(spark):
    left, _, _ = mutated(3)
    l, r = frames(spark, left, left)
    for strategy in ("auto", "keyeddiff", "hashdiff", "iblt", "bucketdiff"):
        result = diff(l, r, DiffOptions(strategy=strategy), declared_key=["id"])
        assert result.report.exit_code == 0 and found(result) == {}


def test_null_keys_match_each_other(spark):
    l = spark.createDataFrame([(None, "a"), (1, "b")], "id int, v string")
    r = spark.createDataFrame([(None, "x"), (1, "b")], "id int, v string")
    for strategy in ("joindiff", "hashdiff", "iblt", "keyeddiff"):
        assert found(diff(l, r, DiffOptions(strategy=strategy), declared_key=["id"])) == {None: "Modified"}


def test_keyless_multisets(spark):
    l = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "v string")
    r = spark.createDataFrame([("a",), ("b",), ("b",), ("b",)], "v string")
    result = diff(l, r)
    assert result.report.strategy == "bucketdiff"
    got = sorted((row.left.n, row.right.n, row.status) for row in result.diffs.collect())
    assert got == [(1, 0, "MissingRight"), (1, 3, "MissingLeft"), (2, 1, "MissingRight")]


def test_duplicate_keys_fall_back_to_multisets(spark):
    l = spark.createDataFrame([(1, "a"), (1, "b")], "id int, v string")
    result = diff(l, l, DiffOptions(key=("id",)))
    assert result.report.strategy == "bucketdiff" and any("duplicate" in w for w in result.report.warnings)


def test_empty_sides(spark):
    l = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    none = l.filter("id > 9")
    assert found(diff(l, none, DiffOptions(strategy="keyeddiff"), declared_key=["id"])) == {1: "MissingRight", 2: "MissingRight"}
    assert found(diff(none, l, DiffOptions(strategy="hashdiff"), declared_key=["id"])) == {1: "MissingLeft", 2: "MissingLeft"}
    assert found(diff(none, none, DiffOptions(strategy="keyeddiff"), declared_key=["id"])) == {}
    assert found(diff(none, none, DiffOptions(strategy="hashdiff"), declared_key=["id"])) == {}


def test_extra_and_clashing_columns(spark):
    l = spark.createDataFrame([(1, "a", 5)], "key int, status string, left int")
    r = spark.createDataFrame([(1, "a", 6)], "key int, status string, left int")
    assert found(diff(l, r, declared_key=["key"])) == {1: "Modified"}


def test_decimal_scales_are_aligned(spark):
    l = spark.sql("select 1 id, cast(1.5 as decimal(5,1)) n")
    r = spark.sql("select 1 id, cast(1.50 as decimal(7,3)) n")
    assert diff(l, r, declared_key=["id"]).report.exit_code == 0


def test_sketch_overflow_falls_back_or_fails(spark):
    left, _, _ = mutated(4)
    l, r = frames(spark, left, [])
    r = spark.createDataFrame([], l.schema)
    result = diff(l, r, DiffOptions(strategy="iblt", iblt_capacity=16), declared_key=["id"])
    assert result.report.strategy == "hashdiff" and len(found(result)) == 300
    with pytest.raises(SketchOverflow):
        diff(l, r, DiffOptions(strategy="iblt", iblt_capacity=16, strict=True), declared_key=["id"])


def test_recheck_drops_what_has_gone(spark):
    l = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string")
    before, after = l.filter("id <> 2").withColumn("v", F.expr("if(id = 3, 'z', v)")), l.withColumn("v", F.expr("if(id = 3, 'z', v)"))
    reads = iter([before, after])
    result = diff(lambda: l, lambda: next(reads), DiffOptions(recheck=True), declared_key=["id"])
    assert {r.key.id: r.confirmed for r in result.diffs.collect()} == {2: False, 3: True}
    assert result.report.summary.missing_right == 0 and result.report.summary.modified == 1


def test_checkpoint_resumes_with_differences(spark, tmp_path):
    left, right, want = mutated(5)
    l, r = frames(spark, left, right)
    path = tmp_path / "run.jsonl"
    options = DiffOptions(strategy="hashdiff", checkpoint=str(path), threads=1, bisection_threshold=16)
    assert found(diff(l, r, options, declared_key=["id"])) == want
    done = path.with_suffix(".done")
    done.rename(path)
    again = diff(l, r, options, declared_key=["id"])
    assert found(again) == want and {s.status for s in again.report.shards} == {"Skipped"}


def test_checkpoint_of_other_tables_is_not_resumed(spark, tmp_path):
    make = lambda changed: spark.range(40).selectExpr("id", f"if(id = {changed}, 'x', 'v') v")
    path = tmp_path / "run.jsonl"
    options = DiffOptions(strategy="hashdiff", checkpoint=str(path), threads=1, bisection_threshold=4)
    assert found(diff(make(-1), make(7), options, declared_key=["id"])) == {7: "Modified"}
    path.with_suffix(".done").rename(path)
    assert found(diff(make(-1), make(3), options, declared_key=["id"])) == {3: "Modified"}


def test_declared_keys_that_repeat(spark):
    l = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id int, v string")
    r = spark.createDataFrame([(1, "b"), (1, "a"), (2, "d")], "id int, v string")
    for strategy in ("joindiff", "keyeddiff", "hashdiff", "iblt"):
        same = diff(l, l, DiffOptions(strategy=strategy), declared_key=["id"])
        assert same.report.exit_code == 0
        if strategy in ("joindiff", "keyeddiff"):  # these look at all keys of such small tables
            assert same.report.strategy == "bucketdiff" and any("duplicate" in w for w in same.report.warnings)
        else:  # rows that repeat alike cancel out
            assert same.report.strategy == strategy
        other = diff(l, r.unionByName(l.filter("v = 'a'")), DiffOptions(strategy=strategy), declared_key=["id"])
        assert other.report.strategy == "bucketdiff" and any("duplicate" in w for w in other.report.warnings)
        assert sorted(x.status for x in other.diffs.collect()) == ["MissingLeft", "MissingLeft", "MissingRight"]
        # a changed row is two contents of a multiset, but one key
        assert diff(l, r, DiffOptions(strategy=strategy), declared_key=["id"]).diffs.count() == (2 if strategy in ("joindiff", "keyeddiff") else 1)
    assert diff(l.filter("id = 2"), r.filter("id = 2"), DiffOptions(trust_keys=True), declared_key=["id"]).report.strategy == "joindiff"


def test_keys_of_any_type(spark):
    left, right, want = mutated(8)
    named = lambda rows: spark.createDataFrame([(f"k{i % 7}ü", None if i == 3 else i, a, b) for i, a, b in rows], "s string, n int, a string, b int")
    l, r = named(left), named(right)
    expected = {(f"k{i % 7}ü", None if i == 3 else i): s for i, s in want.items()}
    for strategy in ("hashdiff", "iblt"):
        options = DiffOptions(strategy=strategy, any_key=True, bisection_threshold=4, threads=1)
        result = diff(l, r, options, declared_key=["s", "n"])
        assert result.report.strategy == strategy and found(result) == expected
        text = lambda df: df.select(F.concat("s", F.lit("-"), F.coalesce("n", F.lit(-1))).alias("t"), "a", "b")
        result = diff(text(l), text(r), options, declared_key=["t"])
        assert result.report.strategy == strategy and found(result) == {f"{s}-{-1 if n is None else n}": v for (s, n), v in expected.items()}
        assert diff(l, r, DiffOptions(strategy=strategy), declared_key=["s", "n"]).report.strategy == "keyeddiff"


def test_the_tree_of_checksums(spark):
    """Every level rolled up from the leaves equals the sums of the rows themselves; skewed keys give even leaves."""
    from twinlake.operators import tree
    from twinlake.plans.tableplan import build_plan

    l = spark.range(4000).selectExpr("cast(if(id % 100 = 0, id * id * 1000, id) as bigint) id", "concat('v', id % 13) v")
    r = l.filter("id <> 77").withColumn("v", F.expr("if(id = 2500, 'x', v)"))
    lp, rp = (build_plan(df, key=["id"]) for df in (l, r))
    leaves = tree.cut(l, r, lp, rp, 50)
    assert 64 <= leaves.number <= 90 and leaves.parts == 1
    sums = tree.leaf_sums(l, r, lp, rp, leaves)
    sizes = [x.left_cnt for x in sums.collect()]
    assert sum(sizes) == 4000 and max(sizes) < 200
    for width in (1, 8, 64, leaves.number):
        at = leaves.of([F.col("id")])
        for df, p, side in ((l, lp, "left"), (r, rp, "right")):
            rows = df.select((at / width).cast("long").alias("seg"), p.identity_hash().alias("h"))
            want = {tuple(x) for x in strategies.segment_checksums(rows.withColumnRenamed("seg", "k"), F.col("k")).collect()}
            assert {(x.node, *(x[f"{side}_{c}"] for c in ("cnt", *tree.SUMS))) for x in tree.roll_up(sums, width).collect()} == want
    differ = {x.leaf for x in sums.filter(tree.unequal()).collect()}
    assert differ == {x.a for x in l.filter("id in (77, 2500)").select(at.alias("a")).collect()}
    # more leaves than split points: the rest is dealt by hash
    many = tree.cut(l, r, lp, rp, 2)
    assert many.parts > 1 and many.number > tree.MAX_RANGES
    assert {x[0] for x in l.select(many.of([F.col("id")]) >= many.number).distinct().collect()} == {False}


def test_a_comparison_scans_each_side_once_for_its_checksums(spark, tmp_path):
    spark.range(3000).selectExpr("id", "id % 9 as v").write.parquet(f"{tmp_path}/l")
    df = spark.read.parquet(f"{tmp_path}/l")
    for threshold in (1000, 3):
        from twinlake.operators import tree
        from twinlake.plans.tableplan import build_plan

        p = build_plan(df, key=["id"])
        plan = tree.roll_up(tree.leaf_sums(df, df, p, p, tree.cut(df, df, p, p, threshold)), 1)._jdf.queryExecution().executedPlan().toString()
        assert plan.split("+- == Initial Plan ==")[0].count("FileScan parquet") <= 2 * (1 + plan.count("== Initial Plan =="))


@pytest.mark.parametrize("changed", [0, 40, 700, 20_000])
def test_estimate_of_differences(spark, changed):
    from twinlake.plans.tableplan import build_plan

    l = spark.range(30_000).selectExpr("id", "id % 17 as v")
    r = l.withColumn("v", F.when(F.col("id") < changed, -1).otherwise(F.col("v")))
    p = build_plan(l, key=["id"])
    for key in (sketch.INTEGER, sketch.HASHED):
        about = sketch.estimate(l, r, p, p, key)
        assert about == 0 if changed == 0 else changed <= about <= 4 * changed  # a change is two entries


def test_sketches_size_themselves(spark, monkeypatch):
    l = spark.range(9000).selectExpr("id", "id % 17 as v")
    r = l.withColumn("v", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("v")))
    monkeypatch.setattr(sketch, "FIRST_CAPACITY", 64)
    result = diff(l, r, DiffOptions(strategy="iblt", sample=0), declared_key=["id"])
    assert result.report.strategy == "iblt" and result.report.summary.modified == 3000
    monkeypatch.setattr(strategies, "SKETCH_LIMIT", 1000)
    result = diff(l, r, DiffOptions(strategy="iblt", sample=0), declared_key=["id"])
    assert result.report.strategy == "hashdiff" and result.report.summary.modified == 3000 and any("about" in w for w in result.report.warnings)


def test_multisets_by_buckets(spark):
    from twinlake.diff import plan_sides
    from twinlake.operators import joins

    l = spark.range(3000).selectExpr("id % 500 as a", "concat('v', id % 700) as b")
    few = l.filter("a <> 3").unionByName(l.filter("a = 9"))
    many = l.selectExpr("a", "concat(b, 'x') as b")
    for r in (few, many, l.limit(0)):
        lplan, rplan, _ = plan_sides(l, r, DiffOptions())
        want = joins.keyless_rows(joins.multiset_differences(l, r, lplan, rplan)).collect()
        for threshold in (8, 16384):
            result = diff(l, r, DiffOptions(bisection_threshold=threshold))
            got = result.diffs.drop("confirmed").collect()
            assert sorted(map(repr, got)) == sorted(map(repr, want)) and (threshold > 8) == (len(result.report.shards) == 1)
            result.close()
    assert diff(l, l, DiffOptions(bisection_threshold=8)).report.exit_code == 0


def test_a_comparison_has_a_time_limit(spark):
    from pyspark.sql.functions import udf

    from twinlake.operators.timeouts import JobTimeout

    @udf("long")
    def slow(x):
        import time

        time.sleep(20)
        return x

    l = spark.range(4).select(slow("id").alias("id"), F.lit("v").alias("v"))
    with pytest.raises(JobTimeout):
        diff(l, l, DiffOptions(statement_timeout=1.0), declared_key=["id"])


def test_a_whole_comparison_has_a_deadline(spark):
    """Many jobs, each well within the limit of a job, end together at the deadline."""
    import time

    from pyspark.sql.functions import udf

    from twinlake.operators.timeouts import JobTimeout, limited

    @udf("long")
    def slow(x):
        import time

        time.sleep(0.2)
        return x

    rows = spark.range(4).select(slow("id").alias("id"))
    rows.count()  # workers are started
    rows.agg(F.sum("id")).first()
    done, started = [], time.monotonic()
    with pytest.raises(JobTimeout, match="in all"):
        limited(spark, lambda: [done.append(rows.agg(F.sum("id")).first()) for _ in range(500)], 60, deadline=4.0)
    assert done and time.monotonic() - started < 15
    assert limited(spark, lambda: spark.range(3).count(), None, deadline=60.0) == 3
    with pytest.raises(JobTimeout):
        diff(rows.withColumn("v", F.lit("a")), rows.withColumn("v", F.lit("b")), DiffOptions(deadline=0.3), declared_key=["id"])


def test_a_snapshot_does_not_read_again(spark, tmp_path):
    spark.range(10).selectExpr("id", "'a' v").write.parquet(f"{tmp_path}/l")
    spark.range(10).selectExpr("id", "if(id = 4, 'b', 'a') v").write.parquet(f"{tmp_path}/r")
    left, right = (lambda s=s: spark.read.parquet(f"{tmp_path}/{s}") for s in "lr")
    result = diff(left, right, DiffOptions(consistency="snapshot", strategy="joindiff"), declared_key=["id"])
    assert found(result) == {4: "Modified"} and len(result._stored) == 2
    result.close()
    assert not result._stored


@pytest.mark.parametrize("change", ["added", "rewritten", "gone"])
def test_a_pinned_comparison_keeps_its_files(spark, tmp_path, monkeypatch, change):
    import shutil

    from twinlake.operators.snapshots import SnapshotChanged

    for side, changed in (("l", "'a'"), ("r", "if(id = 4, 'b', 'a')")):
        spark.range(10).selectExpr("id", f"{changed} v").write.parquet(f"{tmp_path}/{side}")
    spark.range(100, 105).selectExpr("id", "'late' v").write.parquet(f"{tmp_path}/late")
    run, files = strategies.RUN["joindiff"], lambda at: sorted((tmp_path / at).glob("part-*.parquet"))

    def meanwhile(sides, options):
        if change == "added":
            shutil.copy(files("late")[-1], tmp_path / "r" / "part-added.parquet")
        out = run(sides, options)
        if change == "rewritten":
            shutil.copy(files("late")[-1], files("r")[0])
        elif change == "gone":
            files("l")[0].unlink()
        return out

    monkeypatch.setitem(strategies.RUN, "joindiff", meanwhile)
    sides = (lambda s=s: spark.read.parquet(f"{tmp_path}/{s}") for s in "lr")
    options = DiffOptions(consistency="pinned", strategy="joindiff", sample=0)
    if change != "added":
        with pytest.raises(SnapshotChanged, match="right" if change == "rewritten" else "left"):
            diff(*sides, options, declared_key=["id"])
        return
    result = diff(*sides, options, declared_key=["id"])
    assert found(result) == {4: "Modified"} and result.report.summary.right_total == 10 and spark.read.parquet(f"{tmp_path}/r").count() > 10
    assert len(result._stored) == 2 and all("manifest" in p for p in result._stored)  # no copy of a side
    result.close()


def test_a_pinned_comparison_copies_what_has_no_files(spark, tmp_path):
    spark.range(10).selectExpr("id", "'a' v").write.parquet(f"{tmp_path}/l")
    left = spark.read.parquet(f"{tmp_path}/l")
    mixed = left.unionByName(spark.range(10, 12).selectExpr("id", "'b' v"))
    result = diff(left, mixed, DiffOptions(consistency="pinned", strategy="joindiff"), declared_key=["id"])
    assert found(result) == {10: "MissingLeft", 11: "MissingLeft"} and sorted("manifest" in p for p in result._stored) == [False, True]
    result.close()


def test_dry_run(spark):
    l = spark.createDataFrame([(1, "a"), (7, "b")], "id int, v string")
    plan = dry_run(l, l, DiffOptions(strategy="hashdiff"), declared_key=["id"])
    assert plan["strategy"] == "hashdiff" and plan["key_domain"] == (1, 7) and plan["first_segments"] == 32 and "Exchange" in plan["plan"]


def test_paging(spark):
    df = spark.range(25).selectExpr("id div 10 as a", "id % 10 as b")
    got = [r for p in paging.pages(df, ["a", "b"], size=10) for r in p]
    assert [(r.a, r.b) for r in got] == sorted((i // 10, i % 10) for i in range(25))
    assert [r.b for r in paging.rows_in_order(df.filter("a = 0"), ["b"])] == list(range(10))


def test_paging_index(spark):
    """Pages by number and by key from one sort; a page reads the files that hold it, and no others."""
    df = spark.range(1000).selectExpr("if(id < 3, null, id * 7 % 1000) as a", "concat('t', id) as twinlake_at", "id").repartition(5)
    want = sorted(((r.a is not None, r.a, r.id) if r.a is not None else (False, 0, r.id) for r in df.collect()))
    index = paging.PageIndex.build(df, ["a", "id"], size=90, ranges=4)
    assert (index.rows, index.number, len(index.files()) > 1) == (1000, 12, True)
    got = []
    for n in range(index.number):
        page = index.page(n)
        rows = page.collect()
        assert page.columns == df.columns and len(page.inputFiles()) <= 2
        got += [(r.a is not None, r.a or 0, r.id) for r in rows]
    assert got == want and index.page(12).collect() == []
    after = index.after([350, 50]).collect()
    assert [r.a for r in after] == [r[1] for r in want if r[:1] == (True,) and (r[1], r[2]) > (350, 50)][:90]
    assert [len(p) for p in index.pages()] == [90] * 11 + [10]
    empty = paging.PageIndex.build(df.limit(0), ["a"])
    assert empty.number == 0 and empty.page(0).collect() == [] and list(empty.pages()) == []
    index.close()
    empty.close()


@pytest.mark.parametrize(("span", "want"), [((0, 100, 4), (25, 4)), ((0, 10, 3), (4, 3)), ((5, 6, 32), (1, 1)), ((-50, 1000001, 32), (31252, 32))])
def test_first_segments(span, want):
    assert first_segments(*span) == want


def test_bucket_count():
    assert [bucket_count(n, 16384) for n in (0, 1, 16385, 10**9)] == [1, 1, 2, 1024]


def test_sketch_decodes_to_its_capacity():
    rng, m = random.Random(0), sketch.cells_for(512)
    for load in (50, 256, 512):
        cells = {}
        want = {(rng.randrange(-(2**40), 2**40), tuple(rng.randrange(2**32) for _ in range(4))): rng.choice((1, -1)) for _ in range(load)}
        for (key, value), sign in want.items():
            for g in range(4):
                c = cells.setdefault((g + 1, value[g] % m), [0] * 6)
                c[0] += sign
                for i, x in enumerate((key, *value)):
                    c[i + 1] ^= x
        rows = [dict(zip(("grp", "cell", "cnt", "key_xor", *sketch.VALUES), (*at, *c))) for at, c in cells.items()]
        out = sketch.peel(rows, m)
        assert out.complete and set(out.left) == {e for e, s in want.items() if s > 0} and set(out.right) == {e for e, s in want.items() if s < 0}
