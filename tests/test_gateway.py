import io
import json
import time

import pytest
from pyspark.sql import functions as F

from twinlake import cli
from twinlake.gateway import catalog
from twinlake.gateway.errors import GatewayError, classify
from twinlake.gateway.gateway import Gateway
from twinlake.gateway.render import render
from twinlake.gateway.repl import Repl
from twinlake.gateway.server import ToolServer
from twinlake.gateway.statements import refused, split_statements, strip_comments
from twinlake.sources.registry import Registry, Source, jdbc_options, load_config, redact, seconds


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("data")
    for side, change in (("a", "v"), ("b", "if(id = 3, 'changed', v)")):
        spark.range(10).selectExpr("id", "concat('v', id) v").selectExpr("id", f"{change} v").write.parquet(f"{top}/{side}/t.parquet")
    (top / "sources.toml").write_text(
        f'timeout = "2m"\n[sources.a]\nkind = "parquet"\nlocation = "{top}/a"\nkeys = {{ t = ["id"] }}\n[sources.b]\nkind = "parquet"\nlocation = "{top}/b"\nkeys = {{ t = ["id"] }}\n'
    )
    return top


@pytest.mark.parametrize(
    "sql",
    [
        "select 1",
        "/* a /* nested */ b */ select 'x; --' as y -- end",
        "with t as (select 1 a) select * from t order by a limit 3",
        "select * from (values (1), (2)) v(a) union all select 3",
        "show tables",
        "describe table_that_may_not_exist",
        "explain select 1",
        "select a, count(*) over (partition by a) from (select 1 a) group by a having count(*) > 0",
        "select * from range(3) r join range(2) s on r.id = s.id where exists (select 1 from range(1))",
        "table t",
    ],
)
def test_reading_statements_pass(spark, sql):
    assert refused(spark, sql) is None


@pytest.mark.parametrize(
    "sql",
    [
        "drop table t",
        "insert into t values (1)",
        "with x as (select 1) insert into t select * from x",
        "from t insert into u select *",
        "create table t as select 1",
        "create view v as select 1",
        "set spark.sql.ansi.enabled = false",
        "use other",
        "cache table t",
        "refresh table t",
        "delete from t",
        "merge into t using u on t.a = u.a when matched then delete",
        "select java_method('java.lang.System', 'exit', 1)",
        "select reflect('java.lang.System', 'exit', 1)",
        "select 1; drop table t",
        "truncate table t",
        "not sql",
    ],
)
def test_other_statements_are_refused(spark, sql):
    assert refused(spark, sql)


def test_splitting():
    script = "select 1; select ';' ; -- c ; \n select \"a;b\", `c;d` /* ; /* ; */ ; */ ; select $$ ; $$; select $x$ ; $x$ ;;"
    assert [s.split()[0] for s in split_statements(script)] == ["select", "select", "--", "select", "select"]
    assert split_statements("select 'it''s;' ;select 2") == ["select 'it''s;'", "select 2"]
    assert split_statements("# only a comment ;\n", hash_comments=True) == []
    assert strip_comments("a -- b\n c /* d /* e */ f */ '--g'").split() == ["a", "c", "'--g'"]


def test_cap_flag_and_parameters(spark):
    g = Gateway(spark)
    r = g.execute("select id as credit_limit from range(50)", 10)
    assert len(r.rows) == 10 and r.truncated and r.columns == ["credit_limit"]
    assert not g.execute("select id from range(10)", 10).truncated
    assert g.cap(None) == 1000 and g.cap(0) == 1000 and g.cap(10**9) == 10_000 and g.cap(-5) == 1
    assert g.execute("select id from range(9) where id = ? or id > ?", args=[3, 7]).rows == [[3], [8]]
    empty = g.execute("select id from range(0)")
    assert empty.columns == ["id"] and "id" in empty.render() and "(0 rows)" in empty.render()


def test_timeout_plan_and_errors(spark):
    g = Gateway(spark, timeout=60)
    started = time.monotonic()
    with pytest.raises(GatewayError) as e:
        g.execute("select count(*) from range(10000000000) a where hash(a.id) % 7 = hash(a.id + 1) % 11", timeout=1.5)
    assert e.value.kind == "timeout" and time.monotonic() - started < 40
    assert "Range" in g.explain("select id from range(5)")
    assert "5 rows" in g.explain("select id from range(5)", analyze=True)
    for sql in ("drop table x", "explain select 1"):
        with pytest.raises(GatewayError):
            g.explain(sql)
    with pytest.raises(GatewayError) as e:
        g.execute("select * from no_such_table")
    assert e.value.condition == "TABLE_OR_VIEW_NOT_FOUND" and e.value.kind == "syntax"
    assert classify(ValueError("x://u:secret@h")).message == "x://u:***@h"


def test_actions_after_a_timeout(spark):
    slow = "select count(*) from range(10000000000) a where hash(a.id) % 7 = hash(a.id + 1) % 11"
    for action in ("cancel", "disconnect"):
        g = Gateway(spark.newSession(), timeout=1.0, timeout_action=action)
        g.spark.range(2).createOrReplaceTempView("of_this_session")
        with pytest.raises(GatewayError) as e:
            g.execute(slow)
        assert e.value.kind == "timeout"
        if action == "disconnect":
            with pytest.raises(GatewayError) as e:
                g.execute("select 1")
            assert e.value.kind == "connection"
            g.connect()
            with pytest.raises(GatewayError) as e:
                g.execute("select * from of_this_session")
            assert e.value.condition == "TABLE_OR_VIEW_NOT_FOUND"
        else:
            assert len(g.execute("select * from of_this_session", timeout=60).rows) == 2
        assert g.execute("select 1 as a", timeout=60).rows == [[1]]
    with pytest.raises(GatewayError):
        Gateway(spark, timeout_action="other")


def test_a_measured_plan(spark):
    """A join by exchange: rows of each node and of the shuffles, known beforehand."""
    g = Gateway(spark.newSession(), timeout=120)
    g.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    text = g.explain("select a.id from range(0, 1000, 1, 3) a join range(0, 2000, 2, 3) b on a.id = b.id", analyze=True)
    joined = [line for line in text.splitlines() if line.strip().startswith(("SortMergeJoin", "ShuffledHashJoin")) and " rows" in line]
    assert len(joined) == 1 and "500 rows" in joined[0]
    assert "shuffled: 2000 rows, " in text and "spilled: 0 B" in text and text.count("shuffle records written: 1000") == 2
    assert "sort time" in text or "time to build hash map" in text or "shuffle write time" in text


def test_renderers():
    columns, rows = ["a", "bé"], [[1, None], [22, "x,\"y\""]]
    assert render(columns, rows) == "┌────┬───────┐\n│ a  │ bé    │\n├────┼───────┤\n│ 1  │ NULL  │\n│ 22 │ x,\"y\" │\n└────┴───────┘\n\n(2 rows)\n"
    assert json.loads(render(columns, rows, "json")) == {"columns": columns, "rows": rows, "row_count": 2}
    assert render(columns, rows[:1], "vertical") == "-[ RECORD 1 ]-\na | 1\nbé | NULL\n(1 row)\n"
    assert render(columns, rows, "csv") == 'a,bé\n1,NULL\n22,"x,""y"""\n'
    assert render([], []) == "(0 rows)\n" and json.loads(render(["b"], [[b"\x01"]], "json"))["rows"] == [["0x01"]]


def test_catalog(spark, folder):
    spark.range(3).createOrReplaceTempView("cat_view")
    assert catalog.database_info(spark).first().version == spark.version
    assert any(r.name == "cat_view" and r.rows == 3 for r in catalog.list_tables(spark, count=True).collect())
    source = Source("a", "parquet", f"{folder}/a", keys={"t": ["id"]})
    df = Registry([source]).open(spark, "a", "t")
    assert [(r.column_name, r.column_key) for r in catalog.table_columns(df, ["id"]).collect()] == [("id", "PRI"), ("v", "")]
    assert catalog.table_indexes(spark, source, "t", df).first().is_unique
    assert [r.comparable for r in catalog.describe(df).collect()] == [True, True]


def test_sources(spark, folder, monkeypatch):
    registry = load_config(folder / "sources.toml")
    assert registry.resolve("a").timeout == 120 and {x["status"] for x in registry.listing()} == {"pending"}
    assert registry.open(spark, "a", "t").count() == 10 and registry.states["a"] == "connected"
    with pytest.raises(ConnectionError):
        registry.open(spark, "a", "none")
    with pytest.raises(KeyError):
        registry.resolve("c")
    backup = Source("x", "parquet", "/nowhere", fallbacks=(Source("x", "parquet", f"{folder}/a"),))
    assert Registry([backup]).open(spark, None, "t").count() == 10
    assert redact("mysql://root:pw@h/db") == "mysql://root:***@h/db"
    assert [seconds(x) for x in (3, "500ms", "2m", "1h", "7")] == [3, 0.5, 120, 3600, 7]
    options = jdbc_options(Source("m", "jdbc", "mysql://h/db", timeout=5), "t")
    assert options["url"] == "jdbc:mysql://h/db" and options["queryTimeout"] == "5" and "mysql" in options["driver"]
    monkeypatch.setenv("TWINLAKE_SOURCE", f"parquet:{folder}/a")
    from twinlake.sources.registry import from_environment

    assert from_environment().check(spark, "default", "t")
    assert not registry.check(spark, "b", "none")


def test_prompt(spark, tmp_path):
    out = io.StringIO()
    repl = Repl(Gateway(spark, read_only=False), connect=lambda n: f"connected {n}", out=out)
    repl.loop(["select 1\n", " as x;\n", ".history\n", f".save {tmp_path}/r csv\n", ".connect a\n", ".nope\n", f".output {tmp_path}/o\n", "select 2 as y;\n", ".output\n", "select bad;\n", ".help\n", ".exit\n", "select 9;\n"])
    text = out.getvalue()
    assert "│ 1 │" in text and "connected a" in text and "unknown command" in text and "error:" in text and ".save file" in text and "9" not in repl.history[-1]
    assert (tmp_path / "r").read_text() == "x\n1\n" and "│ 2 │" in (tmp_path / "o").read_text()


def test_command_line(spark, folder, capsys, tmp_path):
    config = ["--config", str(folder / "sources.toml")]
    assert cli.main([*config, "sql", "select count(*) n from t", "--register", "a.t", "--format", "csv"], spark) == 0
    assert capsys.readouterr().out == "n\n10\n"
    assert cli.main([*config, "sql", "drop table t"], spark) == 2
    diff = [*config, "diff", "--left", "a", "--right", "b", "--table", "t"]
    assert cli.main([*diff, "--format", "json", "--output", str(tmp_path / "r.json")], spark) == 1
    report = json.loads((tmp_path / "r.json").read_text())
    assert report["summary"]["modified"] == 1 and report["strategy"] == "iblt" and report["sample_diffs"][0]["key"] == 3
    assert cli.main([*config, "diff", "--left", "a", "--right", "a", "--table", "t"], spark) == 0
    assert "modified" in capsys.readouterr().out
    assert cli.main([*diff, "--dry-run"], spark) == 0 and "key_domain | [0, 9]" in capsys.readouterr().out
    assert cli.main([*diff, "--where", "id = 1; x"], spark) == 2 and cli.main([*config, "diff", "--left", "a", "--right", "b"], spark) == 2
    assert cli.main([*config, "connections"], spark) == 0 and cli.main([*config, "check", "a", "t"], spark) == 0


def test_tool_server(spark, folder):
    server = ToolServer(spark, load_config(folder / "sources.toml"))
    ask = lambda tool, **arguments: server.answer({"id": 1, "method": tool, "params": arguments})
    assert ask("execute_query", sql="select id from range(4)", max_rows=3)["result"] == {"columns": ["id"], "rows": [[0], [1], [2]], "row_count": 3, "truncated": True}
    assert ask("execute_query", sql="drop table t")["error"]["data"]["error"] == "read_only"
    assert ask("delta_diff", left="a", right="b", table="t", strategy="keyeddiff")["result"]["summary"]["modified"] == 1
    assert ask("describe_table", table="t", connection="a")["result"]["columns"][0]["column_name"] == "id"
    assert {c["status"] for c in ask("list_connections")["result"]} == {"connected"}
    assert ask("nope")["error"]["code"] == -32601 and ask("database_info")["result"] and "Range" in ask("execution_plan", sql="select * from range(2)")["result"]
    out = io.StringIO()
    server.serve(io.StringIO('{"id": 2, "method": "list_connections"}\nnot json\n'), out)
    assert [("result" in json.loads(x)) for x in out.getvalue().splitlines()] == [True, False]


def test_database_source_end_to_end(spark, tmp_path):
    """A table in an embedded database, read by ranges of its key and compared with files."""
    from twinlake.diff import DiffOptions, diff
    from twinlake.sources.registry import Registry, Source

    rows = spark.range(100).selectExpr("cast(id as int) ID", "concat('v', id) V")
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows.write.jdbc(url, "T", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    rows.selectExpr("ID", "if(ID = 42, 'x', V) V").filter("ID <> 7").write.parquet(f"{tmp_path}/T.parquet")
    database = Source("db", "jdbc", f"derby:{tmp_path}/db", {"partitions": "4"}, {"T": ["ID"]}, timeout=30)
    registry = Registry([database, Source("files", "parquet", str(tmp_path), keys={"T": ["ID"]}), Source("bad", "jdbc", "derby:/nowhere/x", fallbacks=(database,))])
    df = registry.open(spark, "db", "T")
    assert df.rdd.getNumPartitions() == 4 and df.count() == 100 and registry.check(spark, "db", "T")
    pushed = df.filter("ID >= 10 and ID < 12").select("V")
    assert pushed.count() == 2 and "GreaterThanOrEqual(ID,10)" in pushed._jdf.queryExecution().toString()
    assert registry.open(spark, "bad", "T").count() == 100  # the alternative
    for strategy in ("hashdiff", "iblt", "keyeddiff"):
        result = diff(lambda: registry.open(spark, "db", "T"), lambda: registry.open(spark, "files", "T"), DiffOptions(strategy=strategy, fetch_all_threshold=0), declared_key=["ID"])
        assert {(r.key.ID, r.status) for r in result.diffs.collect()} == {(7, "MissingRight"), (42, "Modified")}


def test_balanced_database_reads(spark, tmp_path):
    from twinlake.sources.registry import Registry, Source

    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.range(1, 801).selectExpr(
        "id * id * id * id K", "concat(if(id > 500, 'it''s', 'z'), lpad(id % 331, 3, '0'), '-', id) S", "cast(id % 3 as int) A", "date_add(date'2020-02-28', cast(id * id as int)) B",
        "if(id % 10 = 0, null, cast(id as decimal(20,2))) N", "cast(1 as int) ONE",
    )
    rows.write.option("createTableColumnTypes", "S varchar(40)").jdbc(url, "T", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    want = sorted(map(repr, rows.select("K", "S", "A", "B").collect()))
    for key, parts in ((["K"], 4), (["S"], 4), (["A", "B"], 4), (["N"], 4), (["ONE"], 1), (["A"], 3)):
        registry = Registry([Source("db", "jdbc", f"derby:{tmp_path}/db", {"partitions": "4"}, {"T": key}, timeout=30)])
        df = registry.open(spark, "db", "T")
        assert df.rdd.getNumPartitions() == parts
        assert sorted(map(repr, df.select("K", "S", "A", "B").collect())) == want, key  # each row once
        sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == parts and max(sizes) <= 2 * 800 / parts, (key, sizes)
    one = Registry([Source("db", "jdbc", f"derby:{tmp_path}/db", {"partitions": "4"}, {"T": ["K"]})])
    assert one.open(spark, "db", "(select * from T where K < 0) t").rdd.getNumPartitions() == 1


def test_predicates_and_literals():
    from datetime import date
    from decimal import Decimal

    from twinlake.sources.registry import range_predicates, sql_literal

    assert [sql_literal(v, "oracle") for v in (7, Decimal("1.50"), "o'k\\", date(2024, 2, 9))] == ["7", "1.50", "'o''k\\'", "{d '2024-02-09'}"]
    assert sql_literal("o'k\\", "mysql") == "'o''k\\\\'"
    first, middle, last = range_predicates(["a", "b"], [["1", "2"], ["3", "4"]])
    assert first == "a is null or b is null or not (a > 1 or (a = 1 and (b >= 2)))"
    assert middle == "a is not null and b is not null and (a > 1 or (a = 1 and (b >= 2))) and not (a > 3 or (a = 3 and (b >= 4)))"
    assert last == "a is not null and b is not null and (a > 3 or (a = 3 and (b >= 4)))"


def test_model_context_client(spark, folder):
    lines = [
        {"jsonrpc": "2.0", "id": 1, "method": "initialize", "params": {"protocolVersion": "2024-11-05", "capabilities": {}, "clientInfo": {"name": "t", "version": "1"}}},
        {"jsonrpc": "2.0", "method": "notifications/initialized"},
        {"jsonrpc": "2.0", "id": 2, "method": "tools/list"},
        {"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "execute_query", "arguments": {"sql": "select 1 x"}}},
        {"jsonrpc": "2.0", "id": 4, "method": "tools/call", "params": {"name": "execute_query", "arguments": {"sql": "drop table t"}}},
        {"jsonrpc": "2.0", "id": 5, "method": "tools/call", "params": {"name": "nope"}},
        {"jsonrpc": "2.0", "id": 6, "method": "ping"},
    ]
    out = io.StringIO()
    server = ToolServer(spark, load_config(folder / "sources.toml"))
    server.serve(io.StringIO("".join(json.dumps(x) + "\n" for x in lines)), out)
    replies = {r["id"]: r for r in map(json.loads, out.getvalue().splitlines())}
    assert sorted(replies) == [1, 2, 3, 4, 5, 6] and replies[1]["result"]["protocolVersion"] == "2024-11-05" and "tools" in replies[1]["result"]["capabilities"]
    tools = {t["name"]: t for t in replies[2]["result"]["tools"]}
    assert set(tools) == set(server.tools) and tools["delta_diff"]["inputSchema"]["required"] == ["left", "right"]
    assert json.loads(replies[3]["result"]["content"][0]["text"])["rows"] == [[1]] and replies[3]["result"]["isError"] is False
    assert replies[4]["result"]["isError"] is True and "error" in replies[5] and replies[6]["result"] == {}


def test_analyze_and_run_leave_rows_in_their_tasks(spark):
    gateway = Gateway(spark)
    plan = gateway.explain("select id % 3 k, count(*) n from range(1000) group by 1", analyze=True)
    assert "3 rows" in plan and gateway.run("select id from range(100000)") is None


def test_stream_comparison(spark, tmp_path):
    from twinlake.streaming.incremental import compare_stream

    spark.range(6).selectExpr("id", "concat('v', id) v").write.parquet(f"{tmp_path}/in")
    reference = spark.range(100).selectExpr("id", "if(id = 2, 'other', concat('v', id)) v").filter("id <> 4")
    seen = {}
    stream = spark.readStream.schema("id long, v string").parquet(f"{tmp_path}/in")

    def keep(number, result):
        seen[number] = {r.key.id: r.status for r in result.diffs.collect()}

    compare_stream(stream, lambda: reference, ["id"], keep, checkpoint=f"{tmp_path}/cp").awaitTermination(120)
    assert {k: v for s in seen.values() for k, v in s.items()} == {2: "Modified", 4: "MissingRight"}
