"""The pipeline against a plain version of each stage, and registered queries against SQL."""

import collections
import glob
import os
import re

import duckdb
import pytest

import corpus_pipeline
from twinlake.llm import common, decontam, oracles, registry, toxicity
from twinlake.llm.pii import KINDS

from .test_corpus_operators import PlainToxicity, groups_of, sets_of
from .test_text_operators import plain_spans

SF = "/root/testdata/sf0.001"


def plain_redaction(text):
    spans = [(int(a), int(b), k) for k, a, b in (s.split(":") for s in plain_spans(text))]
    out, at = "", 0
    for a, b, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))):
        if a >= at:
            out += text[at:a] + f"[{kind.upper()}]"
        at = max(at, b)
    return out + text[at:]


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = toxicity.fit(docs, common.table(spark, SF, "labels", "doc_id", "toxic"))
    plain = PlainToxicity(toxicity.labelled_sample(docs, common.table(spark, SF, "labels", "doc_id", "toxic")).collect())
    plain.decay, plain.scale, plain.base, plain.slope = model.decay, model.scale, model.base, model.slope  # compared in test_corpus_operators
    left = {i for i, r in rows.items() if plain.score(r.text) < corpus_pipeline.TOXIC}
    order = sorted(left)
    groups = groups_of(sets_of([rows[i].text for i in order], 5), 80)
    left = {order[k] for k, g in groups.items() if k == g}
    grams = {i: (decontam._hashes([t])[0]) for i, t in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    for i in sorted(left):
        (w,) = decontam._hashes([rows[i].text])
        if any(decontam.overlap(item, w) == 1.0 for item in grams.values()):
            left.discard(i)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == left and len(got) < len(rows)
    for i, r in got.items():
        assert r.text == plain_redaction(rows[i].text) and r.n_chars == len(r.text) and (r.lang, r.source) == (rows[i].lang, rows[i].source)
        assert r.copies >= 1 and len(r.blocks.split(",")) == r.copies
    weights = {r.source: r.weight_ppm for r in got.values()}
    assert abs(sum(weights.values()) - 1_000_000) < 50


def test_stages_keep_the_columns_and_survive_odd_rows(spark, edge, nothing):
    """All columns of the fixture through all stages, against a plain version of what each does to these rows."""
    more = "id long, of string, copies long, blocks string, n_tokens string, weight_ppm int, rest int, n int, a int, b string"
    names = [c.split()[0] for c in more.split(", ")]
    for start in (edge, nothing):
        start = start.drop("id").selectExpr("*", *(f"cast({k} as {c.split()[1]}) as {c.split()[0]}" for k, c in enumerate(more.split(", "))))
        columns, docs = start.columns, start
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = common.written(stage(spark, docs, SF))
            assert k == 4 or docs.columns == columns
        got = docs.collect()
        # nothing is toxic or in the benchmark here; of equal texts the smallest id stays, and of repeated rows one
        want = []
        for r in sorted(start.collect(), key=lambda r: (r.doc_id is None, r.doc_id)):
            words = tuple((r.text or "").encode().lower().split())
            if r.doc_id is None or not words or not any(words == w for w, _ in want) and r.doc_id != 8:
                want.append((words, r))
        assert sorted(repr(r.doc_id) for r in got) == sorted(repr(r.doc_id) for _, r in want)
        by_id = {r.doc_id: r for _, r in want}
        replaced = {"text", "n_chars", "n_tokens", "weight_ppm", "copies", "blocks"}
        for r in got:
            old = by_id[r.doc_id]
            assert [r[c] for c in columns if c not in replaced] == [old[c] for c in columns if c not in replaced]
            assert r.text == (None if old.text is None else plain_redaction(old.text)) and r.n_chars == (old.n_chars if r.text is None else len(r.text))
            assert r.copies >= 1 and r.n_tokens == len((r.text or "").split())
        assert sorted(docs.columns) == sorted(columns) and set(names) <= set(docs.columns)
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity" and len(corpus_pipeline.STAGES) == 5


def test_clean_rows_survive_an_empty_labels_table(spark, edge, tmp_path):
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.toxicity_stage(spark, edge, str(tmp_path)).count() == edge.count()


def test_one_of_repeated_rows_survives_near_duplicates(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "a"), (1, text, "a"), (1, text, "b"), (2, text, "a"), (3, None, "a"), (3, None, "a"), (4, "x y", "a"), (4, "p q", "a"), (5, text + " x", "a"), (None, None, "a"), (None, None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = corpus_pipeline.near_duplicate_stage(spark, docs, SF)
    assert got.columns == docs.columns
    want = [(1, text, "a"), (3, None, "a"), (4, "p q", "a"), (4, "x y", "a"), (None, None, "a"), (None, None, "a")]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


def as_rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([r[i] for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_registered_queries_against_sql(spark, duck, name):
    df, want = registry.queries()[name](spark, SF), duck.sql(oracles.SQL[name])
    assert as_rows(df.columns, df.collect()) == as_rows(want.columns, want.fetchall())


def test_every_operator_is_registered(spark):
    numbers = collections.Counter(re.match(r"op(\d+)_", n)[1] for n in registry.queries() if n.startswith("op"))
    assert numbers == {str(n): 1 for n in range(1, 14)}
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op1_language", "op3_near_duplicates", "op5_media", "op6_licenses", "op8_toxicity", "op9_mixing", "op10_repeats"):
        assert registry.queries()[name](spark, SF).count() == n, name


def test_one_id_with_two_texts_is_two_documents(spark):
    """Each has copies and tokens of its own in the mixture."""
    rows = [(1, "a b c", "s"), (1, "d e f g", "s"), (2, "h i", "s"), (3, "j " * 9, "t"), (None, "k l", "t"), (4, None, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {(r.doc_id, r.text): (r.n_tokens, r.copies) for r in corpus_pipeline.mixing_stage(spark, docs, None).collect()}
    assert got == {(i, t): (len((t or "").split()), 1) for i, t, _ in rows}


def test_mixing_sql_keeps_documents_without_tokens(spark):
    """The SQL counterpart on sources whose epochs end in documents without tokens."""
    import duckdb
    import pandas as pd

    from twinlake.llm.mixing import mix_sources
    from twinlake.llm.oracles import SQL

    rows = [(i, "" if i % 3 else "w " * (i % 11 + 1), "big" if i % 5 else "small") for i in range(150)] + [(900 + i, None, "small") for i in range(9)]
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "source"])  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.sql(SQL["op9_mixing"])
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall()) and got.count() == len(rows)
