"""Ranked lexical search: pipelined term partitioning with integer scores.

The terms are dealt to owners by the share of documents that hold them, rare ones first (``OWNERS``). Each item
travels as a bundle with its weighted terms and a sparse accumulator of documents, from owner to owner; at
each stage a cogroup brings the bundles to the owner's postings, and the owner adds what its terms contribute.

* A common term's postings are no single task's: documents are dealt into blocks of about ``BLOCK``, and a bundle
  has a part for each block, so stages are dealt out by block (and by group of ``BUNDLES`` items).
* A bundle drops a document only if no rest could bring it among the block's ``top`` best: what it has, and the most that
  terms of later owners gave to any document, stays below what ``top`` documents of the block have already. Documents
  not met yet are open to later owners until the same holds for them. So nothing that could be in the result is lost.
* The last stage leaves ``top`` documents a block at most; a window over them, limited before it is shuffled, gives the result.

Contributions are integers, so neither order nor partitioning changes a score. A document's terms are taken from its text
only if they pass a bit filter of the items' terms (of a fixed size, whatever the benchmark's); the join with the exact terms
follows.

Cases: null texts and texts without terms are no documents and no items; repeated rows are documents (or items) of
their own, with equal scores; null ids of documents come last among ties; an empty table gives no rows; columns beside
id and text are not looked at. A document that fits an item with weights of 0 only is not listed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinlake.llm.common import ALNUM, U64, Scratch, bounded_batches, words_of, written

#: Shares of the documents up to which an owner's terms occur; the last owner has the rest.
OWNERS = (0.001, 0.01, 0.1)
BLOCK, BUNDLES = 8192, 256
#: Bits of the filter of the items' terms: 128 KiB.
FILTER_BITS = 20


def _terms(table: DataFrame, id_name: str, text_name: str, passing=None) -> DataFrame:
    """(id, n, terms, tf): for each row its number of terms, and its distinct terms that pass the filter."""
    bounded_batches(table.sparkSession)
    kind = table.schema[id_name].dataType.simpleString()

    def work(batches):
        for batch in batches:
            for i, j, w in words_of(batch.column(1), ALNUM):
                h, row = w.hashes(), w.rows()
                if passing is not None:
                    k = np.flatnonzero(passing.value[h >> U64(64 - FILTER_BITS)])
                    h, row = h[k], row[k]
                else:
                    k = np.arange(len(h))
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                head = np.ones(len(h), bool)
                head[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                first = np.flatnonzero(head)
                tf = np.diff(np.append(first, len(h)))
                k = k[order[first]]
                size = w.end[k] - w.start[k]
                begin = np.cumsum(size) - size
                data = w.data[np.repeat(w.start[k] - begin, size) + np.arange(int(size.sum()))]
                strings = pa.StringArray.from_buffers(len(k), pa.py_buffer(np.append(begin, size.sum()).astype(np.int32)), pa.py_buffer(data))
                at = pa.array(np.searchsorted(row[first], np.arange(j - i + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(at, x) for x in (strings, pa.array(tf, pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(w.counts, pa.int64()), *lists], ["id", "n", "terms", "tf"])

    return table.select(id_name, text_name).mapInArrow(work, f"id {kind}, n long, terms array<string>, tf array<int>")


def _filter(items: DataFrame) -> np.ndarray:
    """Bits set by the hashes of all terms of the items; at most 2 ** FILTER_BITS / 32 rows reach the driver."""

    def work(batches):
        for batch in batches:
            for _, _, w in words_of(batch.column(0), ALNUM):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(w.hashes() >> U64(64 - FILTER_BITS)).astype(np.int64))], ["bit"])

    bits = items.select("text").mapInArrow(work, "bit long")
    words = bits.groupBy((F.col("bit") / 32).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 32 as int)))").alias("bits")).collect()
    out = np.zeros(1 << FILTER_BITS, bool)
    for word, value in words:
        out[word * 32 : word * 32 + 32] = [value >> k & 1 for k in range(32)]
    return out


def _stage(owner: int, top: int, last: bool):
    """What one owner does with the bundles and its postings of one block."""

    def add(bundles: pa.Table, postings: pa.Table) -> pa.Table:
        tid = postings.column("tid").to_numpy()
        order = np.argsort(tid, kind="stable")
        doc, part = postings.column("doc").to_numpy()[order], postings.column("part").to_numpy()[order].astype(np.int64)
        known, first = np.unique(tid[order], return_index=True)
        bound = np.append(first, len(tid))
        slot = dict(zip(known.tolist(), range(len(known))))
        size = max(int(doc.max(initial=-1)), *(max(x, default=-1) for x in bundles.column("docs").to_pylist()), -1) + 1
        docs, scores, opens, floors = [], [], [], []
        for terms, own, points, is_open, floor in zip(*(bundles.column(c).to_pylist() for c in ("terms", "docs", "scores", "open", "floor"))):
            sums = np.zeros(size, np.int64)
            sums[own] = points
            rest = 0
            for t in terms:
                if t["owner"] == owner and (k := slot.get(t["tid"])) is not None:
                    a, b = bound[k], bound[k + 1]
                    sums[doc[a:b]] += t["weight"] * part[a:b]
                elif t["owner"] > owner:
                    rest += t["weight"] * t["most"]
            if not is_open:  # only documents that the bundle carries count
                closed = np.ones(size, bool)
                closed[own] = False
                sums[closed] = 0
            met = np.flatnonzero(sums)
            value = sums[met]
            if len(met) >= top:
                floor = max(floor, int(np.partition(value, len(value) - top)[len(value) - top]))
            stay = value + rest >= floor
            met, value = met[stay], value[stay]
            if last:  # documents of a block are numbered in the order of their ids
                best = np.lexsort((met, -value))[:top]
                met, value = met[best], value[best]
            docs.append(met)
            scores.append(value)
            opens.append(is_open and rest >= floor)
            floors.append(floor)
        out = {
            "docs": pa.array(docs, pa.list_(pa.int32())), "scores": pa.array(scores, pa.list_(pa.int64())), "open": pa.array(opens, pa.bool_()), "floor": pa.array(floors, pa.int64()),
        }
        for name, column in out.items():
            bundles = bundles.set_column(bundles.schema.get_field_index(name), name, column)
        return bundles

    return add


def rank(docs: DataFrame, items: DataFrame, top: int = 20, owners: tuple[float, ...] = OWNERS, block: int = BLOCK, bundle: int = BUNDLES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of each item by score, equal scores by doc_id.

    docs: doc_id, text; items: item_id, text.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        wanted = _terms(items.select("item_id", "text"), "item_id", "text").withColumn("item", F.monotonically_increasing_id())
        wanted = scratch.written(wanted.filter("n > 0").selectExpr("item", "id as item_id", "inline(arrays_zip(terms, tf))").withColumnRenamed("terms", "term"))
        n_items = wanted.agg(F.count_distinct("item")).first()[0]
        passing = spark.sparkContext.broadcast(_filter(items))
        held = _terms(docs.select("doc_id", "text"), "doc_id", "text", passing).withColumn("row", F.monotonically_increasing_id())
        held = scratch.written(held.filter("n > 0"))
        n_docs, n_terms = held.agg(F.count("*"), F.sum("n")).first()
        n_docs, n_terms = n_docs or 0, n_terms or 1

        blocks, groups = max(1, -(-n_docs // block)), max(1, -(-n_items // bundle))
        # documents of a block by their ids, numbered alike whenever this is computed
        placed = held.withColumn("block", F.expr(f"cast(pmod(xxhash64(row), {blocks}) as int)"))
        placed = placed.withColumn("doc", F.row_number().over(Window.partitionBy("block").orderBy(F.asc_nulls_last("id"), "row")) - 1)
        m = f"(75 + (25L * n * {n_docs}L) div {n_terms}L)"
        part = f"cast((1000000000L * tf) div (1000L * tf + 12L * {m}) as int)"

        wanted = wanted.withColumn("grp", F.expr(f"cast(pmod(xxhash64(item), {groups}) as int)"))
        asked = wanted.select("term").distinct()
        known = held.selectExpr("n", "inline(arrays_zip(terms, tf))").withColumnRenamed("terms", "term").groupBy("term").agg(F.count("*").alias("df"), F.max(F.expr(part)).alias("most"))
        share = f"df / {float(max(n_docs, 1))}D"
        owner = " + ".join(f"cast({share} > {x}D as int)" for x in owners) or "0"
        known = known.join(asked, "term", "left_semi").selectExpr("term", "most", f"cast({owner} as int) as owner", f"cast(floor(1000 * ln(({2.0 * n_docs + 2}D) / (2 * df + 1))) as long) as w")
        known = scratch.written(known.filter("w > 0").withColumn("tid", F.monotonically_increasing_id()))

        in_groups = known.join(wanted.select("term", "grp").distinct(), "term").select("term", "tid", "owner", "grp")
        postings = placed.selectExpr("block", "doc", "n", "inline(arrays_zip(terms, tf))").withColumnRenamed("terms", "term")
        postings = postings.join(in_groups, "term").selectExpr("owner", "block", "grp", "doc", "tid", f"{part} as part")
        postings = scratch.written(postings, "owner")

        bundles = wanted.join(known, "term").groupBy("item", "item_id", "grp").agg(F.collect_list(F.expr("struct(owner, tid, w * tf as weight, most)")).alias("terms"))
        bundles = bundles.selectExpr("grp", "item", "item_id", "terms", "cast(array() as array<int>) as docs", "cast(array() as array<long>) as scores", "true as open", "0L as floor", f"explode(sequence(0, {blocks - 1})) as block")
        for k in range(len(owners) + 1):
            own = postings.filter(F.col("owner") == k).drop("owner")
            bundles = bundles.groupBy("block", "grp").cogroup(own.groupBy("block", "grp")).applyInArrow(_stage(k, top, k == len(owners)), bundles.schema)

        found = bundles.selectExpr("item", "item_id", "block", "inline(arrays_zip(docs, scores))").selectExpr("item", "item_id", "block", "docs as doc", "scores as score")
        found = found.join(placed.select("block", "doc", F.col("id").alias("doc_id")), ["block", "doc"])
        best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "block", "doc")
        return written(found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score"))
