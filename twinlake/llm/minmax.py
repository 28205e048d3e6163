"""Near duplicates by min-max hashing: under each permutation both the smallest and the largest value
of a shingle set are kept, so half as many permutations are evaluated for a signature of a given length.

1. Each text becomes its set of k-word shingles (64-bit hashes) and its signature, cut into bands.
2. Texts with equal sets form a class, stood for by its smallest id; only classes are banded.
3. In each bucket (band value) every member is compared with the bucket's smallest member, on full sets.
4. Linked classes are joined into components. Members of buckets that still hold several components
   are then compared across components, so no candidate is left untested: pairs inside a component
   are connected already, and of the others only those that share enough of their rarest shingles to
   reach the similarity are emitted (an exact filter by order and place, see ``across_labels``).

With ROWS values a band, two sets of similarity s share some band with probability
1 - (1 - s**ROWS)**BANDS: more than 0.99999 at 0.8.

Cases: a text without words (null, empty, only spaces) has an empty set and is linked with nothing; a
text with fewer than k words is one shingle; repeated rows with one id and text count as copies, whose set
is made and compared once; rows of one id with different texts are one document: it is linked with all that any of its
texts links with, and all its rows have one component (``n_shingles`` is that of the row's own text); a row
without an id cannot stand for others: it gets the component of a row with an equal text and an id, if there
is one, else null, and is always kept (two rows without an id are not compared with each other); an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlake.llm.common import SPACED, U64, Scratch, Words, bounded_batches, mix, words_of, written
from twinlake.llm.components import components, merged

ROWS = 6
BANDS = 42
PERMUTATIONS = ROWS * BANDS // 2
SEED = 20240501
#: Text bytes hashed at a time, so that one permutation's values stay in cache.
HASH_BYTES = 640 << 10
_STEP = U64(0x9FB21C651E98DF25)


def permutations(n: int = PERMUTATIONS) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of n permutations x -> a * x + b of the 32-bit numbers."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, bounds): the sorted distinct shingle hashes of each row."""
    h, bounds, counts = words.hashes(), words.bounds, words.counts
    n = len(h)
    shingles = np.zeros(max(0, n - k + 1), U64)
    for j in range(k):
        shingles = shingles * _STEP + h[j : n - k + 1 + j] if n >= k else shingles
    shingles = mix(shingles)
    out, sizes = [], np.zeros(len(counts), np.int64)
    for row, count in enumerate(counts):
        if not count:
            continue
        first = bounds[row]
        if count < k:
            value = np.array([count], U64)
            for w in h[first : first + count]:
                value = (value * _STEP) ^ w
            out.append(mix(value))
        else:
            out.append(np.unique(shingles[first : first + count - k + 1]))
        sizes[row] = len(out[-1])
    return np.concatenate(out) if out else np.zeros(0, U64), np.concatenate([[0], np.cumsum(sizes)])


def min_max(values: np.ndarray, bounds: np.ndarray, n: int = PERMUTATIONS) -> np.ndarray:
    """rows x 2n: the minima, then the maxima under n permutations; rows with an empty set are 0."""
    sizes = np.diff(bounds)
    full = np.flatnonzero(sizes)
    out = np.zeros((2 * n, len(sizes)), np.uint32)
    if len(full):
        x, starts = (values >> U64(32)).astype(np.uint32), bounds[:-1][full]
        for p, (a, b) in enumerate(zip(*permutations(n))):
            y = x * a
            y += b
            out[p, full] = np.minimum.reduceat(y, starts)
            out[n + p, full] = np.maximum.reduceat(y, starts)
    return out.T


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """rows x bands of 64-bit keys; the band's number is part of its key."""
    parts = signature.astype(U64).reshape(len(signature), -1, rows)
    keys = np.broadcast_to(np.arange(1, parts.shape[1] + 1, dtype=U64), parts.shape[:2]).copy()
    for r in range(rows):
        keys = mix(keys * _STEP + parts[:, :, r])
    return keys


def signatures(df: DataFrame, k: int, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, k1 and k2 (a 128-bit key of the set), bands (array of band keys)."""
    bounded_batches(df.sparkSession)
    rows = df.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))

    def build(batches):
        for batch in batches:
            for i, j, words in words_of(batch.column(1), SPACED, HASH_BYTES):
                values, bounds = shingle_sets(words, k)
                sizes = np.diff(bounds)
                sums = np.zeros((2, j - i), U64)
                if full := np.flatnonzero(sizes).tolist():
                    for s, salt in enumerate((0x51ED270B, 0x2545F491)):
                        sums[s, full] = np.add.reduceat(mix(values + U64(salt)), bounds[:-1][full])
                keys = band_keys(min_max(values, bounds)).astype(np.int64)
                at = np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(sizes), *(pa.array(s.view(np.int64)) for s in sums), pa.ListArray.from_arrays(pa.array(at), pa.array(keys.ravel()))],
                    ["doc_id", "n_shingles", "k1", "k2", "bands"],
                )

    return rows.mapInArrow(build, f"doc_id {dict(rows.dtypes)['doc_id']}, n_shingles long, k1 long, k2 long, bands array<long>")


def full_sets(df: DataFrame, k: int, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id and its whole shingle set as array<long>."""
    bounded_batches(df.sparkSession)
    rows = df.select(F.col(id).alias("id"), F.col(text).alias("text"))

    def build(batches):
        for batch in batches:
            for i, j, words in words_of(batch.column(1), SPACED):
                values, bounds = shingle_sets(words, k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))], ["id", "shingles"]
                )

    return rows.mapInArrow(build, f"id {dict(rows.dtypes)['id']}, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    sets = sets.select("id", "shingles")
    both = pairs.join(sets.withColumnsRenamed({"id": "a", "shingles": "x"}), "a").join(sets.withColumnsRenamed({"id": "b", "shingles": "y"}), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.filter(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b").distinct()


def across_labels(reps: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of ids under different labels of which two sets can reach the similarity; none that does is left out.

    reps: id, label. sets: id, u, shingles; u tells apart the sets of an id that has several. Shingles are ordered by how many of these sets hold them, those held under one label
    only first. If the first shingle that two sets share stands at places i and j of their orders, they share
    at most min(n_i - i, n_j - j), which must reach the intersection that the similarity needs; so only the
    first few, rare shingles of each set are compared. Work is in proportion to the sets' sizes and to the
    pairs that share a rare shingle, not to the square of a bucket.
    """
    one = ["id", "label", "u", "n"]
    spread = sets.withColumn("n", F.size("shingles").cast("long")).join(reps, "id").select(*one, F.explode("shingles").alias("shingle"))
    held = spread.groupBy("shingle").agg(F.count("*").alias("df"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("shingle", "df")
    order = spread.join(held, "shingle").groupBy(*one).agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("order"))
    order = order.withColumn("own", F.expr("n - size(order)"))
    prefix = F.expr(f"slice(order, 1, cast(greatest(0, n - ceil({percent} * n / 100) + 1 - own) as int))")
    first = order.select("id", "label", "n", "own", F.posexplode(prefix).alias("i", "s")).selectExpr("id", "label", "n", "own + i as place", "s.shingle as shingle")
    first = scratch.written(first)
    enough = f"{100 + percent} * least(x.n - x.place, y.n - y.place) >= {percent} * (x.n + y.n)"
    pairs = first.alias("x").join(first.alias("y"), F.expr(f"x.shingle = y.shingle and x.label < y.label and {enough}"))
    return pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def near_duplicates(df: DataFrame, *, k: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links), kept (whether it is its own)."""
    docs = df.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    sig = written(signatures(docs, k))
    # documents without words get keys of their own: no class, and no hot key
    alone = F.col("n_shingles") == 0
    keyed = sig.withColumn("k1", F.when(alone, F.xxhash64("doc_id")).otherwise(F.col("k1")))
    classes = written(keyed.filter(~alone).groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")))

    with Scratch(df.sparkSession) as scratch:
        banded = keyed.filter(~alone).join(classes, ["k1", "k2"]).filter("doc_id = rep")
        spread = banded.select("rep", "n_shingles", F.explode("bands").alias("bucket"))
        hubs = spread.groupBy("bucket").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).filter("hub < last").drop("last")
        shared = scratch.written(spread.join(hubs, "bucket"))
        # ids of several rows: their sets are made once each, and the classes of different texts are linked
        ids = keyed.filter(F.col("doc_id").isNotNull()).groupBy("doc_id")
        differ = (F.min("k1") < F.max("k1")) | (F.min("k2") < F.max("k2"))
        repeated = scratch.written(ids.agg(F.count("*").alias("rows"), differ.alias("differ")).filter("rows > 1").select("doc_id", "differ"))
        asked = docs.join(shared.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
        once, again = asked, None
        if not repeated.isEmpty():
            once, again = asked.join(repeated, "doc_id", "left_anti"), full_sets(asked.join(repeated, "doc_id", "left_semi"), k).filter("size(shingles) > 0").distinct()
        sets = full_sets(once, k).withColumn("u", F.lit(0).cast("long"))
        if again is not None:
            sets = sets.unionByName(again.withColumn("u", F.xxhash64("shingles")))
        sets = scratch.written(sets)
        of_one_id = keyed.filter(~alone).join(repeated.filter("differ"), "doc_id", "left_semi").join(classes, ["k1", "k2"])
        of_one_id = of_one_id.filter("rep < doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()

        sizes = shared.filter("rep = hub").select(F.col("rep").alias("hub"), F.col("n_shingles").alias("hub_size")).distinct()
        star = shared.filter("rep > hub").select("hub", "rep", "n_shingles").distinct().join(sizes, "hub")
        star = star.filter(f"100 * least(n_shingles, hub_size) >= {percent} * greatest(n_shingles, hub_size)")
        star = scratch.written(star.select(F.col("hub").alias("a"), F.col("rep").alias("b")))
        links = confirmed(star, sets, percent)
        if again is not None:
            links = links.unionByName(of_one_id)
        links = scratch.written(links)
        found = components(links)

        # buckets that hold more than one component: pairs between components that were not compared
        labelled = shared.select("bucket", "rep", "n_shingles").join(found.withColumnRenamed("id", "rep"), "rep", "left").withColumn("label", F.coalesce("component", "rep")).drop("component")
        mixed = labelled.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("bucket")
        rest = scratch.written(labelled.join(mixed, "bucket").select(F.col("rep").alias("id"), "label").distinct())
        across = scratch.written(across_labels(rest, sets, percent, scratch).join(star, ["a", "b"], "left_anti"))
        if not across.isEmpty():
            label = rest.select("id", "label")
            ends = [label.withColumnsRenamed({"id": end, "label": f"{end}_label"}) for end in ("a", "b")]
            new = confirmed(across, sets, percent).join(ends[0], "a").join(ends[1], "b")
            found = written(merged(found, new.select(F.col("a_label").alias("a"), F.col("b_label").alias("b"))))

    out = keyed.select("doc_id", "n_shingles", "k1", "k2").join(classes, ["k1", "k2"], "left")
    # a row without words is in no class, but its document may be linked by another text
    out = out.withColumn("id", F.coalesce("rep", "doc_id")).join(found, "id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
