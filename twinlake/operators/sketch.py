"""Invertible sketch of a keyed table: differences of two tables from summaries of a fixed size.

Keys are one integer, or of any number and type as 128-bit hashes. Every row is put in one cell of each of four sub-tables, by the four slices of its content hash modulo m. A
cell holds the number of its rows and the XORs of their keys and slices. Subtracting two sketches leaves the
rows that differ; cells with a single one are read off and peeled away until none is left.

m is the next prime from 3/4 of the capacity on: under a composite m sums of several rows pass for single rows
far more often. Cells that are not what they seem are skipped, and entries of equal key and hash on both
sides cancel out, so a decoded sketch is right up to collisions of 128-bit hashes.
"""

from __future__ import annotations

from collections import Counter, deque
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlake.functions.canonical import identifier
from twinlake.functions.hashing import half, hash_slice
from twinlake.plans.report import MISSING_LEFT, MISSING_RIGHT, MODIFIED
from twinlake.plans.tableplan import TablePlan

SUBTABLES = 4
MIN_CELLS = 16
VALUES = ("vx1", "vx2", "vx3", "vx4")


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def cells_for(capacity: int) -> int:
    """Cells of a sub-table for so many expected differences."""
    m = max(3 * capacity // 4, MIN_CELLS)
    while not _is_prime(m):
        m += 1
    return m


#: How cells hold keys: one integer as it is, any other key as the halves of its 128-bit hash.
INTEGER, HASHED = ("key_xor",), ("key_xor0", "key_xor1")
#: Strata of an estimate, by trailing zeros of a hash, and cells of a sub-table of each.
STRATA, STRATUM_CELLS = 32, 31
#: Entries that the sketch taken together with the strata can hold.
FIRST_CAPACITY = 2048


def _entries(df: DataFrame, plan: TablePlan, key: tuple[str, ...]) -> DataFrame:
    """(key columns, slices) of each row."""
    if key == INTEGER:
        hashes, k = {"k": identifier(plan.key_names[0]).cast("bigint"), "h": plan.content_hash()}, [F.col("k")]
    else:
        hashes, k = {"k": plan.key_hash(), "h": plan.identity_hash()}, [half(F.col("k"), i) for i in (0, 1)]
    rows = df.select(*(x.alias(n) for n, x in hashes.items()))
    return rows.select(*(x.alias(n) for x, n in zip(k, key)), *(hash_slice(F.col("h"), i).alias(v) for i, v in enumerate(VALUES)))


def _cells(entries: DataFrame, m: int, key: tuple[str, ...]) -> DataFrame:
    return _summed(entries, key, F.array(*(F.struct(F.lit(g + 1).alias("grp"), (F.col(v) % m).alias("cell")) for g, v in enumerate(VALUES))))


def _summed(entries: DataFrame, key: tuple[str, ...], places, *by: str) -> DataFrame:
    at = entries.withColumn("at", F.explode(places))
    groups = at.groupBy(*(F.col(f"at.{c}").alias(c) for c in (*by, "grp", "cell")))
    return groups.agg(F.count("*").alias("cnt"), *(F.bit_xor(c).alias(c) for c in (*key, *VALUES)))


def sketch(df: DataFrame, plan: TablePlan, m: int, key: tuple[str, ...] = INTEGER) -> DataFrame:
    """(grp, cell, cnt, key columns, vx1..vx4) of a table; at most 4 * m rows.

    key: INTEGER for one integer key (``key_xor``), HASHED for keys of any number and type (``key_xor0``, ``key_xor1``).
    """
    return _cells(_entries(df, plan, key), m, key)


def subtract(left: DataFrame, right: DataFrame, key: tuple[str, ...] = INTEGER, *by: str) -> DataFrame:
    """The cells of left minus right that are not empty."""
    both = left.unionByName(right.withColumn("cnt", -F.col("cnt")))
    out = both.groupBy(*by, "grp", "cell").agg(F.sum("cnt").alias("cnt"), *(F.bit_xor(c).alias(c) for c in (*key, *VALUES)))
    return out.filter(" or ".join(f"{c} <> 0" for c in ("cnt", *key, *VALUES)))


def strata(df: DataFrame, plan: TablePlan, key: tuple[str, ...] = INTEGER, m: int | None = None) -> DataFrame:
    """(stratum, grp, cell, ...): a small sketch of the rows of each stratum; half of all rows are in the first, a quarter in the
    second, and so on. With m also, from the same scan, the sketch of all rows with m cells a sub-table, as stratum -1. The
    number of cells is fixed, however large the table.
    """
    mixed = F.xxhash64(*VALUES)
    zeros = F.when(mixed == 0, STRATA - 1).otherwise(F.least(F.lit(STRATA - 1), F.bit_count(mixed.bitwiseAND(-mixed) - 1)))
    rows = _entries(df, plan, key).withColumn("stratum", zeros.cast("int"))
    kinds = [(F.col("stratum"), STRATUM_CELLS)] + ([(F.lit(-1), m)] if m else [])
    places = F.array(*(F.struct(k.alias("stratum"), F.lit(g + 1).alias("grp"), (F.col(v) % n).alias("cell")) for k, n in kinds for g, v in enumerate(VALUES)))
    return _summed(rows, key, places, "stratum")


def estimate(left: DataFrame, right: DataFrame, lplan: TablePlan, rplan: TablePlan, key: tuple[str, ...] = INTEGER) -> int:
    """About how many entries differ (a changed row is two)."""
    return estimated(subtract(strata(left, lplan, key), strata(right, rplan, key), key, "stratum").collect(), key)


def estimated(cells, key: tuple[str, ...] = INTEGER) -> int:
    """The estimate that the difference of two stacks of strata gives: they are decoded from the thinnest down; the first that
    cannot be decoded tells that there are as many below as its share says."""
    of: dict[int, list] = {}
    for r in cells:
        of.setdefault(r["stratum"], []).append(r)
    seen = 0
    for k in reversed(range(STRATA)):
        got = peel(of.get(k, []), STRATUM_CELLS, key)
        if not got.complete:
            return max(seen, 1) << (k + 1)
        seen += len(got.left) + len(got.right)
    return seen


def total_rows(cells: DataFrame) -> DataFrame:
    """(n,): rows behind a sketch, since each is in four cells."""
    return cells.agg((F.coalesce(F.sum("cnt"), F.lit(0)) / SUBTABLES).cast("bigint").alias("n"))


@dataclass
class Decoded:
    left: list[tuple[int | tuple, tuple]]
    right: list[tuple[int | tuple, tuple]]
    complete: bool


def peel(rows, m: int, key: tuple[str, ...] = INTEGER) -> Decoded:
    """Read single rows off the difference's cells (grp, cell, cnt, key columns, vx1..vx4) until none is left."""
    cells = {(r["grp"], r["cell"]): [r["cnt"], *(r[c] for c in (*key, *VALUES))] for r in rows}
    n = len(key)
    queue = deque(at for at, c in cells.items() if abs(c[0]) == 1)
    found: Counter = Counter()
    most = len(cells) + SUBTABLES * m  # entries that can be told apart; an overfull sketch could go on for ever
    while queue and most:
        most -= 1
        at = queue.popleft()
        c = cells.get(at)
        if c is None or abs(c[0]) != 1:
            continue
        sign, own, value = c[0], tuple(c[1 : n + 1]), tuple(c[n + 1 :])
        if value[at[0] - 1] % m != at[1]:
            continue  # several rows that look like one
        found[own[0] if n == 1 else own, value] += sign
        for g in range(SUBTABLES):
            place = (g + 1, value[g] % m)
            cell = cells.setdefault(place, [0] * (1 + n + len(VALUES)))
            cell[0] -= sign
            for i, x in enumerate((*own, *value)):
                cell[i + 1] ^= x
            if not any(cell):
                del cells[place]
            elif abs(cell[0]) == 1:
                queue.append(place)
    left = [e for e, c in found.items() for _ in range(max(0, c))]
    right = [e for e, c in found.items() for _ in range(max(0, -c))]
    return Decoded(left, right, not cells)


def classify(decoded: Decoded) -> list[tuple[int | tuple, str]]:
    """(key, status) by key."""
    left, right = {k for k, _ in decoded.left}, {k for k, _ in decoded.right}
    return sorted((k, MODIFIED if k in left and k in right else MISSING_RIGHT if k in left else MISSING_LEFT) for k in left | right)
