"""Checksums of a generated table with known results, and the canonical text of each type."""

from datetime import date, datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlake.functions.canonical import NULL_TEXT, canonical
from twinlake.operators import checksum
from twinlake.plans.tableplan import build_plan

SCHEMA = T.StructType(
    [
        T.StructField("id", T.IntegerType(), False),
        T.StructField("c_int", T.IntegerType()),
        T.StructField("c_dec", T.DecimalType(20, 6)),
        T.StructField("c_dt", T.TimestampNTZType()),
        T.StructField("c_vc", T.StringType()),
        T.StructField("c_bool", T.BooleanType()),
        T.StructField("c_null", T.IntegerType()),
    ]
)
# Fixed values: (count, s1..s4) of the whole table, of id ranges, and of content buckets modulo 8.
FULL = (2000, 4293099433729, 4275267308051, 4364607963383, 4330587217815)
RANGES = {
    (1, 501): (500, 1064196839000, 1068686584681, 1080543061165, 1066997102988),
    (501, 1001): (500, 1122843696143, 1062954607725, 1133607091891, 1077065928821),
    (1001, 1501): (500, 1035224864720, 1097601475145, 1070489420525, 1086511626984),
    (1501, 2001): (500, 1070834033866, 1046024640500, 1079968389802, 1100012559022),
}
BUCKETS = {
    0: (245, 549822180512, 515657691924, 553818034052, 536840733190),
    3: (263, 583225029093, 571815727873, 576017843525, 592234638855),
    7: (246, 508680309066, 524137411420, 504816615475, 528987509231),
}


def table(spark):
    """2000 rows from a 64-bit linear congruence; each column is NULL at multiples of a number of its own."""
    state, rows = 20260817, []
    for i in range(1, 2001):
        state = (state * 6364136223846793005 + 1442695040888963407) & (2**64 - 1)
        r = state >> 16
        values = {
            11: r % 200000 - 100000,
            13: Decimal((r >> 8) % (4 * 10**12) - 2 * 10**12).scaleb(-6),
            17: datetime(2023, 1, 1) + timedelta(days=i % 365, seconds=(r >> 20) % 86400),
            19: f"vc-{r % 10**6:06d}-x" if i > 1 else "unicode-汉字-🙂",
            23: (r >> 30) % 2 == 0,
            7: (r >> 12) % 100000,
        }
        rows.append((i, *(None if i % n == 0 else v for n, v in values.items())))
    return spark.createDataFrame(rows, SCHEMA)


def numbers(df):
    return tuple(int(x) for x in df.first())


def test_known_checksums(spark):
    df = table(spark).cache()
    plan = build_plan(df, key=["id"])
    assert numbers(checksum.checksum(df, plan)) == FULL
    for (lo, hi), want in RANGES.items():
        assert numbers(checksum.checksum_range(df, plan, lo, hi)) == want
    for b, want in BUCKETS.items():
        assert numbers(checksum.checksum_bucket(df, plan, 8, b)) == want
    batch = {int(r.bkt): tuple(int(x) for x in list(r)[1:]) for r in checksum.batch_checksum(df, plan, 8).collect()}
    assert all(batch[b] == want for b, want in BUCKETS.items())
    assert sum(v[0] for v in batch.values()) == FULL[0]
    df.unpersist()


def test_canonical_text_of_each_type(spark):
    schema = "a int, b decimal(10,2), c boolean, d date, e timestamp_ntz, f binary, g string, h double"
    df = spark.createDataFrame([(1, Decimal("0.00"), True, date(2024, 2, 3), datetime(2024, 2, 3, 4, 5, 6, 7), b"\x0a\xff", "x#y", 0.5), (None,) * 8], schema)
    rows = df.select(*(canonical(f).alias(f.name) for f in df.schema)).collect()
    assert list(rows[0]) == ["1", "0.00", "1", "2024-02-03", "2024-02-03 04:05:06.000007", "0AFF", "x#y", "0.5"]
    assert list(rows[1]) == [NULL_TEXT] * 8
    assert df.select(canonical(df.schema["h"], scale=3)).first()[0] == "0.500"


def test_exact_mode_tells_apart_what_the_separator_does_not(spark):
    df = spark.createDataFrame([("a#b", "c"), ("a", "b#c")], "x string, y string")
    plain, exact = build_plan(df), build_plan(df, exact=True)
    assert df.select(plain.content_hash()).distinct().count() == 1
    assert df.select(exact.content_hash()).distinct().count() == 2


def test_sum_is_modulo_two_to_the_64(spark):
    from twinlake.functions.hashing import sum_modulo

    n = spark.range(1000).select(sum_modulo(F.lit(4294967295).cast("bigint"))).first()[0]
    assert int(n) == 1000 * 4294967295
    assert int(spark.range(0).select("id").agg(sum_modulo(F.col("id"))).first()[0]) == 0


def test_crc_chain_against_zlib(spark):
    import zlib

    from twinlake.functions.canonical import NULL_TEXT
    from twinlake.functions.hashing import crc_hash
    from twinlake.plans.tableplan import build_plan

    df = spark.createDataFrame([(1, "a", None), (2, "", 5), (3, "é#", -7)], "id int, v string, n long")
    got = {r.id: r.crc for r in df.select("id", crc_hash(build_plan(df).normalized()).alias("crc")).collect()}
    for row in df.collect():
        assert got[row.id] == zlib.crc32("#".join(NULL_TEXT if x is None else str(x) for x in row).encode())
