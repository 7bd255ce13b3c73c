import datetime
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fluxnest.operators import dedup, sessions, skew

GAP = 1000


def brute(rows, gap):
    by = defaultdict(list)
    for d, t in rows:
        if d is not None and t is not None:
            by[d].append(t)
    out = []
    for d, ts in by.items():
        ts.sort()
        start = prev = ts[0]
        n = 0
        for t in ts:
            if t - prev > gap:
                out.append((d, start, prev, n))
                start, n = t, 0
            prev, n = t, n + 1
        out.append((d, start, prev, n))
    return sorted(out)


def test_sessions_equal_brute_force(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("abc"), rnd.randrange(-20_000, 200_000)) for _ in range(300)]
    rows += [("long", t) for t in range(0, 60_000, 1000)] + [("edge", 0), ("edge", 1000), ("edge", 2001), ("hot", 5)] + [("hot", 5)] * 50
    rows += [(None, 3), ("x", None)]
    df = spark.createDataFrame([(d, t, "c") for d, t in rows], "device string, t bigint, cell string")
    got = sorted(tuple(r) for r in sessions.sessionise(df, "device", "t", GAP).collect())
    assert got == brute(rows, GAP)
    assert sessions.sessionise(df.limit(0), "device", "t", GAP).count() == 0


def test_clean_ifa_and_times(spark):
    good = "0123456789abcdef0123456789abcdef"
    rows = [(good.upper(), good), ("{01234567-89ab-cdef-0123-456789abcdef}", good), ("0" * 32, None), ("", None), (None, None), (good + "0", None), ("ifa:null", None)]
    df = spark.createDataFrame([(a,) for a, _ in rows], "a string")
    assert [r[0] for r in df.select(sessions.clean_ifa(F.col("a"))).collect()] == [b for _, b in rows]
    t = spark.sql("SELECT sessions FROM VALUES (TIMESTAMP '1970-01-01 00:00:00'), (TIMESTAMP '1970-01-01 00:00:00.0019'), (TIMESTAMP '1969-12-31 23:59:59.9995'), (NULL) AS t(sessions)")
    assert [r[0] for r in t.select(sessions.event_ms(F.col("sessions"))).collect()] == [None, 1, -1, None]


def test_heavy_hitters(spark):
    rnd = random.Random(1)
    values = ["hot"] * 400 + ["warm"] * 30 + [f"v{i}" for i in range(500)] + [""] * 40 + [None] * 30
    rnd.shuffle(values)
    df = spark.createDataFrame([(v, "k" if i % 3 else None, 1) for i, v in enumerate(values)], "s string, value string, field int").repartition(7)
    got = {(r.field, r.value, r.n) for r in skew.heavy_hitters(df, ["s", "value"], 0.03).collect()}
    n = sum(1 for i in range(len(values)) if i % 3)
    assert got == {("s", "hot", 400), ("s", "warm", 30), ("value", "k", n)}
    assert skew.heavy_hitters(df.limit(0), ["s"], 0.03).count() == 0


def test_skew_join_equals_plain_join(spark):
    rows = [("hot", i) for i in range(200)] + [(f"k{i % 40}", i) for i in range(100)] + [(None, 1), ("", 2)]
    left = spark.createDataFrame([(a, b, "l") for a, b in rows], "k string, x int, name string")
    right = spark.createDataFrame([("hot", "H", 1), ("k3", "T", 2), ("", "E", 3), (None, "N", 4)], "k string, name string, y int")
    for how in ("left", "inner"):
        plain = left.join(right.withColumnRenamed("name", "name_2"), "k", how)
        assert Counter(map(tuple, skew.skew_join(left, right, "k", how=how).select(*plain.columns).collect())) == Counter(map(tuple, plain.collect()))
    assert skew.skew_join(left.limit(0), right, "k").count() == 0


def test_per_key_totals(spark):
    rows = [("a", "x"), ("a", "x"), ("a", None), ("b", "y"), (None, "z"), ("", "q")]
    df = spark.createDataFrame(rows, "rows string, values string")
    got = {tuple(r) for r in skew.per_key_totals(df, "rows", "values").collect()}
    assert got == {("a", 3, 1), ("b", 1, 1), (None, 1, 1), ("", 1, 1)}


def test_only_heavy_keys_are_salted(spark, monkeypatch):
    salted, whole = [], skew._salted_totals
    monkeypatch.setattr(skew, "_salted_totals", lambda df, *a: salted.append({r.k for r in df.select("k").distinct().collect()}) or whole(df, *a))
    rows = [("hot", i % 70) for i in range(300)] + [(7 * "k" + str(i % 60), i % 3) for i in range(600)] + [(None, 1), (None, None), ("", 2)]
    df = spark.createDataFrame(rows, "k string, v int")
    out = skew.per_key_totals(df, "k", "v", share=0.1)
    assert salted == [{"hot", None, ""}]
    want = df.groupBy("k").agg(F.count(F.lit(1)), F.count_distinct("v"))
    assert Counter(map(tuple, out.collect())) == Counter(map(tuple, want.collect()))
    assert skew.per_key_totals(df.limit(0), "k", "v").count() == 0


def test_feistel_can_be_undone(spark):
    df = spark.range(1000).select(F.xxhash64("id").alias("a"), (F.col("id") * 7919).alias("b"))
    x, y = dedup.feistel(F.col("a"), F.col("b"))
    back = df.select("a", "b", x.alias("x"), y.alias("y")).select("a", "b", *(c.alias(n) for c, n in zip(dedup.unfeistel(F.col("x"), F.col("y")), ("c", "d"))))
    assert back.filter("a <> c OR b <> d").count() == 0


def test_redelivered_equals_brute_force(spark):
    rnd = random.Random(9)
    ids = [f"br-{rnd.getrandbits(32):08x}-{rnd.getrandbits(72):018x}" for _ in range(40)] + ["odd id", "br-short", "x" * 5000]
    rows = []
    for rec in range(2000):
        i = rnd.choice(ids) if rec % 3 else ids[0]  # one message is a third of all rows
        i = rnd.choice([i, i.upper(), f" {i}\n", i])
        rows.append((rec, i if rec % 50 else rnd.choice([None, "", "  "]), rnd.choice([1_000_000, 1_000_999, 2_000_000, 0, None] if rec % 7 == 0 else [1_000_000])))
    df = spark.createDataFrame([(a, b, c, 1, "t") for a, b, c in rows], "rec_id bigint, id string, us bigint, w1 int, rest string").withColumn("req_ts", F.timestamp_micros("us")).repartition(5)
    seen, want = {}, set()
    for rec, i, us in sorted(rows):
        if i is None or not i.strip() or not us:
            continue
        key = (i.strip().lower(), us // 1000)
        if key in seen:
            want.add(rec)
        seen.setdefault(key, rec)
    for block in (10, 500_000):
        assert sorted(r[0] for r in dedup.redelivered(df, block=block).collect()) == sorted(want)
    assert dedup.redelivered(df.limit(0)).count() == 0


def test_messages_of_a_later_batch(spark):
    kind = "rec_id bigint, id string, us bigint, w1 int"
    first = spark.createDataFrame([(1, "a", 1000, 0), (2, "A ", 1000, 0), (3, None, 5, 0)], kind).withColumn("req_ts", F.timestamp_micros("us"))
    later = spark.createDataFrame([(4, " a", 1000, 0), (5, "a", 9000, 0), (6, "a", 9000, 0), (7, None, 5, 0), (8, "b", 0, 0)], kind).withColumn("req_ts", F.timestamp_micros("us"))
    none = dedup.identifiers(first.limit(0), "rec_id", "id", "req_ts").select("w1", "w2", "ts", "rest")
    kept, seen = dedup.fresh_messages(first, none)
    assert sorted(r.rec_id for r in kept.collect()) == [1, 3] and seen.count() == 1
    kept, more = dedup.fresh_messages(later, seen)
    assert sorted(r.rec_id for r in kept.collect()) == [5, 7, 8] and more.count() == 1


@pytest.mark.parametrize("kind,value", [("bigint", lambda i: i), ("date", lambda i: datetime.date(2020, 1, 1 + i)), ("string", lambda i: f"k{i}" if i else "")])
@pytest.mark.parametrize("repeats", [1, 3])
def test_skewed_join_of_any_key_type_and_repeated_keys(spark, monkeypatch, kind, value, repeats):
    """The same rows as the plain join, by a broadcast or, beyond its bound, by salts."""
    keys = [value(0 if i % 3 else i % 7) for i in range(120)] + [None] * 5
    left = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], f"i int, k {kind}")
    right = spark.createDataFrame([(value(j), j, n) for j in range(5) for n in range(repeats)], f"k {kind}, i int, n int")
    for rows in (10_000, 0):
        monkeypatch.setattr(skew, "HOT_ROWS", rows)
        for how in ("left", "inner"):
            got = skew.skew_join(left, right, "k", 0.1, how)
            plain = left.join(right.withColumnRenamed("i", "i_2"), "k", how).select(*got.columns)
            assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    with pytest.raises(TypeError):
        skew.skew_join(left, right.withColumn("k", F.lit(1.5)), "k")


def test_counts_of_every_key(spark):
    values = ["hot"] * 50 + ["warm"] * 10 + [f"v{i % 37}" for i in range(200)] + [""] * 90 + [None] * 40
    df = spark.createDataFrame([(v, i % 3, 1, "x") for i, v in enumerate(values)], "k string, b bigint, n int, hot string").repartition(5)
    got = {(r.field, r.value): (r.n, r.hot) for r in skew.per_key_counts(df, ["k", "b"], 0.1).collect()}
    assert got == {("k", v): (n, v == "hot") for v, n in Counter(v for v in values if v is not None).items()} | {("b", str(i)): (130, True) for i in range(3)}
    assert skew.per_key_counts(df.limit(0), ["k"], 0.1).count() == 0
