import datetime
import random
import struct
from decimal import Decimal

import pytest
from pyspark.sql import types as T

from fluxnest.plans.denorm import denorm
from fluxnest.schema import proto as p
from fluxnest.wire.codec import Codec, WireError
from fluxnest.wire.frames import RecordType, decode_merged, frame, read_framed, retag

TEXT = """
syntax = "proto3"; package t;
import "google/protobuf/timestamp.proto";
// a comment
enum Color { NONE = 0; RED = 1; }
message Inner { sint64 v = 1; repeated string names = 2; message Deep { bool b = 1; } Deep deep = 3; }
message All {
  option deprecated = true;
  reserved 90 to 99; reserved "old";
  double d = 1; float f = 2; int32 i32 = 3; int64 i64 = 4; uint32 u32 = 5; uint64 u64 = 6; sint32 s32 = 7; sint64 s64 = 8;
  fixed32 x32 = 9; fixed64 x64 = 10; sfixed32 y32 = 11; sfixed64 y64 = 12; bool b = 13; string s = 14; bytes raw = 15;
  optional int32 opt = 16; repeated int32 packed = 17; repeated Inner inners = 18; Inner inner = 19; Color color = 20;
  map<string, int64> m = 21; map<int32, Inner> mm = 22; oneof pick { string a = 23; Inner c = 24; }
  google.protobuf.Timestamp at = 25 [json_name = "when"]; google.protobuf.Int32Value w = 26; google.protobuf.Struct js = 27;
}
message Empty {} message Holder { Empty e = 1; Nest n = 2; int32 k = 3; map<string, Empty> me = 4; } message Nest { Empty e = 1; }
message Loop { Loop next = 1; }
"""


@pytest.fixture(scope="module")
def reg():
    return p.parse_proto(TEXT)


@pytest.fixture(scope="module")
def official():
    """The same message built with the official library, to check both directions."""
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

    f = descriptor_pb2.FileDescriptorProto(name="t2.proto", package="t2", syntax="proto3")
    f.enum_type.add(name="Color").value.add(name="NONE", number=0)
    f.enum_type[0].value.add(name="RED", number=1)
    inner = f.message_type.add(name="Inner")
    inner.field.add(name="v", number=1, type=18, label=1)
    inner.field.add(name="names", number=2, type=9, label=3)
    deep = inner.nested_type.add(name="Deep")
    deep.field.add(name="b", number=1, type=8, label=1)
    inner.field.add(name="deep", number=3, type=11, type_name=".t2.Inner.Deep", label=1)
    m = f.message_type.add(name="All")
    kinds = dict(d=1, f=2, i32=5, i64=3, u32=13, u64=4, s32=17, s64=18, x32=7, x64=6, y32=15, y64=16, b=8, s=9, raw=12)
    for n, (name, kind) in enumerate(kinds.items(), 1):
        m.field.add(name=name, number=n, type=kind, label=1)
    m.field.add(name="packed", number=17, type=5, label=3)
    m.field.add(name="inners", number=18, type=11, type_name=".t2.Inner", label=3)
    m.field.add(name="inner", number=19, type=11, type_name=".t2.Inner", label=1)
    m.field.add(name="color", number=20, type=14, type_name=".t2.Color", label=1)
    pool = descriptor_pool.DescriptorPool()
    pool.Add(f)
    return message_factory.GetMessageClass(pool.FindMessageTypeByName("t2.All"))


FILLED = dict(d=1.5, f=-2.25, i32=-3, i64=-(2**60), u32=2**32 - 1, u64=2**64 - 1, s32=-5, s64=2**50, x32=7, x64=2**63, y32=-8, y64=-9, b=True, s="é€", raw=b"\x00\xff", packed=[1, -2, 300], color=1)


def test_decode_what_the_official_library_writes(reg, official):
    m = official(**FILLED)
    m.inner.v = -1
    m.inners.add(names=["a", ""])
    got = Codec(reg, reg.lookup("All")).decode(m.SerializeToString())
    assert {k: got[k] for k in FILLED} == {**FILLED, "u64": Decimal(2**64 - 1), "x64": Decimal(2**63)}
    assert got["inner"] == {"v": -1, "names": [], "deep": {"b": False}}
    assert got["inners"] == [{"v": 0, "names": ["a", ""], "deep": {"b": False}}]


def test_official_library_reads_what_we_write(reg, official):
    row = {**FILLED, "inner": {"v": 4, "names": ["x"], "deep": {"b": True}}, "inners": [{"v": 1, "names": None, "deep": None}]}
    m = official.FromString(Codec(reg, reg.lookup("All")).encode(row))
    assert {k: list(getattr(m, k)) if k == "packed" else getattr(m, k) for k in FILLED} == FILLED
    assert m.inner.deep.b and m.inners[0].v == 1


def test_defaults(reg):
    got = Codec(reg, reg.lookup("All")).decode(b"")
    assert got["i32"] == 0 and got["s"] == "" and got["raw"] is None and got["opt"] is None and got["a"] is None and got["c"] is None
    assert got["packed"] == [] and got["m"] == [] and got["inner"] == {"v": 0, "names": [], "deep": {"b": False}} and got["at"] == {"seconds": 0, "nanos": 0}


def test_round_trip_with_flattened_messages(reg, spark):
    t = RecordType(reg, reg.lookup("All"), flatten=True)
    assert isinstance(t.schema["at"].dataType, T.TimestampType) and t.schema["w"].dataType == T.IntegerType()
    at = datetime.datetime(1969, 12, 31, 23, 59, 59, 250_000)
    row = (1.5, 2.5, 1, 2, 3, Decimal(4), 5, 6, 7, Decimal(8), 9, 10, True, "s", bytearray(b"r"), 0, [1, 2], [(1, ["n"], (True,))], (2, [], (False,)), 1, {"k": 5}, {3: (4, [], (False,))}, None, (9, ["o"], (False,)), at, -7, '{"a":[1,true,null,"x",{"b":1.5}]}')
    df = spark.createDataFrame([(1, row), (2, None)], T.StructType([T.StructField("k", T.IntegerType()), T.StructField("msg", t.schema)])).coalesce(1)
    for runtime in (True, False):
        back = t.decode(t.encode(df, "msg"), "payload", runtime=runtime).collect()
        assert back[1].msg is None and back[0].msg == df.collect()[0].msg


def test_both_decoders_agree_on_defaults(reg, spark):
    blobs = [b"", Codec(reg, reg.lookup("All")).encode({"c": {"v": 3}, "opt": 0, "mm": [(1, {"v": 2})], "inner": {"names": ["x"]}}), Codec(reg, reg.lookup("All")).encode({"a": ""})]
    df = spark.createDataFrame([(b,) for b in blobs], "payload binary").coalesce(1)
    for flatten in (True, False):
        t = RecordType(reg, reg.lookup("All"), flatten)
        assert t.decode(df, "payload").collect() == t.decode(df, "payload", runtime=False).collect()


def _random_row(rnd, reg):
    whole = lambda bits, signed=True: rnd.choice([0, 1, -1 if signed else 2, rnd.randrange(-(2 ** (bits - 1)), 2 ** (bits - 1)) if signed else rnd.randrange(2**bits)])
    inner = lambda: {"v": whole(64), "names": [rnd.choice(["", "a", "é€" * 70]) for _ in range(rnd.randrange(3))], "deep": {"b": rnd.random() < 0.5}}
    every = {
        "d": rnd.choice([0.0, -0.0, 1.5, float("inf")]), "f": 2.5, "i32": whole(32), "i64": whole(64), "u32": whole(32, False), "u64": Decimal(whole(64, False)), "s32": whole(32), "s64": whole(64),
        "x32": whole(32, False), "x64": Decimal(whole(64, False)), "y32": whole(32), "y64": whole(64), "b": True, "s": rnd.choice(["", "x" * 200, "日本"]), "raw": rnd.choice([b"", b"\xff\x00"]), "opt": rnd.choice([0, -7]),
        "packed": [whole(32) for _ in range(rnd.randrange(6))], "inners": [inner() for _ in range(rnd.randrange(4))], "inner": inner(), "color": rnd.choice([0, 1, 9]),
        "m": [(k, whole(64)) for k in rnd.sample(["", "a", "b", "é"], rnd.randrange(4))], "mm": [(k, inner()) for k in rnd.sample([0, -1, 5], rnd.randrange(3))],
        rnd.choice(["a", "c"]): None, "at": datetime.datetime(2001, 2, 3, 4, 5, 6, rnd.choice([0, 789_000]), datetime.timezone.utc), "w": rnd.choice([0, 3]), "js": '{"k":[1]}',
    }
    if "a" in every:
        every["a"] = rnd.choice(["", "z"])
    if "c" in every:
        every["c"] = inner()
    return {k: v for k, v in every.items() if rnd.random() < 0.6}


def test_whole_batches_equal_messages_one_by_one(reg):
    """Random messages, also damaged, doubled (fields given twice), with unknown fields, unpacked lists and far too many fields."""
    import pyarrow as pa

    from fluxnest.wire.vector import ROUNDS, VectorDecoder, decode_halving

    rnd, m = random.Random(12), reg.lookup("All")
    for flatten in (True, False):
        codec, blobs = Codec(reg, m, flatten), []
        for i in range(900):
            row = _random_row(rnd, reg)
            if not flatten:
                row = {k: v for k, v in row.items() if k not in ("at", "w")}
            blob = codec.encode(row)
            if i % 50 == 7:
                blob = blob + codec.encode({k: v for k, v in row.items() if k != "inner"})
            if i % 60 == 8:
                blob = b"\xf8\x3f\x05" + blob + b"\xfa\x3f\x02hi"  # unknown fields
            if i % 70 == 9:
                blob = blob[: rnd.randrange(len(blob) + 1)]
            if i % 80 == 10:
                blob += b"\x88\x01\x05\x88\x01\x06"  # an unpacked list
            if i == 500:
                blob = codec.encode({"inners": [{"v": 1}] * (ROUNDS + 5)})
            blobs.append(None if i % 90 == 11 else blob)

        def exact(some, strict):
            rows, why = [], []
            for b in some:
                try:
                    rows.append(None if b is None else codec.decode(b))
                    why.append(None)
                except WireError as e:
                    rows.append(None)
                    why.append(str(e))
            return pa.array(rows, kind), why

        from pyspark.sql.pandas.types import to_arrow_type

        fast = VectorDecoder(reg, m, flatten)
        kind, handed = to_arrow_type(fast.kind), []
        want, errors = exact(blobs, False)
        got, why = decode_halving(pa.array(blobs, pa.binary()).slice(0), fast, lambda b, s: handed.append(len(b)) or exact(b, s), False)
        assert got.to_pylist() == want.to_pylist() and [w is None for w in why] == [w is None for w in errors]
        clean = [b for b, e in zip(blobs, errors) if b is not None and e is None][:5]
        assert fast.decode(pa.array([b"", *clean[:1]], pa.large_binary()).slice(1)).to_pylist() == exact(clean[:1], False)[0].to_pylist()
        assert handed and fast.decode(pa.array([], pa.binary())).to_pylist() == []


@pytest.mark.parametrize("blob", [b"\x08", b"\x0a\x05ab", b"\x00\x01", b"\x72\x02\xff\xfe", b"\x09\x00"])
def test_damaged_bytes(reg, spark, blob):
    with pytest.raises(WireError):
        Codec(reg, reg.lookup("All")).decode(blob)
    t = RecordType(reg, reg.lookup("Inner"))
    df = spark.createDataFrame([(1, b""), (2, b"\x08"), (3, None)], "k int, payload binary").coalesce(1)
    for runtime in (True, False):
        got = t.decode(df, "payload", strict=False, runtime=runtime).collect()
        assert [r._corrupt is None for r in got] == [True, False, True] and got[0].msg.v == 0 and got[1].msg is None


def test_unknown_and_unneeded_fields_are_skipped(reg):
    blob = Codec(reg, reg.lookup("All")).encode({"i64": 5, "s": "x", "inner": {"v": 1}})
    slim = RecordType(reg, reg.lookup("All"), needed={"s"})
    assert Codec(reg, slim.message).decode(blob) == {"s": "x"} and slim.field_names == ["s"]


def test_schema_errors(reg):
    with pytest.raises(p.CyclicTypeError):
        p.struct_type(reg, reg.lookup("Loop"))
    deep = "".join(f"message M{i} {{ M{i + 1} m = 1; }} " for i in range(12)) + "message M12 { int32 x = 1; }"
    with pytest.raises(p.MaxDepthError):
        r = p.parse_proto(deep)
        p.struct_type(r, r.lookup("M0"))
    with pytest.raises(p.SchemaError):
        reg.lookup("Deep")  # nested, not at the top
    with pytest.raises(p.SchemaError):
        p.parse_proto("message A { Nope x = 1; }")
    s = p.struct_type(reg, reg.lookup("All"))
    assert p.field_at(s, ["inners", "deep", "b"]).metadata == {"parquet.field.id": 1, "path": "inners.deep.b"}
    with pytest.raises(p.PathNotFoundError):
        p.field_at(s, ["inners", "nope"])
    assert p.enum_names(reg, reg.lookup("All"), ["color"]) == {0: "NONE", 1: "RED"}


def test_merge_prune_fingerprint(reg):
    a, b = p.parse_proto("message A { int32 x = 4; }"), p.parse_proto("message B { string y = 1; }")
    m = p.merge(a, a.lookup("A"), b.lookup("B"), b)
    assert [(f.name, f.number) for f in m.fields] == [("x", 4), ("y", 5)]
    with pytest.raises(p.SchemaError):
        p.merge(a, a.lookup("A"), a.lookup("A"))
    slim, holder = p.prune_empty(reg, reg.lookup("Holder"))
    assert [f.name for f in holder.fields] == ["k", "me"]
    print_ = p.fingerprint(reg, reg.lookup("Holder"))
    assert p.check_fingerprint(reg, reg.lookup("Holder"), print_)
    with pytest.raises(p.FingerprintMismatchError):
        p.check_fingerprint(slim, holder, print_)
    assert not p.check_fingerprint(slim, holder, print_, "rebuild")


def test_prune_type():
    kind = T.StructType([T.StructField("a", T.StructType([])), T.StructField("b", T.ArrayType(T.StructType([T.StructField("c", T.StructType([]))]))), T.StructField("d", T.IntegerType())])
    assert p.prune_type(kind).simpleString() == "struct<d:int>" and p.prune_type(T.StructType([])) is None


def test_files_and_imports(tmp_path):
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib" / "inner.proto").write_text('syntax = "proto3"; package lib; message Inner { int32 v = 1; }')
    (tmp_path / "main.proto").write_text('syntax = "proto3"; import "inner.proto"; message Main { lib.Inner i = 1; }')
    t = RecordType.from_proto(str(tmp_path / "main.proto"), "Main", [str(tmp_path / "lib")])
    assert t.schema.simpleString() == "struct<i:struct<v:int>>"
    with pytest.raises(p.SchemaError):
        p.compile_proto(str(tmp_path / "main.proto"))


def test_merged_bytes_and_framed_files(spark, tmp_path):
    a, b = p.parse_proto("message A { int32 x = 1; repeated int32 l = 2; }"), p.parse_proto("message B { string y = 1; }")
    ta, tb = RecordType(a, a.lookup("A")), RecordType(b, b.lookup("B"))
    raw = [(Codec(a, ta.message).encode({"x": i, "l": [1, 2]}), Codec(b, tb.message).encode({"y": f"v{i}"})) for i in range(1, 4)]
    df = spark.createDataFrame(raw, "base binary, custom binary").coalesce(1)
    assert [tuple(r) for r in denorm(decode_merged(df, ta, "base", tb, "custom"), "x", "y", "l[*]", record="msg").collect()][:2] == [(1, "v1", 1), (1, "v1", 2)]
    merged = p.merge(a, ta.message, tb.message, b)
    assert Codec(a, merged).decode(raw[0][0] + retag(raw[0][1], {1: 3})) == {"x": 1, "l": [1, 2], "y": "v1"}
    (tmp_path / "f.bin").write_bytes(frame(x for x, _ in raw))
    got = read_framed(spark, str(tmp_path)).orderBy("n").collect()
    assert [bytes(r.payload) for r in got] == [x for x, _ in raw]
    (tmp_path / "f.bin").write_bytes(struct.pack("<I", 9) + b"x")
    with pytest.raises(Exception, match="cut-off"):
        read_framed(spark, str(tmp_path)).count()
    with pytest.raises(p.SchemaError):
        ta.merged(ta)


def test_streams_equal_batches(spark, tmp_path):
    from fluxnest.streaming.flow import distinct_messages, run_available, running_totals, session_counts, windowed_counts

    src = str(tmp_path / "in")
    rows = [(i % 3, float(i), datetime.datetime(2024, 1, 1, 0, i)) for i in range(30)] * 2
    spark.createDataFrame(rows, "k int, v double, t timestamp").repartition(3).write.parquet(src)
    stream = lambda: spark.readStream.schema("k int, v double, t timestamp").option("maxFilesPerTrigger", 1).parquet(src)
    seen = {}

    def last(name):
        return lambda df, n: seen.setdefault(name, []).extend(tuple(r) for r in df.collect())

    out = str(tmp_path / "flat")
    run_available(denorm(stream(), "k", twice="v"), lambda df, n: df.write.mode("overwrite").parquet(f"{out}/b={n}"), str(tmp_path / "c1"))
    assert spark.read.parquet(out).count() == 60
    q = running_totals(stream(), "k", "v").writeStream.outputMode("update").foreachBatch(last("totals")).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination()
    assert {k: t for k, t in seen["totals"]} == {k: 2.0 * sum(i for i in range(30) if i % 3 == k) for k in range(3)}
    run_available(distinct_messages(stream(), ["k", "v"], "t"), last("distinct"), str(tmp_path / "c3"))
    assert len(seen["distinct"]) == 30
    batch = spark.read.parquet(src)
    assert windowed_counts(batch, "t", ["k"], "10 minutes").count() == 9
    assert session_counts(batch, "t", ["k"], "5 minutes").count() == 3


def test_framed_files_in_parts(spark, tmp_path):
    """Null bytes are left out, empty ones kept; files are cut into parts by their index, and read whole without one."""
    import os

    from pyspark.sql import functions as F

    from fluxnest.wire.frames import write_framed

    blobs = [None if i % 50 == 3 else b"" if i % 50 == 4 else bytes([i % 256]) * (i % 40) for i in range(3000)]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(blobs)], "n int, b binary").repartition(3)
    assert write_framed(df, "b", str(tmp_path / "x"), part=2000) == sum(b is not None for b in blobs)
    back = read_framed(spark, str(tmp_path / "x"))
    rows = back.collect()
    assert sorted(bytes(r.payload) for r in rows) == sorted(b for b in blobs if b is not None)
    assert len({(r.file, r.n) for r in rows}) == len(rows) and len({r.file for r in rows}) == 3
    assert back.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    for f in os.listdir(tmp_path / "x"):
        if f.endswith(".index"):
            os.remove(tmp_path / "x" / f)
    assert sorted((r.file, r.n, bytes(r.payload)) for r in read_framed(spark, str(tmp_path / "x")).collect()) == sorted((r.file, r.n, bytes(r.payload)) for r in rows)
    assert write_framed(df.limit(0), "b", str(tmp_path / "y")) == 0
