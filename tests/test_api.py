import pytest

from fluxnest.api import Transcoder
from fluxnest.schema import proto as p
from fluxnest.wire.codec import Codec

PROTO = """
syntax = "proto3"; package shop;
enum Kind { UNKNOWN = 0; BOOK = 1; }
message Item { string id = 1; double price = 2; Kind kind = 3; }
message Nothing {}
message Order { string name = 1; repeated Item items = 2; Nothing none = 3; map<string, int64> counts = 4; }
"""
CONFIG = """
proto: {file: shop.proto, message: Order, import_paths: [.]}
custom_message: {file: extra.proto, message: Extra}
denormalizer:
  columns:
    - {name: name, path: name}
    - {name: id, path: "items[*].id"}
    - name: kind
      expr: {func: enum_name, args: [{path: "items[*].kind"}]}
    - {name: source, path: source}
"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("protos")
    (d / "shop.proto").write_text(PROTO)
    (d / "extra.proto").write_text('syntax = "proto3"; message Extra { string source = 1; }')
    (d / "plan.yaml").write_text(CONFIG)
    return d


def rows(spark, folder):
    reg, ext = p.compile_proto(str(folder / "shop.proto")), p.compile_proto(str(folder / "extra.proto"))
    raw = Codec(reg, reg.lookup("Order")).encode({"name": "o", "items": [{"id": "a", "kind": 1}, {"id": "b", "kind": 9}], "counts": {"x": 2}})
    return spark.createDataFrame([(raw, Codec(ext, ext.lookup("Extra")).encode({"source": "web"}))], "payload binary, custom binary").coalesce(1)


def test_from_config(spark, folder):
    t = Transcoder.from_config(str(folder / "plan.yaml"))
    got = t.denorm(rows(spark, folder), custom_column="custom")
    assert [tuple(r) for r in got.collect()] == [("o", "a", "BOOK", "web"), ("o", "b", None, "web")]
    assert got.schema.simpleString() == t.denorm_schema(spark).simpleString()
    assert t.field_names == ["name", "items", "none", "counts", "source"]


def test_from_proto_file(spark, folder, tmp_path):
    t = Transcoder.from_proto_file(str(folder / "shop.proto"), "Order", denorm_columns=["name", "items[*].id", 'counts["x"]'], prune=True)
    assert t.field_names == ["name", "items", "counts"]
    df = rows(spark, folder)
    assert [tuple(r) for r in t.denorm(df).collect()] == [("o", "a", 2), ("o", "b", 2)]
    nested = t.decode(df.select("payload"))
    t.write_parquet(nested, str(tmp_path / "out"))
    assert [tuple(r) for r in t.read_parquet(spark, str(tmp_path / "out"), [0]).collect()] == [("o",)]
    assert [r.out for r in t.pipeline(df.select("payload"), ".items[].id").collect()] == [["a", "b"]]
    assert t.decode(t.encode(nested)).collect() == nested.collect()
    assert len(t.fingerprint()) == 64


def test_option_errors(folder):
    ext = Transcoder.from_proto_file(str(folder / "extra.proto"), "Extra").base
    with pytest.raises(p.ExclusiveOptionsError):
        Transcoder.from_proto_file(str(folder / "shop.proto"), "Order", custom=ext, custom_file=("extra.proto", "Extra"))
    t = Transcoder.from_proto_file(str(folder / "shop.proto"), "Order")
    with pytest.raises(p.SchemaError):
        t.denorm(None)


def test_command_line(spark, folder, tmp_path, monkeypatch, capsys):
    import io

    from fluxnest.__main__ import main
    from fluxnest.wire.frames import frame

    assert main(["skeleton", str(folder / "shop.proto"), "Order"]) == 0
    assert "items[*].price" in capsys.readouterr().out
    monkeypatch.setattr("sys.stdin", io.StringIO('{"a": [1, 2]}\n\n{"a": []}\n'))
    assert main(["run", ".a | add"]) == 0
    assert capsys.readouterr().out == "3\nnull\n"
    monkeypatch.setattr("sys.stdin", io.StringIO("1\n"))
    assert main(["run", ".[]"]) == 1
    (folder / "flat.yaml").write_text('proto: {file: shop.proto, message: Order}\ndenormalizer: {columns: [{name: name, path: name}, {name: id, path: "items[*].id"}]}')
    reg = p.compile_proto(str(folder / "shop.proto"))
    blob = frame([Codec(reg, reg.lookup("Order")).encode({"name": "o", "items": [{"id": "a"}]})])
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f.bin").write_bytes(blob)
    assert main(["denorm", str(folder / "flat.yaml"), str(tmp_path / "in"), "--output", str(tmp_path / "out")]) == 0
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("o", "a")]
