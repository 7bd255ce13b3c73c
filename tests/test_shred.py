import json

import pytest

from fluxnest.operators import shred
from fluxnest.operators.shred import BID_REQUEST, json_entities

FULL = {
    "id": "r",
    "imp": [{"id": "1", "banner": {"w": 3}, "pmp": {"deals": [{"id": "d"}, {}, None, {"wseat": ["s"]}]}}, None, {"id": None, "ext": {}}, {"id": "4"}],
    "device": {"ifa": "", "geo": {"lat": {"units": 1}, "lon": {"units": 0}}},
    "user": {"ext": {"demographic": {"total": {"units": 0}}}},
}
ROWS = {("imp", (0,)), ("deal", (0, 0)), ("deal", (0, 3)), ("imp", (3,)), ("device", ()), ("geo", ()), ("user", ()), ("demographic", ())}


def found(payload):
    return {(name, tuple(at)) for name, _, at, _ in json_entities(payload, BID_REQUEST)}


def as_map(items):
    return {str(i): x for i, x in enumerate(items)}


@pytest.mark.parametrize(
    "value",
    [
        FULL,
        [FULL],
        {"outer": {"inner": FULL}},
        json.dumps(FULL),
        {"bidrequest": json.dumps(FULL)},
        {**FULL, "imp": json.dumps(FULL["imp"])},
        {**FULL, "imp": as_map(FULL["imp"])},
        {**FULL, "device": json.dumps(FULL["device"]), "user": json.dumps(FULL["user"])},
    ],
)
def test_spellings_of_one_message(value):
    assert found(json.dumps(value)) == ROWS
    assert found("﻿" + json.dumps(value) + " \r\n") == ROWS


def test_single_object_is_a_list_of_one():
    assert found('{"imp": {"id": 0}}') == {("imp", (0,))}
    assert found('{"imp": {"7": {"id": 0}, "2": {"id": null}}}') == {("imp", (7,))}


@pytest.mark.parametrize("payload", [None, "", "  ", "null", "[]", "{}", '{"imp": [', '{"imp": [{"id": 1}]} x', "nonsense", '{"imp": NaN}', '{"device": "x"}'])
def test_nothing_to_find(payload):
    assert found(payload) == set()


@pytest.mark.parametrize("levels", [10, 9_000, 150_000])
def test_depth_is_not_bounded(levels):
    assert found('{"imp": ' + "[" * levels) == set()
    deep = '{"imp": [{"banner": ' + '{"x": [' * levels + "1" + "]}" * levels + '}], "device": {"ua": "x"}}'
    assert found(deep) == {("imp", (0,)), ("device", ())}
    assert found(deep[:-1]) == found(deep + "x") == set()
    assert found('{"a": [' * levels + json.dumps({"user": {"id": 1}}) + "]}" * levels) == {("user", ())}


@pytest.mark.parametrize("text", ['{"a": [1, -2.5e3, true, null, "\\u00e9\\"", {}, []], "b": {"c": [[], {"d": ""}]}}', "[]", " {} ", "3", '"x"', "[1,]", "[,1]", '{"a" 1}', '{"a":}', '{"a": 1,}', "{1: 2}", "[1 2]", "[}", "{]", "]", "", "[NaN]", "[tru]", "[01]", '["a\nb"]', "[1] 2", '{"a": 1 "b": 2}', ":", "[:]", '{"a"}', '{"a",'])
def test_the_parser_with_a_stack_equals_the_librarys(text):
    try:
        want = json.loads(text, parse_constant=shred._refuse)
    except ValueError:
        with pytest.raises(ValueError):
            shred._deep_loads(text)
    else:
        assert shred._deep_loads(text) == want


def test_states_follow_from_the_childrens_states():
    state = lambda device: [v for name, v, _, _ in json_entities(json.dumps({"device": device}), BID_REQUEST) if name == "device"]
    assert state({"geo": {"lat": {"units": 1}, "lon": {"units": 0}}}) == ["device_located"]
    assert state({"geo": {"lat": {"units": 1}, "lon": {}}}) == state({"geo": json.dumps({"city": "x"})}) == ["device_placed"]
    assert state({"ua": "", "geo": {}}) == ["device_bare"] and state({"geo": {}}) == []


def test_variants():
    kinds = {name: v for name, v, at, _ in json_entities(json.dumps(FULL), BID_REQUEST) if at in ([], [0])}
    assert kinds == {"imp": "imp_banner", "device": "device_located", "geo": "geo_point", "user": "user_profiled", "demographic": "demographic"}


def test_typed_and_text_agree(spark):
    from tests.conftest import SMALL

    bids = spark.read.parquet(f"{SMALL}/bid_requests.parquet")
    typed = {(r.rec_id, r.entity, r.variant, tuple(r.place)) for r in shred.shred(bids, "msg", BID_REQUEST, ["rec_id"]).collect()}
    from pyspark.sql import functions as F

    text = bids.select("rec_id", F.to_json("msg").alias("payload"))
    assert typed == {(r.rec_id, r.entity, r.variant, tuple(r.place)) for r in shred.shred_json(text, "payload", BID_REQUEST, "rec_id").collect()}


def test_tables_keep_fields_and_clashing_columns(spark):
    from tests.conftest import SMALL

    bids = spark.read.parquet(f"{SMALL}/bid_requests.parquet").selectExpr("*", "1 AS place", "2 AS variant", "3 AS obj")
    t = shred.entity_table(bids, "msg", BID_REQUEST, "deal", ["rec_id"])
    assert t.columns == ["rec_id", "variant", "place", "obj"]
    objects = shred.shred_objects(bids, "msg", BID_REQUEST, ["rec_id"])
    parts = shred.route(objects, BID_REQUEST["deal"], ["rec_id"])
    assert sum(p.count() for p in parts.values()) == t.count() > 0
    kinds = {e.name: shred.entity_kind(bids.schema["msg"].dataType, BID_REQUEST, e.name) for e in BID_REQUEST.entities}
    raw = shred.shred_json_objects(spark.createDataFrame([(1, json.dumps(FULL))], "rec_id bigint, payload string"), "payload", BID_REQUEST, "rec_id", kinds)
    assert sorted((r.place, r.deal.id, r.imp) for r in raw.filter("entity = 'deal'").collect()) == [([0, 0], "d", None), ([0, 3], None, None)]


def test_large_keys_give_places(spark):
    big = 2**31
    payload = json.dumps({"imp": {"0": {"id": "a"}, str(big): {"id": "b", "pmp": {"deals": {str(2**63 - 1): {"id": "d"}, "9" * 5000: {"id": "e"}}}}}})
    rows = shred.shred_json(spark.createDataFrame([(1, payload)], "rec_id bigint, payload string"), "payload", BID_REQUEST, "rec_id").collect()
    assert {(r.entity, tuple(r.place)) for r in rows} == {("imp", (0,)), ("imp", (big,)), ("deal", (big, 2**63 - 1))}


def test_subtype_tables_have_their_variants_columns(spark):
    import __spark_entry__ as catalogue
    from tests.conftest import SMALL

    bids = spark.read.parquet(f"{SMALL}/bid_requests.parquet")
    t = shred.shred_objects(bids, "msg", BID_REQUEST, ["rec_id"])
    fields = {v: set(p.schema["obj"].dataType.fieldNames()) for v, p in shred.route(t, BID_REQUEST["imp"], ["rec_id"]).items()}
    assert {v: f & {"banner", "video"} for v, f in fields.items()} == {"imp_av": {"banner", "video"}, "imp_video": {"video"}, "imp_banner": {"banner"}, "imp_bare": set()}
    kind = shred.entity_kind(bids.schema["msg"].dataType, BID_REQUEST, "geo")
    assert shred.dead_children(BID_REQUEST["geo"], "geo_place", kind) == []  # one of lat and lon may be there
    rows = catalogue.queries()["p1_subtypes"](spark, SMALL).collect()
    found = catalogue.queries()["p1_found"](spark, SMALL).collect()
    assert sorted((r.rec_id, r.entity, r.imp_index, r.deal_index) for r in rows) == sorted(map(tuple, found))
    assert {r.entity for r in rows} == {e.name for e in BID_REQUEST.entities}
    for r in rows:
        obj = json.loads(r.obj)
        assert all(c.partition("=")[0] in obj for c in dict(BID_REQUEST[r.entity].variants)[r.variant])
        assert ("banner" in obj) == (r.variant in ("imp_av", "imp_banner")) and ("wseat" in obj) == (r.variant == "deal_seated")


def test_empty_table(spark):
    from tests.conftest import SMALL

    bids = spark.read.parquet(f"{SMALL}/bid_requests.parquet").limit(0)
    assert shred.shred(bids, "msg", BID_REQUEST, ["rec_id"]).count() == 0
    assert shred.shred_json(spark.createDataFrame([], "rec_id bigint, payload string"), "payload", BID_REQUEST, "rec_id").count() == 0


def test_typed_tables_hold_every_object_of_both_sources(spark):
    import __spark_entry__ as catalogue
    from tests.conftest import SMALL

    found = catalogue.queries()["p1_found"](spark, SMALL).collect()
    for e in BID_REQUEST.entities:
        rows = catalogue.queries()[f"p1_{e.name}_table"](spark, SMALL).collect()
        own = [r.asDict() for r in rows]
        assert sorted((r["rec_id"], r.get("imp_index", -1), r.get("deal_index", -1)) for r in own) == sorted((r.rec_id, r.imp_index, r.deal_index) for r in found if r.entity == e.name)
