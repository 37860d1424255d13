import json

import pytest
from pyspark.sql import functions as F

from ontoweave.model import ontology_from_dict, snake_case, spark_type
from ontoweave.registry import FunctionRegistry, register_lookups, register_missing, register_toll
from ontoweave.repository import ObjectRepository
from ontoweave.sources import files
from ontoweave.streaming import incremental

RAW = {
    "name": "shop",
    "objects": {
        "Customer": {"source": {"type": "json_file", "config": {"path": "customers.json"}}, "mutability": "read_only",
                     "properties": {"customer_id": {"type": "str", "required": True}, "name": {"type": "str"}, "score": {"type": "float"}}},
        "Order": {"source": {"type": "runtime_memory"}, "mutability": "mutable", "status_transitions": {"new": ["paid"], "paid": []},
                  "properties": [{"name": "order_id", "type": "str", "required": True}, {"name": "customer_id", "type": "str"}, {"name": "status", "type": "str"}]},
        "Log": {"source": {"type": "runtime_memory"}, "mutability": "append_only", "properties": {"log_id": {"type": "str", "required": True}, "text": {"type": "str"}}},
        "Employee": {"source": {"type": "csv_file", "config": {"path": "employee.csv"}},
                     "properties": {"employee_id": {"type": "str", "required": True}, "age": {"type": "int"}, "pay": {"type": "float"}, "note": {"type": "str"}, "absent": {"type": "str"}}},
        "EventLevelStandard": {"source": {"type": "resolver", "resolver": "levels"}, "properties": {"level": {"type": "str", "required": True}}},
    },
    "links": {"customer_orders": {"source": "Customer", "target": "Order", "join": [{"source_key": "customer_id"}, {"target_key": "customer_id"}], "link_type": "novel"}},
    "rules": {"score_class": {"applies_to": ["Customer"], "result_field": "grade", "conditions": [{"field": "score", "operator": "gte", "value": 5, "result": "high"},
                              {"any": [{"field": "name", "operator": "like", "value": "B"}], "result": "b"}]}},
    "functions": {"first": {"params": {"n": {"type": "int", "default": 3}}}, "second": {"depends_on": ["first"], "params": [{"name": "who", "type": "str"}],
                  "preconditions": [{"object": "Customer", "field": "score", "operator": "exists"}]}, "later": {}},
    "workflows": {"flow": {"steps": [{"name": "a", "function": "first", "next": "b"}, {"name": "b"}]}},
}


@pytest.fixture()
def repo(spark, tmp_path):
    (tmp_path / "customers.json").write_text(json.dumps({"items": [{"customer_id": "c1", "name": "Ann", "score": 7.5}, {"customer_id": "c2", "name": "Bob"}]}), encoding="utf-8")
    (tmp_path / "employee.csv").write_text("﻿age,employee_id,pay,note,extra\n30.0,e1,1.5,,x\n,e2,,hi,y\n", encoding="utf-8")
    r = ObjectRepository(spark, ontology_from_dict(RAW), str(tmp_path))
    r.register_resolver("levels", lambda: spark.createDataFrame([("I",), ("II",)], "level string"))
    return r


def test_types_and_names():
    assert spark_type("list[str]").simpleString() == "array<string>" and spark_type("dict[str, float]").simpleString() == "map<string,double>"
    assert snake_case("HTTPRequestLog") == "http_request_log"
    o = ontology_from_dict(RAW)
    assert o.objects["Order"].id_field == "order_id" and o.links["customer_orders"].key_pairs == [("customer_id", "customer_id")]
    assert o.functions["first"].params[0].default == 3 and o.workflows["flow"].steps[0]["next"] == "b"


def test_reads(repo):
    assert repo.count("Customer") == 2
    assert repo.query_by_id("Customer", "c1").first()["name"] == "Ann"
    assert [r["customer_id"] for r in repo.query("Customer", order_by="-score").collect()] == ["c1", "c2"]
    assert {(r["employee_id"], r["age"], r["pay"], r["note"], r["absent"]) for r in repo.df("Employee").collect()} == {("e1", 30, 1.5, "", ""), ("e2", None, None, "hi", "")}
    assert {r["grade"] for r in repo.apply_rule("score_class").collect()} == {"high", "b"}
    hit = repo.search("An", ["Customer"]).first()
    assert (hit["id"], hit["_matched_field"]) == ("c1", "name")
    assert {r["field"]: r["null_count"] for r in repo.describe("Customer").collect()}["score"] == 1
    assert [f["field"] for f in repo.inspect("Customer")] == ["customer_id", "name", "score"]


def test_json_shapes(spark, tmp_path):
    schema = spark.createDataFrame([], "a string, b bigint, k string").schema
    for i, shape in enumerate([[{"A": "x", "b": 1}], {"data": [{"A": "x", "b": 1}]}, {"items": [{"A": "x", "b": 1}]}]):
        p = tmp_path / f"{i}.json"
        p.write_text(json.dumps(shape))
        row = files.read_json(spark, str(p), schema, {"A": "a"}, {"k": files.composite_key("a", "b")}).first()
        assert (row["a"], row["b"], row["k"]) == ("x", 1, "x:1")
    assert files.read_json(spark, str(tmp_path / "none.json"), schema).count() == 0


def test_markdown_scan(spark, tmp_path):
    (tmp_path / "其他").mkdir()
    (tmp_path / "a b").mkdir()
    (tmp_path / "其他" / "x.md").write_text("skip", encoding="utf-8")
    (tmp_path / "a b" / "y.md").write_text("---\ntitle: T: one\n---\n# H\nbody", encoding="utf-8")
    (tmp_path / "z.md").write_text("plain", encoding="utf-8")
    rows = {r["path"]: r for r in files.read_markdown(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a b/y.md", "z.md"}
    assert rows["a b/y.md"]["front_matter"] == {"title": "T: one"} and rows["a b/y.md"]["text"] == "# H\nbody" and rows["z.md"]["front_matter"] is None


def test_governed_writes(repo, spark):
    rows = spark.createDataFrame([("o1", "c1", "new"), ("o2", "c2", "new")], "order_id string, customer_id string, status string")
    repo.insert("Order", rows.withColumn("junk", F.lit(1)))
    old = repo.df("Order")
    repo.update("Order", {"order_id": "o1"}, {"status": "paid"})
    assert {r["order_id"]: r["status"] for r in repo.df("Order").collect()} == {"o1": "paid", "o2": "new"}
    assert {r["status"] for r in old.collect()} == {"new"}
    with pytest.raises(ValueError):
        repo.update("Order", {"order_id": "o1"}, {"status": "new"})
    assert [(r["name"], r["target_order_id"]) for r in repo.query_links("customer_orders", {"name": "Bob"}).collect()] == [("Bob", "o2")]
    repo.upsert("Order", spark.createDataFrame([("o2", "c1", "new"), ("o3", "c1", "new")], rows.schema))
    repo.delete("Order", {"order_id": "o1"})
    assert sorted(r["order_id"] for r in repo.df("Order").collect()) == ["o2", "o3"]
    repo.insert("Log", spark.createDataFrame([("hello",)], "text string"))
    assert len(repo.df("Log").first()["log_id"]) == 16
    with pytest.raises(ValueError):
        repo.delete("Log", {"text": "hello"})
    with pytest.raises(ValueError):
        repo.insert("Customer", rows)


def test_registry(repo):
    reg = FunctionRegistry(repo)
    calls = []
    reg.register("first", lambda r, n: calls.append(("first", n)) or r.df("Customer").limit(n))
    reg.register("second", lambda r, who: calls.append(("second", who)) or r.query("Customer", {"name": who}))
    register_lookups(reg)
    register_missing(reg)
    assert reg.order("second") == ["first", "second"]
    assert reg.call("second", who="Ann").count() == 1 and calls == [("first", 3), ("second", "Ann")]
    assert reg.call("lookup_event_level", level="II").count() == 1 and reg.call("lookup_event_level").count() == 2
    assert reg.call("later").first()["status"] == "not_implemented"
    with pytest.raises(ValueError):
        reg.call("second")


def test_toll_functions_end_to_end(spark):
    p = lambda **t: {n: {"type": k, "required": i == 0} for i, (n, k) in enumerate(t.items())}
    memory = {"type": "runtime_memory"}
    raw = {"objects": {
        "Contiguity": {"source": memory, "properties": p(edge_id="str", en_road_node_id="str", en_road_node_type="int", ex_road_node_id="str", ex_road_node_type="int", miles="int", charge_miles="int", invalid="int", rule_id="str")},
        "ProvinceRateParam": {"source": memory, "properties": p(param_id="str", toll_interval_id="str", vehicle_type="int", fee="int", mfee="int", efee="int", rate_source="str")},
        "MinimumFeePath": {"source": memory, "properties": p(path_id="str", en_station_id="str", ex_station_id="str", vehicle_type="int", toll_intervals="str", chargefee_group="str", chargefee95_group="str", total_fee="int", total_fee95="int", total_mileage="int")},
        "ValidationError": {"source": memory, "properties": p(error_id="str", path_id="str", rule_id="str", message="str")},
        "TollUnit": {"properties": p(toll_interval_id="str")}, "TollStation": {"properties": p(station_id="str")}, "BaseRate": {"properties": p(rate_code="str")},
        "SpecialTimeDiscount": {"properties": p(toll_interval_id="str")}, "NoContiguityRule": {"properties": p(en_road_node_id="str")},
    }, "functions": {
        "build_graph": {}, "compute_fees": {"depends_on": ["build_graph"], "params": {"vehicle_types": {"type": "str", "default": "1"}}},
        "find_path": {"depends_on": ["compute_fees"], "params": {"en_station_id": {"type": "str"}, "ex_station_id": {"type": "str"}, "vehicle_type": {"type": "int", "default": 1}}},
        "validate_path": {"params": {"path_id": {"type": "str"}}},
    }}
    repo = ObjectRepository(spark, ontology_from_dict(raw))
    repo.provide("TollUnit", spark.createDataFrame(
        [("A", "1", "S1", 1, "N", 2, "", "10", "100", "g1"), ("B", "1", "N", 2, "S2", 1, "", "10", "200", "g2"), ("C", "60", "S1", 1, "S2", 1, "", "10", "900", "g3")],
        "toll_interval_id string, rate_code string, start_org_id string, start_org_type int, end_org_id string, end_org_type int, opposite_id string, actual_length string, charge_length string, gantry_id string"))
    repo.provide("TollStation", spark.createDataFrame([("S1", 2), ("S2", 2)], "station_id string, use_status int"))
    repo.provide("BaseRate", spark.createDataFrame([("1", 1, "0.5"), ("60", 1, "170.5")], "rate_code string, vehicle_type int, vc_rate string"))
    repo.provide("SpecialTimeDiscount", spark.createDataFrame([("C", "1", "0", "24", 500, 600)], "toll_interval_id string, vehicle_type string, start_hour string, end_hour string, cpc_discount int, etc_discount int"))
    repo.provide("NoContiguityRule", spark.createDataFrame([], "en_road_node_id string, en_road_node_type int, ex_road_node_id string, ex_road_node_type int, contiguity_type int"))
    reg = FunctionRegistry(repo)
    register_toll(reg)
    row = reg.call("find_path", en_station_id="S1", ex_station_id="S2").first()
    # A+B cost 50+100, C costs round(170.5)=170 at half price 85.
    assert (row["toll_intervals"], row["total_fee"], row["total_mileage"]) == ("C", 100, 900)
    assert reg.call("validate_path", path_id=row["path_id"]).count() == 0


def test_streams_process_files_once(spark, tmp_path):
    docs = tmp_path / "in"
    schema = "document_id string, title string, text string, version bigint"
    spark.createDataFrame([("d1", "t", "one", 1), ("d2", "t", "two", 1)], schema).write.parquet(str(docs))
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def step():
        stream = spark.readStream.schema(schema).parquet(str(docs))
        incremental.sync_documents(stream, out, check).awaitTermination()

    step()
    spark.createDataFrame([("d1", "t", "one changed", 2)], schema).write.mode("append").parquet(str(docs))
    step()
    step()
    store = spark.read.parquet(out)
    assert store.count() == 3
    gone = spark.createDataFrame([("d2", 5)], "document_id string, version bigint")
    assert {r["document_id"]: r["text"] for r in incremental.latest_documents(store, gone).collect()} == {"d1": "one changed"}


def test_alarm_stream(spark, tmp_path):
    src, out = str(tmp_path / "a"), str(tmp_path / "b")
    spark.createDataFrame([("c1", "2024-01-01 00:00:00 断路器跳闸", "甲站")], "chain_id string, event_text string, station_name string").write.parquet(src)
    stream = spark.readStream.schema("chain_id string, event_text string, station_name string").parquet(src)
    incremental.parse_alarms(stream, out, str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(out).first()["severe_signal"]
