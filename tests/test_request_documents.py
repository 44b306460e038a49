"""What request documents cost: a request is parsed once and gathered once, and so is its document."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

import foliolens.plans.requests as plans
from foliolens.plans.requests import distinct_requests, process_requests, with_specs
from foliolens.plans.reuse import materialize, settings
from foliolens.registry.output_queries import document_weights
from foliolens.sources.requests import read_requests
from tests.conftest import table

TYPES = {"instrument_id": "bigint", "parent_instrument_id": "bigint", "sub_portfolio_id": "bigint", "initial_weight": "double"}
SPEC = (
    '"position_weight_labels":["initial_weight"],"lookthrough_weight_labels":["initial_weight"],'
    '"perspective_configurations":{"b \\"x\\"":{"-1":[]},"a":{"-1":["scale_holdings_to_100_percent"],"-2":null}},'
    '"custom_perspective_rules":{"-1":{"rules":[{"apply_to":"both","criteria":{"column":"instrument_id","operator_type":"<=","value":3}}]},'
    '"-2":{"rules":[{"apply_to":"both","criteria":{"column":"instrument_id","operator_type":">","value":1}}]}}'
)
ROW = '{"instrument_id":%d,"sub_portfolio_id":5,"initial_weight":%s}'
HOLDING = f'{{"positions":{{"p\\"1":{ROW % (1, 0.25)},"p2":{ROW % (2, 0.75)}}},"essential_lookthroughs":{{"c":{{"parent_instrument_id":2,{(ROW % (3, "null"))[1:]}}}}}'
REQUEST = f'{{{SPEC},"holding":{HOLDING},"selected_reference":{{"positions":{{"q":{ROW % (2, 0.5)}}}}}}}'


def requests(spark):
    rows = [{"request_id": i, "request": t} for i, t in (("r0", REQUEST), ("r1", REQUEST), ("none", f'{{{SPEC},"holding":{{"positions":{{}}}}}}'))]
    return table(spark, rows, "request_id string, request string")


def test_rows_are_read_from_the_parsed_request(spark):
    known = materialize(with_specs(distinct_requests(requests(spark))))
    rows = read_requests(known, TYPES)[0]
    plan = known._jdf.queryExecution().toString() + rows._jdf.queryExecution().toString()
    assert "parse_json" not in plan
    assert rows.count() == 6


def test_few_refusals_are_found_once(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(plans, "materialize_if_possible", lambda df: stored.append(df) or materialize(df))
    run = process_requests(requests(spark), types=TYPES, defaults=[])
    assert any(df.columns == ["request_id", "error"] and "sub_portfolio_id" in str(df._jdf.queryExecution().analyzed()) for df in stored)
    assert run.requests.columns[:2] == ["request_id", "request"] and "_parsed" not in run.requests.columns


@pytest.mark.parametrize("columnar", [False, True])
def test_a_document_is_gathered_once(spark, columnar):
    done = process_requests(requests(spark), types=TYPES, defaults=[]).documents(columnar)
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array(collect_list") == 1 + columnar, plan  # not for each level of objects
    found = {r["request_id"]: json.loads(r["document"])["perspective_configurations"] for r in done.collect()}
    assert found["none"] == {} and found["r0"] == found["r1"]
    assert list(found["r0"]) == ["a", 'b "x"'] and list(found["r0"]["a"]) == ["-1", "-2"]
    assert list(found["r0"]["a"]["-1"]) == ["holding", "selected_reference"]
    assert list(found["r0"]["a"]["-1"]["holding"]) == ["essential_lookthroughs", "positions", "scale_factors"]
    scaled = found["r0"]["a"]["-1"]["holding"]
    expected = {"identifier": ['p"1', "p2"], "initial_weight": [0.25, 0.75]} if columnar else {'p"1': {"initial_weight": 0.25}, "p2": {"initial_weight": 0.75}}
    assert scaled["positions"] == expected and scaled["scale_factors"]["initial_weight"] == 1.0
    assert list(found["r0"]['b "x"']) == ["-1"] and found["r0"]['b "x"']["-1"]["holding"] == scaled


@pytest.mark.parametrize("columnar", [False, True])
def test_documents_are_read_back_by_one_parse(spark, columnar):
    done = process_requests(requests(spark), types=TYPES, defaults=[]).documents(columnar)
    rows = document_weights(materialize(done), columnar)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object" not in plan and plan.count("from_json") == 1
    found = {tuple(r)[1:] for r in rows.where("request_id = 'r1'").where(F.col("container") == "selected_reference").collect()}
    assert found == {("-1", "selected_reference", "q", 0.5), ("-1", "selected_reference", "q", 1.0), ("-2", "selected_reference", "q", 0.5)}


def test_settings_last_as_long_as_their_block(spark):
    name = "spark.sql.execution.useObjectHashAggregateExec"
    before = spark.conf.get(name)
    with pytest.raises(ZeroDivisionError), settings(spark, {name: "false", "spark.sql.none.such": "1"}):
        assert spark.conf.get(name) == "false"
        1 / 0
    assert spark.conf.get(name) == before and spark.conf.get("spark.sql.none.such", None) is None
