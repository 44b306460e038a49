"""What reading requests costs: one parse of the text, and rows that don't carry their whole request."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliolens.plans.requests import distinct_requests, process_requests, unreadable, with_specs
from foliolens.plans.reuse import materialize
from foliolens.sources.requests import inflate_requests, read_requests, request_sections, section_rows
from tests.conftest import table

TYPES = {"instrument_id": "bigint", "sub_portfolio_id": "bigint", "o'k": "string", "flag": "boolean"}


def _requests(spark, *texts):
    return table(spark, [{"request_id": f"r{i}", "request": t} for i, t in enumerate(texts)], "request_id string, request string")


def test_attributes_do_not_carry_the_names_of_the_whole_request(spark):
    ids = ",".join(f'"a long identifier {i}":{{"instrument_id":{i}}}' for i in range(500))
    rows = section_rows(request_sections(_requests(spark, f'{{"holding":{{"positions":{{{ids}}}}}}}'))).collect()
    assert len(rows) == 500 and max(len(r["_attributes"].metadata) for r in rows) < 100


def test_refusals_need_no_parse_of_their_own(spark):
    known = materialize(with_specs(distinct_requests(_requests(spark, '{"holding":{"positions":{}}}', "[1]"))))
    refused = unreadable(known)
    assert "parse_json" not in refused._jdf.queryExecution().toString()
    assert [tuple(r) for r in refused.collect()] == [("r1", "the request is not a JSON object")]


def test_odd_requests_are_read_as_before(spark):
    odd = _requests(
        spark,
        '{"holding":{"positions":{"p":{"instrument_id":1,"o\'k":"x","flag":"maybe"},"q":5,"r":null,"s":{"instrument_id":"9"}}}}',
        '{"holding":{"positions":[1],"essential_lookthroughs":{"c":{"instrument_id":2.5,"container":"own"}}}}',
        '{"a":{"positions":null},"b":[{"positions":{}}],"c":{"positions":5,"x":{"y":{}}}}',
        '{"holding":{"positions":{"\\u0069dentifier":["u","v"],"instrument_id":[3,4],"sub_portfolio_id":[1,1],"o\'k":["x","y"],"flag":[true,false]}}}',
    )
    found = [
        tuple(r)
        for frame in read_requests(odd, TYPES)
        for r in frame.select("request_id", "container", "record_type", "identifier", "instrument_id", "o'k", "flag").collect()
    ]
    positions = [("p", 1, "x", None), ("q", None, None, None), ("r", None, None, None), ("s", 9, None, None)]
    assert sorted(found, key=str) == sorted(
        [("r0", "holding", "positions", *p) for p in positions] + [("r1", "holding", "essential_lookthroughs", "c", 2, None, None)], key=str
    )
    run = process_requests(odd, types=TYPES, defaults=[])
    errors = {r["request_id"]: r["error"] for r in run.errors.collect()}
    assert errors == {i: "column sub_portfolio_id is missing" for i in ("r0", "r1")}
    mixed = inflate_requests(odd, TYPES)[0].where("request_id = 'r3'")
    assert sorted(r["identifier"] for r in mixed.collect()) == ["u", "v"]
