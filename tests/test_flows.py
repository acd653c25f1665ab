import json
import random

from pyspark.sql import functions as F

from flowloop import schemas
from flowloop.operators.decode import decode
from flowloop.operators.features import assemble
from flowloop.operators.normalize import COALESCE, flow_rejects, normalize_flows, with_flow_columns
from tests.conftest import plan_of


def _flow(source="1.2.3.4", dest="5.6.7.8", source_port=1000, dest_port=53, **more):
    return {"source": {"ip": source, "port": source_port}, "dest": {"ip": dest, "port": dest_port}, **more}


def _messages(spark, *values):
    rows = [(str(i), v if v is None or isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "key string, value string")


def _reasons(spark, *values, mode="last_wins"):
    rows = with_flow_columns(decode(_messages(spark, *values)), mode).collect()
    return [row.reason for row in sorted(rows, key=lambda row: int(row.key))]


def test_schema_file_round_trip(spark, tmp_path):
    path = tmp_path / "schema.json"
    path.write_text(schemas.BEATS.json())
    assert schemas.load_schema(spark, str(path)) == schemas.BEATS
    columns = tmp_path / "columns.json"
    columns.write_text(json.dumps({"columns": schemas.TRAINING_COLUMNS, "feature_columns": schemas.FEATURES}))
    assert schemas.load_columns(spark, str(columns)) == (schemas.TRAINING_COLUMNS, schemas.FEATURES)


def test_unusable_text_is_kept_as_nulls(spark):
    values = ["not json", None, "[]", "{}", "", '{"source": {"ip": "1.2.3.4"']
    rows = decode(_messages(spark, *values)).collect()
    assert len(rows) == len(values)
    assert _reasons(spark, *values[:5]) == ["undecodable"] * 5


def test_a_mistyped_field_does_not_blank_its_neighbours(spark):
    value = _flow(dest_port="53", bytes_out="many", type="flow")
    row = decode(_messages(spark, value)).first().data
    assert row.dest.port is None and row.dest.ip == "5.6.7.8"
    assert row.bytes_out is None and row.source.port == 1000
    assert decode(_messages(spark, _flow(dest_port=5_000_000_000))).first().data.dest.port is None


def test_binary_envelopes_are_cast(spark):
    df = _messages(spark, _flow()).select(F.col("key").cast("binary"), F.col("value").cast("binary"))
    row = decode(df).first()
    assert row.key == "0" and row.data.source.ip == "1.2.3.4"


def test_reject_reasons(spark):
    assert _reasons(
        spark,
        _flow(),
        _flow(source=None),
        _flow(dest=None),
        _flow(source_port=None),
        _flow(dest_port=None),
        _flow(source=""),
        _flow(source="256.1.1.1"),
        _flow(dest="::1"),
        {"client_ip": 7, "ip": 8},
    ) == [
        None,
        "missing source_ip",
        "missing dest_ip",
        "missing source_port",
        "missing dest_port",
        "invalid source_ip",
        "invalid source_ip",
        "invalid dest_ip",
        "missing source_ip",
    ]


def test_address_forms(spark):
    decoded = decode(_messages(spark, _flow(source="127.1"), _flow(source="x")))
    assert normalize_flows(decoded).count() == 0
    assert normalize_flows(decoded, form="inet_aton").first().source_ip == 2130706433
    assert flow_rejects(decoded, form="inet_aton").count() == 1


def test_address_precedence(spark):
    nested = {"src_ip": "9.9.9.9", "dest_ip": "8.8.8.8"}
    values = [_flow(json=nested), _flow(source=None, dest=None, json=nested)]
    assert _reasons(spark, *values) == [None, "missing source_ip"]
    rows = normalize_flows(decode(_messages(spark, *values)), COALESCE).orderBy("key").collect()
    assert [(r.source_ip, r.dest_ip) for r in rows] == [(16909060, 84281096), (151587081, 134744072)]


def test_flows_and_rejects_partition_the_messages(messages):
    decoded = decode(messages)
    flows, rejects, total = normalize_flows(decoded).count(), flow_rejects(decoded).count(), messages.count()
    assert flows > 0 and rejects > 0
    assert flows + rejects == total


def test_flow_columns_and_types(messages):
    assert normalize_flows(decode(messages)).dtypes[-4:] == [
        ("source_ip", "bigint"),
        ("dest_ip", "bigint"),
        ("dest_port", "int"),
        ("source_port", "int"),
    ]


def test_each_message_is_parsed_once_and_never_in_python(messages):
    for df in (normalize_flows(decode(messages)), flow_rejects(decode(messages))):
        plan = plan_of(df)
        assert plan.count("from_json(") == 1
        assert plan.count("RLIKE") == 2
        assert "Python" not in plan and "Exchange" not in plan


def test_only_used_columns_are_scanned(spark, tmp_path):
    df = _messages(spark, _flow()).withColumn("unused", F.lit("x"))
    df.write.parquet(str(tmp_path / "m"))
    flows = normalize_flows(decode(spark.read.parquet(str(tmp_path / "m"))))
    assert "ReadSchema: struct<value:string>" in plan_of(flows.select("source_ip"))


def test_feature_order(spark):
    row = assemble(normalize_flows(decode(_messages(spark, _flow())))).first()
    assert list(row.features) == [16909060.0, 1000.0, 84281096.0, 53.0]


def _plain_flow(value):
    """The four numbers by plain Python, or None."""

    def address(text):
        parts = text.split(".") if isinstance(text, str) else []
        if len(parts) != 4 or any(not p.isdigit() or str(int(p)) != p or int(p) > 255 for p in parts):
            return None
        return sum(int(p) << shift for p, shift in zip(parts, (24, 16, 8, 0)))

    def port(number):
        return number if isinstance(number, int) and -(2**31) <= number < 2**31 else None

    def end(name):
        found = value.get(name) if isinstance(value, dict) else None
        return found if isinstance(found, dict) else {}

    source, dest = end("source"), end("dest")
    row = (
        address(source.get("ip")),
        port(source.get("port")),
        address(dest.get("ip")),
        port(dest.get("port")),
    )
    return None if None in row else row


def test_random_records_against_plain_python(spark):
    draw = random.Random(5)
    ips = ["1.2.3.4", "255.0.0.255", "256.1.1.1", "01.2.3.4", "", "x", None, 7, "10.0.0.1"]
    ports = [0, 53, 65535, -1, 2**31 - 1, 2**31, None, "80", 443]
    ends = [{"ip": i, "port": p} for i in ips for p in ports] + [{}, {"ip": "1.1.1.1"}, None, "x", 3]
    good = [{"ip": "9.8.7.6", "port": 5}]
    ends += good * 80
    values = [
        {"source": draw.choice(ends), "dest": draw.choice(ends), "bytes_out": draw.choice([1, "a"])}
        for _ in range(600)
    ]
    values += [{}, {"source": good[0]}, {"dest": good[0]}]
    rows = normalize_flows(decode(_messages(spark, *values))).collect()
    found = {int(r.key): (r.source_ip, r.source_port, r.dest_ip, r.dest_port) for r in rows}
    expected = {i: _plain_flow(v) for i, v in enumerate(values)}
    assert found == {i: row for i, row in expected.items() if row is not None}
    assert len(found) > 100
