"""Value types: kept on reading, merged over the log, and given to columns."""

from __future__ import annotations

import struct

import pytest
from pyspark.sql import functions as F

from tidelog.operators.flatten import field_types, flatten_typed
from tidelog.sources import packing, sinks
from tidelog.sources.recordings import read_recordings


def typed(spark, *rows):
    """A log of SQL literals by field name."""
    parts = [
        "select 's' stream_name, bigint({0}) ms, bigint(0) seq, {1} fields, 'r' recording, bigint({0}) pos".format(
            i, "map({})".format(", ".join(f"'{k}', cast({v} as variant)" for k, v in row.items())) if row
            else "cast(map() as map<string,variant>)"
        )
        for i, row in enumerate(rows)
    ]
    return spark.sql(" union all ".join(parts))


def test_types_of_fields(spark):
    log = typed(
        spark,
        {"n": "1", "f": "1.5D", "b": "true", "nf": "1", "nb": "1", "s": "'x'", "z": "null", "d": "1.25"},
        {"n": "2", "f": "0.5D", "b": "false", "nf": "2.5D", "nb": "true", "s": "'1'", "a": "array(1)"},
        {},
    )
    found = {r.field_key: r.type for r in field_types(log).collect()}
    assert found == {
        "a": "STRING", "b": "BOOLEAN", "d": "DECIMAL(3,2)", "f": "DOUBLE", "n": "BIGINT",
        "nb": "STRING", "nf": "DOUBLE", "s": "STRING", "z": "STRING",
    }
    rows = flatten_typed(log).orderBy("timestamp_ms").collect()
    assert (rows[0].n, rows[0].f, rows[0].b, rows[0].nf, rows[0].nb, rows[0].s, rows[0].z) == (1, 1.5, True, 1.0, "1", "x", None)
    assert (rows[1].nb, rows[1].s, rows[1].a, rows[1].d) == ("true", "1", "[1]", None)
    assert rows[2].n is None and rows[2].message_id == "2-0"


def test_refused_names(spark):
    with pytest.raises(ValueError, match="base column"):
        flatten_typed(typed(spark, {"message_id": "1"}))
    assert flatten_typed(typed(spark, {"message_id": "1"}), prefix_reserved=True).first().field_message_id == 1
    with pytest.raises(ValueError, match="differ only by case"):
        flatten_typed(typed(spark, {"a": "1", "A": "2"}))
    with pytest.raises(ValueError, match="more than 1"):
        flatten_typed(typed(spark, {"a": "1", "b": "2"}), max_keys=1)
    assert flatten_typed(typed(spark, {"a": "1"}).limit(0)).columns == ["stream_name", "message_id", "timestamp_ms"]


def test_types_of_a_recording(spark, tmp_path):
    def value(raw):
        return b"\x93\xa1s\xa31-0\x81\xa1v" + raw

    values = [b"\x07", b"\xcb" + struct.pack(">d", 2.0), b"\xcb" + struct.pack(">d", 1e300), b"\xff"]
    (tmp_path / "numbers").write_bytes(b"".join(map(value, values)))
    (tmp_path / "mixed").write_bytes(
        b"".join(map(value, [b"\xc3", b'\xa3"q\n', b"\xcb" + struct.pack(">d", float("nan")), b"\xcf" + b"\xff" * 8, b"\xc0"]))
    )
    numbers = read_recordings(spark, str(tmp_path / "numbers"), typed=True)
    assert flatten_typed(numbers).schema["v"].dataType.simpleString() == "double"
    assert [r.v for r in flatten_typed(numbers).collect()] == [7.0, 2.0, 1e300, -1.0]
    mixed = flatten_typed(read_recordings(spark, str(tmp_path / "mixed"), typed=True))
    assert [r.v for r in mixed.collect()] == ["true", '"q\n', "nan", str(2**64 - 1), None]
    assert read_recordings(spark, str(tmp_path / "none"), typed=True).count() == 0
    out = str(tmp_path / "out")
    assert sinks.export(numbers, out)
    assert spark.read.parquet(out).agg(F.max("v")).first()[0] == 1e300
    with pytest.raises(ValueError, match="found, not given"):
        sinks.export(numbers, out + "2", keys=["v"])
    assert not sinks.export(numbers.limit(0), out + "3")


@pytest.mark.parametrize("value", [0, -5, 2**63, True, 1.0, 1e22, 1e-9, -0.0, "text", None])
def test_json_of_values(value):
    import json

    text = packing._as_json(value)
    back = None if text is None else json.loads(text)
    assert back == value and (value is None or type(back) is type(value))
    if isinstance(value, float):
        assert "e" in text.lower()
