import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tracewise.functions import scalars
from tracewise.functions.payload import decode_payload, tensor_bytes, tensors_bytes


def one(spark, column, **values):
    types = {int: "bigint", str: "string", float: "double"}
    schema = ", ".join(f"{n} {types[type(v)]}" for n, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column).first()[0]


@pytest.mark.parametrize("gid", [0, 0x0100_0003E9_00002A, (7 << 56) | (1001 << 24) | 5, -(3 << 24) - 7])
def test_ids_truncate_towards_zero(spark, gid):
    sign, size = (-1 if gid < 0 else 1), abs(gid)
    assert one(spark, scalars.process_id("g"), g=gid) == sign * (size // 2**24 % 2**24)
    assert one(spark, scalars.thread_id("g"), g=gid) == sign * (size % 2**24)


def test_event_type_names(spark):
    assert one(spark, scalars.event_type_name(F.col("c")), c=59) == "NvtxPushPopRange"
    assert one(spark, scalars.event_type_name(F.col("c")), c=58) is None


def test_ratios_over_zero_are_null(spark):
    assert one(spark, scalars.per_second(F.lit(10), F.col("ns")), ns=0) is None
    assert one(spark, scalars.per_second(F.lit(0), F.col("ns")), ns=0) is None
    assert one(spark, scalars.per_second(F.lit(10), F.col("ns")), ns=5) == 10 / (5 * 1e-9)
    assert one(spark, scalars.percentage(F.lit(3), F.col("w")), w=0) is None
    assert one(spark, scalars.percentage(F.lit(3), F.col("w")), w=4) == 75.0


def test_axis_label(spark):
    assert one(spark, scalars.axis_label(F.col("n")), n="batch_size") == "Batch Size"


@pytest.mark.parametrize(
    ("tensor", "expected"),
    [
        ('[[2, 3], "float16"]', 12),
        ('[[128,64],"float32"]', 32768),
        ("[]", 0),
        ('[[], "float32"]', 4),
        ('[[0], "int32"]', 0),
        ('[[2], "float64"]', None),
        ("[[2]]", None),
    ],
)
def test_tensor_bytes(spark, tensor, expected):
    payload = decode_payload(F.col("t"))
    text = f'{{"event": "input", "tensor": {tensor}}}'
    assert one(spark, tensor_bytes(payload["tensor"]), t=text) == expected


@pytest.mark.parametrize(
    ("tensors", "expected"),
    [
        ("[]", 0),
        ('[[[64, 32], "float16"], [[32], "float32"]]', 64 * 32 * 2 + 128),
        ('[[[1], "float16"], [[1], "complex"]]', None),
    ],
)
def test_tensors_bytes(spark, tensors, expected):
    payload = decode_payload(F.col("t"))
    text = f'{{"event": "compute", "weights": {tensors}}}'
    assert one(spark, tensors_bytes(payload["weights"]), t=text) == expected


def test_absent_tensor_is_null(spark):
    payload = decode_payload(F.col("t"))
    assert one(spark, tensor_bytes(payload["tensor"]), t='{"event": "input"}') is None
    assert one(spark, tensors_bytes(payload["weights"]), t='{"event": "compute"}') is None


def test_size_beyond_64_bits_raises(spark):
    payload = decode_payload(F.col("t"))
    text = '{"tensor": [[9000000000, 9000000000], "float16"]}'
    with pytest.raises(PySparkException, match="OVERFLOW|overflow"):
        one(spark, tensor_bytes(payload["tensor"]), t=text)
