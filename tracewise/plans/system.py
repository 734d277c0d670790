"""System level: one row per run and step over all workers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewise.functions.scalars import per_second, percentage
from tracewise.plans.worker import PARTS
from tracewise.schemas import LAYERS

_DEVICE_TOTALS = [
    "device_duration",
    "device_duration_without_wait",
    "device_duration_without_wait_and_io",
]


def power_peak(power: DataFrame) -> DataFrame:
    """Sum over a run's GPUs of each one's highest draw.

    Added up as decimals, so that the result does not depend on the order.
    """
    peaks = power.groupBy("run_id", "gpu_uuid").agg(F.max("watts").alias("peak"))
    return peaks.groupBy("run_id").agg(
        F.count("peak").alias("gpus"),
        F.sum(F.col("peak").cast("decimal(18,6)")).cast("double").alias("peak_watts"),
    )


def system_stats(workers: DataFrame, power: DataFrame | None = None) -> DataFrame:
    """Sums, slowest-worker totals, layer shares and rates of every step.

    The offline shares of input and output are over a total without them, so
    they can exceed 100.
    """
    summed = workers.groupBy("run_id", "step_id").agg(
        F.max("batch_size").alias("batch_size"),
        F.count("rank").alias("worker_number"),
        F.count("local_rank").alias("local_worker_number"),
        F.sum("input_device_bytes").alias("input_bytes"),
        F.sum("communication_send_bytes").alias("send_bytes"),
        F.sum("communication_recv_bytes").alias("recv_bytes"),
        *[F.sum(f"{layer}_weights").alias(f"{layer}_weights") for layer in LAYERS],
        F.sum("output_device_bytes").alias("output_bytes"),
        *[F.sum(c).alias(f"{c}_sum") for c in PARTS.values()],
        *[F.max(c).alias(c) for c in _DEVICE_TOTALS],
        *[F.sum(c).alias(f"{c}_sum") for c in _DEVICE_TOTALS],
        (F.max("host_end") - F.min("host_start")).alias("host_duration"),
    )

    shares = {}
    for scenario, whole in (
        ("server", "device_duration_without_wait_sum"),
        ("offline", "device_duration_without_wait_and_io_sum"),
    ):
        for name, c in PARTS.items():
            shares[f"{scenario}_{name}_percentage"] = percentage(F.col(f"{c}_sum"), F.col(whole))

    exchanged = F.col("send_bytes") + F.col("recv_bytes")
    images = F.col("batch_size")
    rates = {
        "input_throughput": per_second(
            F.col("input_bytes"), F.col("input_device_duration_sum")
        ),
        "output_throughput": per_second(
            F.col("output_bytes"), F.col("output_device_duration_sum")
        ),
        "communication_throughput": per_second(
            exchanged, F.col("communication_transfer_device_duration_sum")
        ),
        "ips": per_second(images, F.col("host_duration")),
        "ideal_ips": per_second(images, F.col("device_duration")),
        "ideal_ips_without_wait": per_second(images, F.col("device_duration_without_wait")),
        "ideal_ips_without_wait_and_io": per_second(
            images, F.col("device_duration_without_wait_and_io")
        ),
    }
    result = summed.withColumns({**shares, **rates})
    if power is None:
        return result.withColumn("ipw", F.lit(None).cast("double"))
    peaks = power_peak(power).select("run_id", "peak_watts")
    return (
        result.join(peaks, "run_id", "left")
        .withColumn("ipw", F.try_divide(F.col("ips"), F.col("peak_watts")))
        .drop("peak_watts")
    )
