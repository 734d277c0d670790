"""Report tables: projections of the statistics at the last step."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# File names, columns and headers of the reports.
_SYSTEM = {
    "system_ips": {
        "batch_size": "Batch Size",
        "ips": "IPS",
        "ideal_ips": "Ideal IPS",
        "ideal_ips_without_wait": "Ideal IPS without Wait",
        "ideal_ips_without_wait_and_io": "Ideal IPS without Wait and IO",
    },
    "system_ipw": {"batch_size": "Batch Size", "ipw": "IPW"},
    "system_e2e_latency": {
        "batch_size": "Batch Size",
        "host_duration": "Latency(ns)",
        "device_duration": "Device Latency(ns)",
        "device_duration_without_wait": "Device Latency Without Wait(ns)",
        "device_duration_without_wait_and_io": "Device Latency Without Wait and IO(ns)",
    },
    "system_io": {
        "batch_size": "Batch Size",
        "input_bytes": "Input(bytes)",
        "output_bytes": "Output(bytes)",
    },
    "system_io_throughput": {
        "batch_size": "Batch Size",
        "input_throughput": "Input(bytes/s)",
        "output_throughput": "Output(bytes/s)",
    },
    "system_communication_bytes": {
        "batch_size": "Batch Size",
        "send_bytes": "Send(bytes)",
        "recv_bytes": "Receive(bytes)",
    },
    "system_communication_throughput": {
        "batch_size": "Batch Size",
        "communication_throughput": "Throughput(bytes/s)",
    },
    "system_layer_weights": {
        "batch_size": "Batch Size",
        "bottom_mlp_weights": "Bottom MLP(bytes)",
        "embedding_weights": "Embedding(bytes)",
        "interaction_weights": "Interaction(bytes)",
        "top_mlp_weights": "Top MLP(bytes)",
    },
    "system_layer_latency_without_communication_wait": {
        "batch_size": "Batch Size",
        "input_device_duration_sum": "Input(ns)",
        "bottom_mlp_device_duration_sum": "Bottom MLP(ns)",
        "embedding_device_duration_sum": "Embedding(ns)",
        "communication_transfer_device_duration_sum": "Communication(ns)",
        "interaction_device_duration_sum": "Interaction(ns)",
        "top_mlp_device_duration_sum": "Top MLP(ns)",
        "output_device_duration_sum": "Output(ns)",
    },
    "system_layer_latency_without_communication_wait_and_io": {
        "batch_size": "Batch Size",
        "bottom_mlp_device_duration_sum": "Bottom MLP(ns)",
        "embedding_device_duration_sum": "Embedding(ns)",
        "communication_transfer_device_duration_sum": "Communication(ns)",
        "interaction_device_duration_sum": "Interaction(ns)",
        "top_mlp_device_duration_sum": "Top MLP(ns)",
    },
    "system_layer_percentage_without_communication_wait": {
        "batch_size": "Batch Size",
        "server_input_percentage": "Input(%)",
        "server_bottom_mlp_percentage": "Bottom MLP(%)",
        "server_embedding_percentage": "Embedding(%)",
        "server_communication_percentage": "Communication(%)",
        "server_interaction_percentage": "Interaction(%)",
        "server_top_mlp_percentage": "Top MLP(%)",
        "server_output_percentage": "Output(%)",
    },
    "system_layer_percentage_without_communication_wait_and_io": {
        "batch_size": "Batch Size",
        "offline_bottom_mlp_percentage": "Bottom MLP(%)",
        "offline_embedding_percentage": "Embedding(%)",
        "offline_communication_percentage": "Communication(%)",
        "offline_interaction_percentage": "Interaction(%)",
        "offline_top_mlp_percentage": "Top MLP(%)",
    },
}

_WORKER_KEYS = {"batch_size": "Batch Size", "rank": "Rank", "local_rank": "Local Rank"}

# Fixed values as above. The worker tables other than the two percentage ones
# are the data of charts.
_WORKER = {
    "worker_e2e_latency": {
        "host_duration": "Host Latency(ns)",
        "device_duration": "Device Latency(ns)",
        "device_duration_without_wait": "Device Latency Without Wait(ns)",
        "device_duration_without_wait_and_io": "Device Latency Without Wait And IO(ns)",
    },
    "worker_io": {
        "input_device_duration": "Input(ns)",
        "input_device_bytes": "Input(bytes)",
        "input_throughput": "Input(bytes/s)",
        "output_device_duration": "Output(ns)",
        "output_device_bytes": "Output(bytes)",
        "output_throughput": "Output(bytes/s)",
    },
    "worker_communication": {
        "communication_send_bytes": "Send(bytes)",
        "communication_recv_bytes": "Receive(bytes)",
        "communication_throughput": "Throughput(bytes/s)",
    },
    "worker_layer_latency": {
        "input_device_duration": "Input(ns)",
        "bottom_mlp_device_duration": "Bottom MLP(ns)",
        "embedding_device_duration": "Embedding(ns)",
        "communication_wait_device_duration": "Wait(ns)",
        "communication_transfer_device_duration": "Communication(ns)",
        "interaction_device_duration": "Interaction(ns)",
        "top_mlp_device_duration": "Top MLP(ns)",
        "output_device_duration": "Output(ns)",
    },
    "server_layer_percentage": {
        "server_input_percentage": "Input(%)",
        "server_bottom_mlp_percentage": "Bottom MLP(%)",
        "server_embedding_percentage": "Embedding(%)",
        "server_communication_percentage": "Communication(%)",
        "server_interaction_percentage": "Interaction(%)",
        "server_top_mlp_percentage": "Top MLP(%)",
        "server_output_percentage": "Output(%)",
    },
    "offline_layer_percentage": {
        "offline_bottom_mlp_percentage": "Bottom MLP(%)",
        "offline_embedding_percentage": "Emdedding(%)",
        "offline_communication_percentage": "Communication(%)",
        "offline_interaction_percentage": "Interaction(%)",
        "offline_top_mlp_percentage": "Top MLP(%)",
    },
}


@dataclass(frozen=True)
class Report:
    """A report: its level and its columns with their headers, in order."""

    level: str
    headers: dict[str, str]

    @property
    def columns(self) -> list[str]:
        return list(self.headers)


REPORTS = {
    **{name: Report("system", headers) for name, headers in _SYSTEM.items()},
    **{name: Report("worker", {**_WORKER_KEYS, **h}) for name, h in _WORKER.items()},
}


def report_table(name: str, last: DataFrame) -> DataFrame:
    """The report's columns of last-step statistics, in report order."""
    report = REPORTS[name]
    order = ["batch_size", "rank"] if report.level == "worker" else ["batch_size"]
    return last.select(*report.columns).orderBy(*order)


def with_log2_axis(report: DataFrame) -> DataFrame:
    """A report with the position of its batch size on a log2 axis."""
    return report.withColumn("log2_batch_size", F.log2("batch_size"))


def with_headers(name: str, report: DataFrame) -> DataFrame:
    return report.toDF(*REPORTS[name].headers.values())
