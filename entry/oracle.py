"""The registered queries in SQL for DuckDB, written independently of the library:
plain joins on the interval conditions, one view per statistic.
"""

from __future__ import annotations

import re

from entry.queries import _REPORT_QUERIES, _VIEW_QUERIES, TABLE_SIZES, WIDTH

_W = '[[[64, 32], "float16"], [[32], "float16"]]'
_STEP = "run_id, step_id, rank, local_rank"
_EVENT = "event_name, event_value"


def _tensor(path: str, source: str = "j") -> str:
    """Bytes of the tensor at a JSON path."""
    dims = f"json_extract({source}, '{path}[0]')::BIGINT[]"
    dtype = f"json_extract_string({source}, '{path}[1]')"
    return (
        f"(coalesce(list_product({dims}), 1)::BIGINT"
        f" * CASE {dtype} WHEN 'float32' THEN 4 WHEN 'float16' THEN 2 WHEN 'int32' THEN 4 END)"
    )


def _tensors(path: str) -> str:
    """Bytes of the list of tensors at a JSON path."""
    return (
        f"(CASE WHEN json_extract(j, '{path}') IS NOT NULL THEN coalesce(list_sum(list_transform("
        f"json_extract(j, '{path}')::JSON[], lambda t: {_tensor('$', 't')})), 0)::BIGINT END)"
    )


def _range(event: str, *fields: str) -> str:
    value = ", event_value" if event in ("compute", "communication") else ""
    columns = "".join(f", json_extract(j, '$.{f}')::VARCHAR AS {f}" for f in fields)
    return (
        f'SELECT {_STEP}, globalTid, pid, tid, start, "end", duration, event_name{value}{columns}'
        f" FROM step_j WHERE event_name = '{event}'"
    )


def _runtime(event: str, pattern: str) -> str:
    value = ", o.event_value" if event in ("compute", "communication") else ""
    return f"""
        SELECT o.run_id, o.step_id, o.rank, o.local_rank, o.globalTid, o.pid, o.tid,
               o.event_name{value}, r.start, r."end", r.correlationId, r.function_name
        FROM named_runtime r JOIN step_{event}_range o
          ON r.run_id = o.run_id AND r.globalTid = o.globalTid
         AND r.start > o.start AND r."end" < o."end"
        WHERE r.function_name ILIKE '{pattern}'"""


def _kernel(event: str, device: str, columns: str) -> str:
    return f"""
        SELECT {columns}
        FROM step_{event}_runtime r JOIN {device} d
          ON r.run_id = d.run_id AND r.correlationId = d.correlationId
         AND r.pid = (d.globalPid // 16777216) % 16777216"""


def _host(event: str, group: str, *sums: str) -> str:
    extra = ", event_name" + (", event_value" if "event_value" in group else "")
    columns = ", ".join(f"sum({s})::BIGINT AS {a}" for a, s in (x.split("=") for x in sums))
    if "event_name" not in group:
        extra = ", arg_min(event_name, start) AS event_name"
    first = "(start, \"end\", globalTid)"
    return f"""
        SELECT {_STEP}, arg_min(globalTid, {first}) AS globalTid{extra},
               arg_min(duration, {first}) AS duration, sum(duration)::BIGINT AS duration_sum,
               {columns}
        FROM sized_spans WHERE event_name = '{event}' GROUP BY {group}"""


def _io_device(event: str) -> str:
    return f"""
        SELECT {_STEP}, any_value(globalTid) AS globalTid, event_name, sum(bytes)::BIGINT AS bytes,
               sum(duration)::BIGINT AS duration, avg(throughput) AS throughput
        FROM step_{event}_kernel GROUP BY {_STEP}, event_name"""


def _layer_device(source: str) -> str:
    return f"""
        SELECT {_STEP}, any_value(globalTid) AS globalTid, {_EVENT},
               sum(duration)::BIGINT AS duration
        FROM {source} GROUP BY {_STEP}, {_EVENT}"""


def _io_stats(event: str) -> str:
    return f"""
        SELECT h.run_id, h.step_id, h.rank, h.local_rank, h.globalTid,
               h.duration AS host_duration, h.duration_sum AS host_duration_sum,
               h.bytes AS host_bytes, d.duration AS device_duration, d.bytes AS device_bytes,
               d.throughput
        FROM step_{event}_host_stats h JOIN step_{event}_device_stats d
        USING ({_STEP})"""


def _comm_stats(part: str) -> str:
    return f"""
        SELECT h.run_id, h.step_id, h.rank, h.local_rank, h.globalTid,
               h.duration AS host_duration, h.duration_sum AS host_duration_sum,
               h.send_bytes, h.recv_bytes, d.duration AS device_duration
        FROM step_communication_host_stats h JOIN step_communication_{part}_device_stats d
        USING ({_STEP}, {_EVENT})"""


_THROUGHPUT = (
    "bytes::DOUBLE / nullif((d.\"end\" - d.start) * 1e-9::DOUBLE, 0) AS throughput"
)

_PARTS = {
    "input": "input_device_duration",
    "bottom_mlp": "bottom_mlp_device_duration",
    "embedding": "embedding_device_duration",
    "communication": "communication_transfer_device_duration",
    "interaction": "interaction_device_duration",
    "top_mlp": "top_mlp_device_duration",
    "output": "output_device_duration",
}
_OFFLINE = {k: v for k, v in _PARTS.items() if k not in ("input", "output")}
_LAYERS = ["bottom_mlp", "embedding", "interaction", "top_mlp"]


def _pct(part: str, whole: str, name: str) -> str:
    return f"({part}::DOUBLE / nullif({whole}, 0)) * 100 AS {name}"


def _rate(amount: str, ns: str, name: str) -> str:
    return f"({amount})::DOUBLE / nullif({ns} * 1e-9::DOUBLE, 0) AS {name}"


def _worker_stats() -> str:
    keys = f"{_STEP}, globalTid"

    def join(source, where=""):
        return f" LEFT JOIN (SELECT * FROM {source} {where}) AS "

    io = "host_duration host_bytes device_duration device_bytes throughput host_duration_sum"
    columns = []
    joins = ""
    for event in ("input", "output"):
        joins += join(f"step_{event}_stats") + f"{event}_s USING ({keys})"
        columns += [f"coalesce({event}_s.{c}, 0) AS {event}_{c}" for c in io.split()[:5]]
    # All communications of a step together.
    for part in ("wait", "transfer"):
        joins += f""" LEFT JOIN (SELECT {keys}, sum(host_duration)::BIGINT AS host_duration,
            sum(send_bytes)::BIGINT AS send_bytes, sum(recv_bytes)::BIGINT AS recv_bytes,
            sum(device_duration)::BIGINT AS device_duration
            FROM step_communication_{part}_stats GROUP BY {keys}) AS {part}_s USING ({keys})"""
        columns.append(
            f"coalesce({part}_s.device_duration, 0) AS communication_{part}_device_duration"
        )
    columns += [
        "coalesce(wait_s.host_duration, 0) AS communication_host_duration",
        "coalesce(wait_s.send_bytes, 0) AS communication_send_bytes",
        "coalesce(wait_s.recv_bytes, 0) AS communication_recv_bytes",
        "coalesce((transfer_s.send_bytes + transfer_s.recv_bytes)::DOUBLE"
        " / nullif(transfer_s.device_duration * 1e-9::DOUBLE, 0), 0) AS communication_throughput",
    ]
    for layer in _LAYERS:
        joins += join("step_compute_stats", f"WHERE event_value = '{layer}'")
        joins += f"{layer}_s USING ({keys})"
        columns += [
            f"coalesce({layer}_s.{c}, 0) AS {layer}_{c}"
            for c in ("weights", "host_duration", "device_duration")
        ]
    total = " + ".join(_PARTS.values())
    offline = " + ".join(_OFFLINE.values())
    server_whole, offline_whole = (
        "device_duration_without_wait",
        "device_duration_without_wait_and_io",
    )
    shares = [_pct(c, server_whole, f"server_{n}_percentage") for n, c in _PARTS.items()]
    shares += [_pct(c, offline_whole, f"offline_{n}_percentage") for n, c in _OFFLINE.items()]
    return f"""
        SELECT *, {", ".join(shares)} FROM (
          SELECT *, {total} + communication_wait_device_duration AS device_duration,
                 {total} AS device_duration_without_wait,
                 {offline} AS device_duration_without_wait_and_io
          FROM (SELECT {keys}, i.batch_size, i.host_start, i.host_end, i.host_duration,
                       {", ".join(columns)}
                FROM step_inference_stats i {joins}))"""


def _system_stats() -> str:
    totals = [
        "device_duration",
        "device_duration_without_wait",
        "device_duration_without_wait_and_io",
    ]
    sums = {f"{c}_sum": c for c in [*_PARTS.values(), *totals]}
    sums |= {
        "input_bytes": "input_device_bytes",
        "output_bytes": "output_device_bytes",
        "send_bytes": "communication_send_bytes",
        "recv_bytes": "communication_recv_bytes",
    }
    sums |= {f"{layer}_weights": f"{layer}_weights" for layer in _LAYERS}
    columns = [f"sum({c})::BIGINT AS {a}" for a, c in sums.items()]
    columns += [f"max({c}) AS {c}" for c in totals]
    shares = []
    for scenario, whole in (
        ("server", "device_duration_without_wait_sum"),
        ("offline", "device_duration_without_wait_and_io_sum"),
    ):
        shares += [
            _pct(f"{c}_sum", whole, f"{scenario}_{n}_percentage") for n, c in _PARTS.items()
        ]
    comm = "communication_transfer_device_duration_sum"
    shares += [
        _rate("input_bytes", "input_device_duration_sum", "input_throughput"),
        _rate("output_bytes", "output_device_duration_sum", "output_throughput"),
        _rate("send_bytes + recv_bytes", comm, "communication_throughput"),
        _rate("batch_size", "host_duration", "ips"),
        _rate("batch_size", "device_duration", "ideal_ips"),
        _rate("batch_size", "device_duration_without_wait", "ideal_ips_without_wait"),
        _rate(
            "batch_size", "device_duration_without_wait_and_io", "ideal_ips_without_wait_and_io"
        ),
    ]
    return f"""
        SELECT s.*, s.ips / nullif(p.peak_watts, 0) AS ipw FROM (
          SELECT *, {", ".join(shares)} FROM (
            SELECT run_id, step_id, max(batch_size) AS batch_size, count(rank) AS worker_number,
                   count(local_rank) AS local_worker_number,
                   max(host_end) - min(host_start) AS host_duration, {", ".join(columns)}
            FROM worker_stats GROUP BY run_id, step_id)) s
        LEFT JOIN power_peak p USING (run_id)"""


def _quality_checks() -> str:
    checks = []
    for event, stages in (
        ("input", ["runtime", "kernel"]),
        ("output", ["runtime", "kernel"]),
        ("communication", ["runtime", "kernel", "wait_kernel", "transfer_kernel"]),
    ):
        for stage in stages:
            checks.append(f"""
                SELECT r.run_id, 'step_{event}_{stage}' AS "check",
                  (SELECT count(*) FROM step_{event}_range x WHERE x.run_id = r.run_id) AS expected,
                  (SELECT count(*) FROM step_{event}_{stage} x WHERE x.run_id = r.run_id) AS actual
                FROM (SELECT DISTINCT run_id FROM spans) r""")
    return f"SELECT *, expected = actual AS passed FROM ({' UNION ALL '.join(checks)})"


# Everything the queries need, by name, in terms of the given tables.
_CTES: dict[str, str] = {
    "workers": """
        SELECT *, 1::BIGINT << run_id AS bs,
               step * 10000000 + rk * 5000 + (k * 7919) % 3000 + 1000000 AS t0,
               (1000 + rk) * 16777216 + (1000 + rk) AS globalTid,
               (1000 + rk) * 16777216 AS globalPid
        FROM (SELECT o_orderkey AS k, o_orderkey % 4 AS rk, (o_orderkey // 4) % 5 AS run_id,
                     o_orderkey // 20 AS step FROM orders)""",
    "inner_spans": f"""
        SELECT *, s + 200000 + (k * 104729 + slot * 1299709) % 500000 AS e,
          CASE slot
            WHEN 0 THEN '{{"event": "input", "name": "input", "tensor": [['
                        || (bs * 128) || '], "float16"]}}'
            WHEN 1 THEN '{{"event": "input", "name": "input", "tensor": [[' || bs
                        || '], "int32"]}}'
            WHEN 2 THEN '{{"event": "compute", "name": "bottom_mlp", "weights": {_W}}}'
            WHEN 3 THEN '{{"event": "compute", "name": "embedding", "weights": {_W}}}'
            WHEN 4 THEN '{{"event": "compute", "name": "embedding", "weights": {_W}}}'
            WHEN 5 THEN '{{"event": "communication", "name": "all_to_all", "send_tensors": [[['
                        || bs || ', 32], "float16"]], "recv_tensors": [[[' || bs
                        || ', 32], "float16"], [[0], "float16"]]}}'
            WHEN 6 THEN '{{"event": "compute", "name": "interaction", "weights": []}}'
            WHEN 7 THEN '{{"event": "compute", "name": "top_mlp", "weights": {_W}}}'
            ELSE '{{"event": "output", "name": "output", "tensor": [[' || bs
                 || '], "float16"]}}' END AS text
        FROM (SELECT *, t0 + 1000 + slot * 900000 AS s
              FROM workers, (SELECT unnest(range(0, 9)) AS slot)
              WHERE CASE WHEN slot IN (0, 5) THEN true WHEN slot = 2 THEN rk = 0
                         WHEN slot IN (1, 3, 4) THEN rk > 0 ELSE rk < bs END)""",
    "spans": """
        SELECT run_id, globalTid, 59::INTEGER AS eventType, t0 AS start, t0 + 9000000 AS "end",
               '{"event": "inference", "name": "inference", "rank": ' || rk || ', "local_rank": '
               || rk || ', "step": ' || step || ', "batch_size": ' || bs || '}' AS text
        FROM workers
        UNION ALL SELECT run_id, globalTid, 59, s, e, text FROM inner_spans
        UNION ALL SELECT run_id, globalTid, 34, s + 5, s + 6, '{"event": "input"}'
                  FROM inner_spans WHERE slot = 0
        UNION ALL SELECT run_id, globalTid, 59, s + 5, s + 6, NULL FROM inner_spans WHERE slot = 0
        UNION ALL SELECT run_id, globalTid, 59, s + 7, s + 8, '' FROM inner_spans WHERE slot = 5""",
    "calls": """
        SELECT run_id, globalTid, globalPid, k, slot, bs, s + 10000 AS start, s + 20000 AS "end",
               k * 64 + slot * 4 AS correlationId,
               (CASE WHEN slot IN (0, 1, 8) THEN 1 ELSE 2 END)::INTEGER AS nameId
        FROM inner_spans
        UNION ALL SELECT run_id, globalTid, globalPid, k, slot, bs, s + 40000, s + 50000,
                         k * 64 + slot * 4 + 1, 2 FROM inner_spans WHERE slot = 7
        UNION ALL SELECT run_id, globalTid, globalPid, k, slot, bs, s + 30000, s + 35000,
                         k * 64 + slot * 4 + 2, 3 FROM inner_spans""",
    "runtime": 'SELECT run_id, globalTid, start, "end", correlationId, nameId FROM calls',
    "kernels": """
        SELECT run_id, globalPid, ks AS start,
               ks + 100000 + (k * 32452843 + slot * 17) % 300000 AS "end", correlationId
        FROM (SELECT *, "end" + 50000
                     + CASE WHEN slot = 5 THEN (k * 15485863) % 400000 ELSE 0 END AS ks
              FROM calls WHERE nameId = 2)""",
    "copies": """
        SELECT run_id, globalPid, "end" + 1000 AS start,
               "end" + 21000 + (k * 31) % 9000 AS "end", correlationId,
               CASE slot WHEN 0 THEN bs * 256 WHEN 1 THEN bs * 4 ELSE bs * 2 END AS bytes
        FROM calls WHERE nameId = 1""",
    "string_ids": """
        SELECT run_id, n.id, n.value FROM (SELECT DISTINCT run_id FROM workers),
          (VALUES (1, 'cudaMemcpyAsync_v3020'), (2, 'cudaLaunchKernel_v7000'),
                  (3, 'cudaStreamSynchronize_v3020')) AS n(id, value)""",
    "power": """
        SELECT event_id % 5 AS run_id, event_id // 5 AS sample_idx,
               'GPU-' || (user_id % 4) AS gpu_uuid, value AS watts FROM events""",
    "decoded": """
        SELECT run_id, globalTid, (globalTid // 16777216) % 16777216 AS pid,
               globalTid % 16777216 AS tid, eventType, start, "end", "end" - start AS duration,
               json_extract_string(j, '$.event') AS event_name,
               json_extract_string(j, '$.name') AS event_value,
               json_extract(j, '$.step')::BIGINT AS step_id,
               json_extract(j, '$.rank')::BIGINT AS rank,
               json_extract(j, '$.local_rank')::BIGINT AS local_rank,
               json_extract(j, '$.batch_size')::BIGINT AS batch_size, text AS event, j
        FROM (SELECT *, try_cast(text AS JSON) AS j FROM spans)""",
    "step_inference_range": f"""
        SELECT {_STEP}, globalTid, pid, tid, {_EVENT}, batch_size, start, "end", duration
        FROM decoded WHERE eventType = 59 AND event_name = 'inference'""",
    "step_j": """
        SELECT d.run_id, i.step_id, i.rank, i.local_rank, d.globalTid, d.pid, d.tid, d.event_name,
               d.event_value, d.event, d.j, d.start, d."end", d.duration
        FROM decoded d JOIN step_inference_range i
          ON d.run_id = i.run_id AND d.globalTid = i.globalTid
         AND d.start > i.start AND d."end" < i."end"
        WHERE d.eventType = 59 AND d.event IS NOT NULL AND d.event != ''""",
    "step_range": "SELECT * EXCLUDE (j) FROM step_j",
    "step_input_range": _range("input", "tensor"),
    "step_output_range": _range("output", "tensor"),
    "step_compute_range": _range("compute", "weights"),
    "step_communication_range": _range("communication", "send_tensors", "recv_tensors"),
    "named_runtime": """
        SELECT r.*, n.value AS function_name
        FROM runtime r LEFT JOIN string_ids n ON r.run_id = n.run_id AND r.nameId = n.id""",
    "step_input_runtime": _runtime("input", "%Memcpy%"),
    "step_output_runtime": _runtime("output", "%Memcpy%"),
    "step_compute_runtime": _runtime("compute", "%LaunchKernel%"),
    "step_communication_runtime": _runtime("communication", "%LaunchKernel%"),
    "step_input_kernel": _kernel(
        "input", "copies",
        "r.run_id, r.step_id, r.rank, r.local_rank, r.globalTid, r.pid, r.tid, r.function_name,"
        ' r.event_name, d.bytes, d.correlationId, d."end" - d.start AS duration, ' + _THROUGHPUT,
    ),
    "step_output_kernel": _kernel(
        "output", "copies",
        "r.run_id, r.step_id, r.rank, r.local_rank, r.globalTid, r.event_name, d.bytes,"
        ' d."end" - d.start AS duration, ' + _THROUGHPUT,
    ),
    "step_compute_kernel": _kernel(
        "compute", "kernels",
        "r.run_id, r.step_id, r.rank, r.local_rank, r.globalTid, r.event_name, r.event_value,"
        ' r.function_name, d."end" - d.start AS duration',
    ),
    "step_communication_kernel": _kernel(
        "communication", "kernels",
        "r.run_id, r.step_id, r.rank, r.local_rank, r.globalTid, r.event_name, r.event_value,"
        ' d.start, d."end", d."end" - d.start AS duration',
    ),
    "step_communication_transfer_kernel_start": f"""
        SELECT run_id, step_id, {_EVENT}, max(start) AS start
        FROM step_communication_kernel GROUP BY run_id, step_id, {_EVENT}""",
    "step_communication_wait_kernel": f"""
        SELECT k.run_id, k.step_id, k.rank, k.local_rank, k.globalTid, k.event_name, k.event_value,
               CASE WHEN k."end" <= t.start THEN 0 ELSE t.start - k.start END AS duration
        FROM step_communication_kernel k JOIN step_communication_transfer_kernel_start t
        USING (run_id, step_id, {_EVENT})""",
    "step_communication_transfer_kernel": f"""
        SELECT k.run_id, k.step_id, k.rank, k.local_rank, k.globalTid, k.event_name, k.event_value,
               CASE WHEN k."end" <= t.start THEN k."end" - k.start ELSE k."end" - t.start END
                 AS duration
        FROM step_communication_kernel k JOIN step_communication_transfer_kernel_start t
        USING (run_id, step_id, {_EVENT})""",
    "sized_spans": f"""
        SELECT * EXCLUDE (j, event),
               CASE WHEN event_name IN ('input', 'output') THEN {_tensor('$.tensor')}
                    WHEN event_name = 'compute' THEN {_tensors('$.weights')} END AS bytes,
               {_tensors('$.send_tensors')} AS send_bytes,
               {_tensors('$.recv_tensors')} AS recv_bytes
        FROM step_j""",
    "step_input_host_stats": _host("input", _STEP, "bytes=bytes"),
    "step_output_host_stats": _host("output", f"{_STEP}, event_name", "bytes=bytes"),
    "step_communication_host_stats": _host(
        "communication", f"{_STEP}, {_EVENT}", "send_bytes=send_bytes", "recv_bytes=recv_bytes"
    ),
    "step_compute_host_stats": _host("compute", f"{_STEP}, {_EVENT}", "weights=bytes"),
    "step_input_device_stats": _io_device("input"),
    "step_output_device_stats": _io_device("output"),
    "step_compute_device_stats": _layer_device("step_compute_kernel"),
    "step_communication_wait_device_stats": _layer_device("step_communication_wait_kernel"),
    "step_communication_transfer_device_stats": _layer_device(
        "step_communication_transfer_kernel"
    ),
    "step_input_stats": _io_stats("input"),
    "step_output_stats": _io_stats("output"),
    "step_compute_stats": f"""
        SELECT h.run_id, h.step_id, h.rank, h.local_rank, h.globalTid, h.event_name, h.event_value,
               h.weights, h.duration AS host_duration, h.duration_sum AS host_duration_sum,
               d.duration AS device_duration
        FROM step_compute_host_stats h JOIN step_compute_device_stats d
        USING ({_STEP}, {_EVENT})""",
    "step_communication_wait_stats": _comm_stats("wait"),
    "step_communication_transfer_stats": _comm_stats("transfer"),
    "step_inference_stats": f"""
        SELECT {_STEP}, batch_size, globalTid, start AS host_start, "end" AS host_end,
               duration AS host_duration FROM step_inference_range""",
    "power_peak": """
        SELECT run_id, count(peak) AS gpus,
               sum(peak::DECIMAL(18, 6))::DOUBLE AS peak_watts
        FROM (SELECT run_id, gpu_uuid, max(watts) AS peak FROM power GROUP BY run_id, gpu_uuid)
        GROUP BY run_id""",
    "worker_stats": _worker_stats(),
    "system_stats": _system_stats(),
    "synth_raw": """
        SELECT o_orderkey AS sample_id, stream, j
        FROM orders, (SELECT unnest(range(0, 4)) AS stream), (SELECT unnest(range(0, 15)) AS j)
        WHERE stream > 0 OR j < 4""",
}

# The hash of the synthetic features: three rounds of three steps on 64 bits,
# as products of 128 bits without their upper half.
_BITS = "18446744073709551615::UHUGEINT"
_previous = "synth_raw"
for _round, _value in enumerate(
    ["sample_id::UHUGEINT + 8867", "h + stream::UHUGEINT * 1000003", "h + j::UHUGEINT * 10007"]
):
    _CTES[f"synth_{_round}a"] = (
        f"SELECT sample_id, stream, j, ({_value}) & {_BITS} AS h FROM {_previous}"
    )
    _CTES[f"synth_{_round}b"] = (
        f"SELECT sample_id, stream, j, (xor(h, h >> 30) * 13787848793156543929::UHUGEINT) & {_BITS}"
        f" AS h FROM synth_{_round}a"
    )
    _CTES[f"synth_{_round}c"] = (
        f"SELECT sample_id, stream, j, (xor(h, h >> 27) * 10723151780598845931::UHUGEINT) & {_BITS}"
        f" AS h FROM synth_{_round}b"
    )
    _CTES[f"synth_{_round}d"] = (
        f"SELECT sample_id, stream, j, xor(h, h >> 31) AS h FROM synth_{_round}c"
    )
    _previous = f"synth_{_round}d"
_SIZE = "CASE stream " + " ".join(
    f"WHEN {t + 1} THEN {size - 1}" for t, size in enumerate(TABLE_SIZES)
) + " END"
_CTES |= {
    "synth": f"SELECT sample_id, stream, j, (h >> 11)::DOUBLE / 9007199254740992.0::DOUBLE AS u FROM {_previous}",
    "synth_bags": f"""
        SELECT sample_id, stream - 1 AS table_id,
               list_sort(list_distinct(list(round_even(u * {_SIZE}, 0)::BIGINT)))[1:5] AS ids
        FROM synth WHERE stream > 0 GROUP BY sample_id, stream""",
    "bag_ids": """
        SELECT l_orderkey AS sample_id, 0 AS table_id, l_partkey AS idx FROM lineitem
        UNION ALL SELECT l_orderkey, 1, l_suppkey FROM lineitem""",
    "numbers": """
        SELECT vec_id AS idx, dim, floor(embedding[dim + 1]::DOUBLE * 1000)::BIGINT AS x
        FROM embeddings, (SELECT unnest(range(0, 64)) AS dim)""",
    "pooled_long": """
        SELECT b.sample_id, b.table_id, n.dim,
               sum(CASE b.table_id WHEN 0 THEN x ELSE -x END)::BIGINT AS x
        FROM bag_ids b JOIN numbers n USING (idx) GROUP BY b.sample_id, b.table_id, n.dim""",
    "dense": """
        SELECT o_orderkey AS sample_id,
               [o_custkey % 10, (floor(o_totalprice)::BIGINT) % 10, day(o_orderdate)::BIGINT,
                month(o_orderdate)::BIGINT] AS x FROM orders""",
}


def _layer(source: str, outputs: int, inputs: int) -> str:
    """A dense layer over lists: weights and biases by the rule of the queries."""
    def value(o: int) -> str:
        terms = [f"x[{i + 1}] * {(o * 7 + i * 3) % 5 - 2}" for i in range(inputs)]
        terms = [t for t in terms if not t.endswith(" * 0")]
        return f"greatest({' + '.join(terms)} + {o % 3 - 1}, 0)"

    rows = ", ".join(value(o) for o in range(outputs))
    return f"SELECT sample_id, [{rows}] AS x FROM {source}"


_CTES |= {
    "mlp1": _layer("dense", 8, 4),
    "mlp2": _layer("mlp1", 3, 8),
    "bottom": _layer("mlp1", WIDTH, 8),
    "pooled_lists": """
        SELECT sample_id, table_id, list(x ORDER BY dim) AS x FROM pooled_long
        GROUP BY sample_id, table_id""",
    "vectors": f"""
        SELECT b.sample_id, b.x AS v0,
               coalesce(p.x, list_transform(range(0, {WIDTH}), lambda i: 0::BIGINT)) AS v1,
               coalesce(q.x, list_transform(range(0, {WIDTH}), lambda i: 0::BIGINT)) AS v2
        FROM bottom b
        LEFT JOIN (SELECT * FROM pooled_lists WHERE table_id = 0) p USING (sample_id)
        LEFT JOIN (SELECT * FROM pooled_lists WHERE table_id = 1) q USING (sample_id)""",
    "top_input": """
        SELECT sample_id, list_concat(v0, [
            list_sum(list_transform(list_zip(v1, v0), lambda z: z[1] * z[2]))::BIGINT,
            list_sum(list_transform(list_zip(v2, v0), lambda z: z[1] * z[2]))::BIGINT,
            list_sum(list_transform(list_zip(v2, v1), lambda z: z[1] * z[2]))::BIGINT]) AS x
        FROM vectors""",
    "top1": _layer("top_input", 4, WIDTH + 3),
    "top2": _layer("top1", 1, 4),
    "last_day": "SELECT max(ts::DATE) AS d FROM events",
}
_MATERIALIZED = {"decoded", "step_j", "sized_spans", "named_runtime", "worker_stats", "mlp1"}
_MATERIALIZED |= {n for n in _CTES if n.startswith(("step_", "synth_")) and n != "step_range"}

_WORD = re.compile(r"\w+")


def _with(query: str) -> str:
    """The query behind the definitions it needs, directly or through others."""
    needed: set[str] = set()
    pending = [query]
    while pending:
        for word in set(_WORD.findall(pending.pop())):
            if word in _CTES and word not in needed:
                needed.add(word)
                pending.append(_CTES[word])
    parts = [
        f"{name} AS {'MATERIALIZED ' if name in _MATERIALIZED else ''}({sql})"
        for name, sql in _CTES.items()
        if name in needed
    ]
    return f"WITH {', '.join(parts)} {query}" if parts else query


def _rounded(*names: str) -> str:
    return ", ".join(f"round({n})::BIGINT AS {n}" for n in names)


def _shares(scenario: str, parts: dict[str, str]) -> str:
    return ", ".join(f"{scenario}_{n}_percentage" for n in parts)


def _named(*events: str) -> str:
    names = ", ".join(f"'{e}'" for e in events)
    return f"FROM decoded WHERE eventType = 59 AND event_name IN ({names})"


_IPS = "ips, ideal_ips, ideal_ips_without_wait, ideal_ips_without_wait_and_io"
_LAST = "WHERE step_id = (SELECT max(step_id) FROM step_inference_stats)"


def _queries() -> dict[str, str]:
    result = {
        "scan_spans": "SELECT * FROM spans",
        "power_long": "SELECT * FROM power",
        "run_inventory": """
            SELECT coalesce(t.run_id, p.run_id) AS run_id, t.run_id IS NOT NULL AS has_trace,
                   p.run_id IS NOT NULL AS has_power,
                   t.run_id IS NOT NULL AND p.run_id IS NOT NULL AS complete
            FROM (SELECT DISTINCT run_id FROM spans) t
            FULL JOIN (SELECT DISTINCT run_id FROM power) p ON t.run_id = p.run_id""",
        "json_extract_props": "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events",
        "decode_spans": "SELECT * EXCLUDE (event, j) FROM decoded",
        "decode_tensors": f"""
            SELECT run_id, globalTid, start, event_name,
                   json_extract_string(j, '$.tensor[1]') AS dtype,
                   replace(json_extract(j, '$.tensor[0]')::VARCHAR, ' ', '') AS shape,
                   json_array_length(j, '$.weights')::INTEGER AS weights,
                   json_array_length(j, '$.send_tensors')::INTEGER AS send_tensors,
                   json_array_length(j, '$.recv_tensors')::INTEGER AS recv_tensors
            {_named("input", "output", "compute", "communication")}""",
        "event_type_names": """
            SELECT run_id, eventType, CASE eventType WHEN 34 THEN 'NvtxMark'
                     WHEN 59 THEN 'NvtxPushPopRange' END AS type_name, count(*) AS spans
            FROM spans GROUP BY run_id, eventType""",
        "string_lookup": "SELECT run_id, globalTid, start, correlationId, function_name"
        " FROM named_runtime",
        "tensor_bytes": f"SELECT run_id, globalTid, start, event_name, {_tensor('$.tensor')} AS bytes"
        f" {_named('input', 'output')}",
        "tensors_bytes": f"""
            SELECT run_id, globalTid, start, event_name, {_tensors('$.weights')} AS weights,
                   {_tensors('$.send_tensors')} AS send_bytes,
                   {_tensors('$.recv_tensors')} AS recv_bytes
            {_named("compute", "communication")}""",
        "unpack_ids": "SELECT run_id, globalTid, start, eventType, pid, tid FROM decoded",
        "copy_throughput": """
            SELECT run_id, correlationId, bytes, "end" - start AS duration,
                   bytes::DOUBLE / nullif(("end" - start) * 1e-9::DOUBLE, 0) AS throughput
            FROM copies""",
        "api_like": """
            SELECT run_id, function_name, count(*) AS calls FROM named_runtime
            WHERE function_name ILIKE '%memcpy%' GROUP BY run_id, function_name""",
        "power_peak": "SELECT * FROM power_peak",
        "worker_stats": "SELECT * REPLACE ("
        f"{_rounded('input_throughput', 'output_throughput')}) FROM worker_stats",
        "worker_server_pct": f"SELECT {_STEP}, {_shares('server', _PARTS)} FROM worker_stats",
        "worker_offline_pct": f"SELECT {_STEP}, {_shares('offline', _OFFLINE)} FROM worker_stats",
        "system_stats": "SELECT * FROM system_stats",
        "system_server_pct": f"SELECT run_id, step_id, batch_size, {_shares('server', _PARTS)}"
        " FROM system_stats",
        "system_offline_pct": f"SELECT run_id, step_id, batch_size, {_shares('offline', _PARTS)}"
        " FROM system_stats",
        "system_ips": f"SELECT run_id, step_id, batch_size, {_IPS} FROM system_stats",
        "system_ipw": "SELECT run_id, step_id, batch_size, ipw FROM system_stats",
        "quality_checks": _quality_checks(),
        "decode_quality": """
            SELECT run_id, s.spans, s.unknown_event_type, s.empty_text, s.malformed_text,
                   s.unknown_tensor_size, s.unusable_ids, s.open_spans, s.reversed_spans, c.calls, c.unknown_name,
                   c.reversed_calls
            FROM (SELECT run_id, count(*) AS spans,
                    count(*) FILTER (eventType NOT IN (33, 34, 39, 59, 60, 75, 76))
                      AS unknown_event_type,
                    count(*) FILTER (eventType = 59 AND coalesce(event, '') = '') AS empty_text,
                    count(*) FILTER (eventType = 59 AND event != '' AND j IS NULL)
                      AS malformed_text,
                    count(*) FILTER (eventType = 59 AND (
                      event_name IN ('input', 'output') AND {tensor} IS NULL
                      OR event_name = 'compute' AND {weights} IS NULL
                      OR event_name = 'communication' AND ({send} IS NULL OR {recv} IS NULL)))
                      AS unknown_tensor_size,
                    count(*) FILTER (eventType = 59 AND event_name = 'inference'
                      AND (step_id IS NULL OR rank IS NULL OR local_rank IS NULL
                           OR batch_size IS NULL)) AS unusable_ids,
                    count(*) FILTER ("end" IS NULL) AS open_spans,
                    count(*) FILTER ("end" < start) AS reversed_spans
                  FROM decoded GROUP BY run_id) s
            FULL JOIN (SELECT run_id, count(*) AS calls,
                    count(*) FILTER (function_name IS NULL) AS unknown_name,
                    count(*) FILTER ("end" < start) AS reversed_calls
                  FROM named_runtime GROUP BY run_id) c USING (run_id)""".format(
            tensor=_tensor("$.tensor"), weights=_tensors("$.weights"),
            send=_tensors("$.send_tensors"), recv=_tensors("$.recv_tensors"),
        ),
        "last_step": f"SELECT * FROM step_inference_stats {_LAST}",
        "report_log2": f"SELECT batch_size, {_IPS}, log2(batch_size) AS log2_batch_size"
        f" FROM system_stats {_LAST}",
        "synth_features": """
            SELECT s.sample_id, s.dense, b.ids0, b.ids1, b.ids2
            FROM (SELECT sample_id, string_agg(floor(u * 1000000)::BIGINT::VARCHAR, ',' ORDER BY j)
                    AS dense FROM synth WHERE stream = 0 GROUP BY sample_id) s
            JOIN (SELECT sample_id,
                    max(array_to_string(ids, ',')) FILTER (table_id = 0) AS ids0,
                    max(array_to_string(ids, ',')) FILTER (table_id = 1) AS ids1,
                    max(array_to_string(ids, ',')) FILTER (table_id = 2) AS ids2
                  FROM synth_bags GROUP BY sample_id) b USING (sample_id)""",
        "flatten_bags": """
            SELECT sample_id, table_id::INTEGER AS table_id, (pos - 1)::INTEGER AS pos,
                   ids[pos] AS idx
            FROM (SELECT *, unnest(range(1, len(ids) + 1)) AS pos FROM synth_bags)""",
        "bag_offsets": """
            SELECT table_id::INTEGER AS table_id, sample_id, size,
                   (sum(size) OVER (PARTITION BY table_id ORDER BY sample_id) - size)::BIGINT
                     AS "offset"
            FROM (SELECT table_id, sample_id, count(*) AS size FROM bag_ids
                  GROUP BY table_id, sample_id)""",
        "embedding_bag_sum": """
            SELECT b.sample_id, b.table_id, b.missing,
                   coalesce(p.pooled, array_to_string(list_transform(range(0, 64), lambda i: 0), ','))
                     AS pooled
            FROM (SELECT sample_id, table_id,
                         count(*) FILTER (idx NOT IN (SELECT vec_id FROM embeddings)) AS missing
                  FROM bag_ids GROUP BY sample_id, table_id) b
            LEFT JOIN (SELECT sample_id, table_id, string_agg(x::VARCHAR, ',' ORDER BY dim) AS pooled
                       FROM pooled_long GROUP BY sample_id, table_id) p
            USING (sample_id, table_id)""",
        "pairwise_dot": """
            SELECT a.idx // 4 AS sample_id,
                   ((a.idx % 4) * (a.idx % 4 - 1) // 2 + b.idx % 4)::INTEGER AS pair,
                   sum(a.x * b.x)::BIGINT AS dot
            FROM numbers a JOIN numbers b
              ON a.idx // 4 = b.idx // 4 AND a.dim = b.dim AND a.idx > b.idx
            GROUP BY a.idx, b.idx""",
        "score_mlp": "SELECT sample_id, x[1]::BIGINT AS s0, x[2]::BIGINT AS s1,"
        " x[3]::BIGINT AS s2 FROM mlp2",
        "score_model": "SELECT sample_id, x[1]::BIGINT AS score FROM top2",
        "temporal_split": """
            SELECT event_id, user_id, CASE WHEN n IS NULL THEN 'train'
                     WHEN row_no * 2 <= n THEN 'val' ELSE 'test' END AS stage
            FROM events LEFT JOIN (
              SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS row_no,
                     count(*) OVER () AS n
              FROM events, last_day WHERE ts::DATE = d) USING (event_id)""",
        "hash_ids": "SELECT l_orderkey, l_linenumber, l_partkey % 97 AS l_partkey,"
        " l_suppkey % 13 AS l_suppkey FROM lineitem",
    }
    short = {view: query for query, view in _VIEW_QUERIES.items()}
    for name in _CTES:
        if name.startswith("step_") and name != "step_j":
            select = f"SELECT * FROM {name}"
            if name.startswith(("step_input_", "step_output_")) and name.endswith("_stats"):
                if "host" not in name:
                    select = f"SELECT * REPLACE ({_rounded('throughput')}) FROM {name}"
            result[short.get(name, name)] = select

    def sums(parts):
        return ", ".join(f"{c}_sum" for c in parts.values())

    def columns(*names):
        return ", ".join(names)

    weights = columns(*[f"{layer}_weights" for layer in _LAYERS])
    latency = columns(
        "host_duration", "device_duration", "device_duration_without_wait",
        "device_duration_without_wait_and_io",
    )
    io = f"""input_device_duration, input_device_bytes, {_rounded("input_throughput")},
        output_device_duration, output_device_bytes, {_rounded("output_throughput")}"""
    selected = {
        "report_system_ips": _IPS,
        "report_system_ipw": "ipw",
        "report_system_latency": latency,
        "report_system_io": "input_bytes, output_bytes",
        "report_system_io_throughput": "input_throughput, output_throughput",
        "report_system_comm_bytes": "send_bytes, recv_bytes",
        "report_system_comm_throughput": "communication_throughput",
        "report_system_weights": weights,
        "report_system_layer_latency": sums(_PARTS),
        "report_system_layer_latency_no_io": sums(_OFFLINE),
        "report_system_layer_pct": _shares("server", _PARTS),
        "report_system_layer_pct_no_io": _shares("offline", _OFFLINE),
        "report_worker_latency": latency,
        "report_worker_io": io,
        "report_worker_comm": "communication_send_bytes, communication_recv_bytes,"
        " communication_throughput",
        "report_worker_layer_latency": columns(
            "communication_wait_device_duration", *_PARTS.values()
        ),
        "report_worker_server_pct": _shares("server", _PARTS),
        "report_worker_offline_pct": _shares("offline", _OFFLINE),
    }
    assert selected.keys() == _REPORT_QUERIES.keys()
    for name, wanted in selected.items():
        if name.startswith("report_worker"):
            result[name] = f"SELECT batch_size, rank, local_rank, {wanted} FROM worker_stats {_LAST}"
        else:
            result[name] = f"SELECT batch_size, {wanted} FROM system_stats {_LAST}"
    return result


def all_oracles() -> dict[str, str]:
    return {name: _with(query) for name, query in _queries().items()}
