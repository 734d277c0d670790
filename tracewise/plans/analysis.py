"""All statistics of a set of traces, sharing what they have in common."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewise.functions.scalars import duration, per_second, process_id, thread_id
from tracewise.functions.sql import register_functions
from tracewise.operators.lookup import last_step
from tracewise.plans import calls, quality, reports, spans, stats, system, worker
from tracewise.schemas import EVENT_CALLS, STEP_KEYS, TraceTables
from tracewise.session import Staging
from tracewise.sources.layout import BUCKET_SETTING

_VIEWS = [
    "step_inference_range", "step_range",
    "step_input_range", "step_output_range", "step_compute_range", "step_communication_range",
    "step_input_runtime", "step_compute_runtime", "step_communication_runtime",
    "step_output_runtime",
    "step_input_kernel", "step_communication_kernel", "step_communication_transfer_kernel_start",
    "step_communication_wait_kernel", "step_communication_transfer_kernel",
    "step_compute_kernel", "step_output_kernel",
    "step_input_host_stats", "step_output_host_stats", "step_communication_host_stats",
    "step_compute_host_stats",
    "step_input_device_stats", "step_compute_device_stats",
    "step_communication_wait_device_stats", "step_communication_transfer_device_stats",
    "step_output_device_stats",
    "step_input_stats", "step_compute_stats", "step_communication_wait_stats",
    "step_communication_transfer_stats", "step_output_stats", "step_inference_stats",
]


# Calls and steps of a task, which sorts them, the spans around them and both together.
_ROWS_PER_TASK = 500_000


class TraceAnalysis:
    """Statistics of the given tables.

    With ``staging``, the results of the three large joins and the worker table
    are written once and read by everything after them. Without, each result is
    one lazy plan.

    That pays where many results are wanted. With ``share=False`` each result is
    made for itself: a view of one event reads, joins and writes the rows of that
    event only, a report those of the last step, and only what a plan reads more
    than once is written. ``events`` leaves out the spans and device work of others,
    and ``sized=False`` the bytes of spans, whose JSON takes long to read.
    """

    def __init__(
        self,
        tables: TraceTables,
        staging: Staging | None = None,
        share: bool = True,
        events: Sequence[str] = tuple(EVENT_CALLS),
        sized: bool = True,
    ):
        self.tables = tables
        self.staging = staging
        self.share = share or not staging
        self.events = tuple(events)
        self.sized = sized
        # Sizes of plans are guessed; these joins have all steps on one side.
        self.large = not self.share
        self.parent: TraceAnalysis | None = None

    def _shared(self, name: str, df: DataFrame) -> DataFrame:
        if not self.staging:
            return df
        if self.tables.buckets and "pid" in df.columns:
            return self.staging.bucketed(name, df, self.tables.buckets)
        return self.staging.table(name, df, tidy=True)

    @property
    def _bounded(self) -> bool:
        """Whether the rows of a process are in one bucket, of a size that the layout has checked."""
        return bool(self.tables.buckets)

    def _narrowed(
        self, events: Sequence[str] | None = None, inference: DataFrame | None = None, share: bool = False,
        sized: bool = True,
    ) -> TraceAnalysis:
        """The same analysis of some events, or of the given steps."""
        found = TraceAnalysis(self.tables, self.staging, share, events or self.events, sized)
        found.inference = self.inference if inference is None else inference
        found.large = inference is None
        found.parent = self
        return found

    # Shared results.

    @cached_property
    def inference(self) -> DataFrame:
        return self._shared("inference", spans.step_inference_range(self.tables.spans))

    @cached_property
    def step_spans(self) -> DataFrame:
        if self.share and len(self.events) == len(EVENT_CALLS):
            return self._shared("step_spans", spans.step_spans(self.tables.spans, self.inference, self._bounded))
        found = spans.step_spans(self.tables.spans, self.inference, self._bounded, self.events, self.large)
        # what follows from other columns is not written; rows in buckets keep what places them
        derived = {"tid": thread_id("globalTid"), "duration": duration()}
        if not self._bounded:
            derived["pid"] = process_id("globalTid")
        unread = [] if self.sized else ["bytes", "send_bytes", "recv_bytes"]
        return self._shared("step_spans", found.drop(*derived, *unread)).withColumns(derived)

    @cached_property
    def call_names(self) -> DataFrame:
        """Written, as Spark would else guess their size, and may take the calls for the smaller side."""
        if self.parent:
            return self.parent.call_names
        return self._shared("call_names", calls.call_names(self.tables.string_ids))

    @cached_property
    def step_calls(self) -> DataFrame:
        t = self.tables
        found = calls.step_runtime(
            self.step_spans, t.runtime, t.string_ids, self._bounded, self.events, self.large, self.call_names
        )
        return self._shared("step_calls", found) if self.share else found

    @cached_property
    def step_device(self) -> DataFrame:
        t = self.tables
        found = calls.step_device(self.step_calls, t.kernels, t.copies, self._bounded, self.events, self.large)
        return self._shared("step_device", found) if self.share else found

    @cached_property
    def timed_device(self) -> DataFrame:
        """Device work with what statistics need of it, to be read more than once."""
        if self.share:
            return self.step_device
        work = self.step_device.select(*STEP_KEYS, "globalTid", *calls.EVENT, "start", "end", "bytes")
        if "communication" in self.events:  # else nothing reads it twice
            work = self._shared("timed_device", work)
        return work.withColumns(
            {"duration": duration(), "throughput": per_second(F.col("bytes"), duration())}
        )

    @cached_property
    def host_stats(self) -> DataFrame:
        return stats.host_stats(self.step_spans)

    @cached_property
    def device_stats(self) -> DataFrame:
        return stats.device_stats(self.timed_device)

    @cached_property
    def timed_calls(self) -> DataFrame:
        """Device work with the times of its calls, wherever they are.

        Written, so that what was shuffled for it can go before the rest is shuffled.
        """
        t = self.tables
        found = calls.timed_calls(t.runtime, self.call_names, t.kernels, t.copies)
        return self._shared("timed_device", found)

    @cached_property
    def layer_parts(self) -> DataFrame:
        """Spans and device work of all events for one result, added up by layer where they are joined."""
        t = self.tables
        # these joins, and that with the inference steps, have more keys than rows are placed by
        t.spans.sparkSession.conf.set(BUCKET_SETTING, "false")
        decoded = spans.sized_spans(t.spans, ["run_id", "globalTid"], self.events)
        found = spans.sizes(t.spans, self.events)
        return stats.layer_parts(decoded, self.inference, found, self.timed_calls, self._tasks)

    @cached_property
    def _tasks(self) -> int | None:
        """Tasks for the joins of all steps: more than the session has where the rows of one would spill."""
        rows = self.timed_calls.count() + self.inference.count()  # of written tables, read from their ends
        needed = math.ceil(rows / _ROWS_PER_TASK)
        session = int(self.tables.spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return needed if needed > session else None

    @cached_property
    def layer_stats(self) -> DataFrame:
        if not self.share and not self._bounded and len(self.events) == len(EVENT_CALLS):
            return stats.layers_of_parts(self.layer_parts, self._tasks)
        return stats.layer_stats(self.step_spans, self.timed_device, self.events)

    @cached_property
    def worker_stats(self) -> DataFrame:
        found = worker.worker_stats(stats.step_inference_stats(self.inference), self.layer_stats)
        # a single result reads them once
        return self._shared("worker_stats", found) if self.share else found

    @cached_property
    def system_stats(self) -> DataFrame:
        return system.system_stats(self.worker_stats, self.tables.power)

    # Results by name.

    def view(self, name: str) -> DataFrame:
        """One of the per-step views; their names are in ``view_names``."""
        if name not in _VIEWS:
            raise KeyError(name)
        if name == "step_inference_range":
            return self.inference
        if name == "step_inference_stats":
            return stats.step_inference_stats(self.inference)
        if name == "step_range":
            return spans.step_range(self.tables.spans, self.inference, self._bounded, self.large)
        if name.endswith("_range"):
            return getattr(spans, name)(self.view("step_range"))
        event = name.split("_")[1]
        if not self.share and self.events != (event,):
            # calls and device work take only names and times from the spans
            unsized = name.endswith(("_runtime", "_kernel", "_kernel_start", "_device_stats"))
            return self._of_event(event, not unsized).view(name)
        if name.endswith("_runtime"):
            return calls.runtime_of(self.step_calls, event)
        if name == "step_communication_transfer_kernel_start":
            return calls.transfer_start(self.view("step_communication_kernel"))
        if name in ("step_communication_wait_kernel", "step_communication_transfer_kernel"):
            return getattr(calls, name)(self.view("step_communication_kernel"))
        if name == "step_communication_kernel":
            return calls.step_communication_kernel(self.timed_device)
        if name.endswith("_kernel"):
            return getattr(calls, name)(self.step_device)
        if name.endswith("_host_stats"):
            return getattr(stats, name)(self.host_stats)
        if name.startswith("step_communication") and name.endswith("_device_stats"):
            return getattr(stats, name)(stats.communication_device_stats(self.timed_device))
        if name.endswith("_device_stats"):
            return getattr(stats, name)(self.device_stats)
        return getattr(stats, name)(self.layer_stats)

    def _of_event(self, event: str, sized: bool = True) -> TraceAnalysis:
        if (event, True) in self._of_events:
            sized = True
        if (event, sized) not in self._of_events:
            self._of_events[event, sized] = self._narrowed([event], sized=sized)
        return self._of_events[event, sized]

    @cached_property
    def _of_events(self) -> dict[tuple[str, bool], TraceAnalysis]:
        return {}

    @staticmethod
    def view_names() -> list[str]:
        return list(_VIEWS)

    def create_views(self) -> None:
        """Make every view, the two statistics and the scalar functions available to SQL by name."""
        register_functions(self.tables.spans.sparkSession, self.tables.string_ids)
        self.tables.runtime.createOrReplaceTempView("runtime")
        for name in _VIEWS:
            self.view(name).createOrReplaceTempView(name)
        self.worker_stats.createOrReplaceTempView("worker_stats")
        self.system_stats.createOrReplaceTempView("system_stats")

    def quality_checks(self) -> DataFrame:
        a = self if self.share else self._narrowed(quality.EVENTS, share=True)
        return quality.quality_checks(self.tables.spans, a.step_spans, a.step_calls, a.step_device)

    def decode_quality(self) -> DataFrame:
        t = self.tables
        return quality.decode_quality(t.spans, t.runtime, t.string_ids)

    @cached_property
    def _last(self) -> dict[bool, TraceAnalysis]:
        return {}

    def last_step(self, level: str, per_run: bool = False) -> DataFrame:
        """System or worker statistics of the last step."""
        if not self.share:
            # nothing of other steps counts there; what is found in one step is small, so all is written
            if per_run not in self._last:
                steps = self._shared("last_step", last_step(self.inference, per_run=per_run))
                self._last[per_run] = self._narrowed(inference=steps, share=True)
            a = self._last[per_run]
            return a.system_stats if level == "system" else a.worker_stats
        # Every step has an inference row, so the maximum is read from there.
        rows = self.system_stats if level == "system" else self.worker_stats
        return last_step(rows, self.inference, per_run)

    def report(self, name: str, per_run: bool = False) -> DataFrame:
        level = reports.REPORTS[name].level
        return reports.report_table(name, self.last_step(level, per_run))
