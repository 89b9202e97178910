"""Workflows: tasks whose inputs name other tasks' outputs, run as a job graph. Values may be
anything, DataFrames too."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from ..errors import AlreadyExistsError, GraphError, NotExistsError
from .jobs import JobGraph, State


@dataclass
class Parameter:
    """A value, or a reference ``task.output.name`` / ``task.input.name``."""

    name: str
    value: object = None
    ref: str | None = None


class Task:
    """A function from a dict of inputs to a dict of outputs."""

    def __init__(self, name: str, run: Callable[[dict], dict | None]):
        self.name, self.function = name, run
        self.inputs: dict = {}
        self.outputs: dict = {}

    def run(self) -> None:
        self.outputs = dict(self.function(self.inputs) or {})


def _cron_values(text: str, low: int, high: int) -> set[int]:
    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        first, _, last = ("%d-%d" % (low, high) if span == "*" else span).partition("-")
        last = last or (str(high) if step else first)
        if not low <= int(first) <= int(last) <= high:
            raise ValueError(f"{part!r} is outside {low} to {high}")
        out.update(range(int(first), int(last) + 1, int(step or 1)))
    return out


@dataclass
class Workflow:
    name: str = ""
    schedule: str = ""  # five cron fields; see ``due``
    spark: SparkSession | None = None
    tasks: dict[str, Task] = field(default_factory=dict)
    after: dict[str, set] = field(default_factory=dict)
    inputs: dict[str, list[Parameter]] = field(default_factory=dict)
    declared: dict[str, list[Parameter]] = field(default_factory=dict)
    _jobs: JobGraph | None = None

    def due(self, after: datetime, n: int = 1) -> list[datetime]:
        """The next n times of the schedule after a moment: minute, hour, day, month, weekday (0 is Sunday),
        each a list of numbers, ranges and steps; a day fits where either day field that is set does. What
        starts the workflow then is the caller's scheduler."""
        fields = self.schedule.split()
        if len(fields) != 5:
            raise ValueError(f"a schedule of five fields is asked for: {self.schedule!r}")
        minute, hour, day, month, weekday = (_cron_values(f, low, high) for f, (low, high) in zip(fields, ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7)), strict=True))
        weekday = {x % 7 for x in weekday}
        at, out = after.replace(second=0, microsecond=0) + timedelta(minutes=1), []
        end = after + timedelta(days=366 * 8)
        while len(out) < n and at < end:
            fits = [x for x, f in ((at.day in day, fields[2]), (at.isoweekday() % 7 in weekday, fields[4])) if f != "*"]
            if at.month not in month or (fits and not any(fits)):
                at = at.replace(hour=0, minute=0) + timedelta(days=1)
            elif at.hour not in hour:
                at = at.replace(minute=0) + timedelta(hours=1)
            else:
                if at.minute in minute:
                    out.append(at)
                at += timedelta(minutes=1)
        return out

    def add_task(self, *tasks: Task) -> None:
        for t in tasks:
            if t.name in self.tasks:
                raise AlreadyExistsError(f"task {t.name!r}")
            self.tasks[t.name], self.after[t.name] = t, set()

    def remove_task(self, *names: str) -> None:
        for name in names:
            self._task(name)
            del self.tasks[name], self.after[name]
            self.inputs.pop(name, None), self.declared.pop(name, None)
            for others in self.after.values():
                others.discard(name)

    def _task(self, name: str) -> Task:
        if name not in self.tasks:
            raise NotExistsError(f"task {name!r}")
        return self.tasks[name]

    def add_dependency(self, first: str, then: str) -> None:
        self._task(first), self._task(then)
        self.after[then].add(first)

    def remove_dependency(self, first: str, then: str) -> None:
        if first not in self.after.get(then, ()):
            raise NotExistsError(f"{first!r} before {then!r}")
        self.after[then].discard(first)

    def set_input(self, task: str, *parameters: Parameter) -> None:
        self._task(task)
        self.inputs[task] = list(parameters)

    def set_output(self, task: str, *parameters: Parameter) -> None:
        self._task(task)
        self.declared[task] = list(parameters)

    def set_inputs(self, inputs: dict[str, list[Parameter]]) -> None:
        for task, parameters in inputs.items():
            self.set_input(task, *parameters)

    def set_outputs(self, outputs: dict[str, list[Parameter]]) -> None:
        for task, parameters in outputs.items():
            self.set_output(task, *parameters)

    def _resolve(self, p: Parameter):
        if p.ref is None:
            return p.value
        parts = p.ref.split(".")
        if len(parts) == 4 and parts[0] == self.name:
            parts = parts[1:]
        if len(parts) != 3 or parts[1] not in ("input", "output"):
            raise GraphError(f"reference {p.ref!r} is not task.output.name")
        task = self._task(parts[0])
        values = task.inputs if parts[1] == "input" else task.outputs
        if parts[2] not in values:
            raise NotExistsError(f"{p.ref!r}")
        return values[parts[2]]

    def _run(self, name: str) -> None:
        task = self.tasks[name]
        task.inputs = {p.name: self._resolve(p) for p in self.inputs.get(name, [])}
        task.run()
        if missing := [p.name for p in self.declared.get(name, []) if p.name not in task.outputs]:
            raise NotExistsError(f"outputs {missing} of task {name!r}")

    def start(self) -> None:
        jobs = JobGraph(self.name, self.spark)
        for name in self.tasks:
            jobs.add_job(name, lambda name=name: self._run(name))
        for then, firsts in self.after.items():
            for first in firsts:
                jobs.add_dependency(first, then)
        jobs.start()
        self._jobs = jobs

    def stop(self) -> None:
        if self._jobs is not None:
            self._jobs.stop()

    def wait(self, timeout: float | None = None) -> None:
        if self._jobs is not None:
            self._jobs.wait(timeout)

    @property
    def status(self) -> State:
        return self._jobs.status if self._jobs is not None else State.WAITING

    def info(self, spark: SparkSession | None = None) -> DataFrame:
        """One row for each task, as in :meth:`JobGraph.table`."""
        jobs = self._jobs or JobGraph(self.name, self.spark)
        return jobs.table(spark or self.spark)

    def output(self, task: str) -> dict:
        return dict(self._task(task).outputs)
