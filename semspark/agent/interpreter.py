"""Runs plans, and asks a model for new ones when a plan fails."""

from __future__ import annotations

import json
import logging
import re

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.semantic import finalize
from .expressions import FUNCTIONS, TABLE_FUNCTIONS
from .steps import STEPS, PlanError, normalised

log = logging.getLogger(__name__)

JSON_TRIES = 5


class AgentError(RuntimeError):
    pass


class StepFailed(PlanError):
    def __init__(self, at: int, step: object, why: Exception):
        super().__init__(f"step {at} failed: {str(why).splitlines()[0]}")
        self.at, self.step = at, step


class StepCounts:
    """Rows that each step of a plan gave, counted while its frame is executed, without a job of their own.

    Give one to ``run_plan`` or ``Agent.do``, run an action on the frame and call ``rows``. Filters are not moved across
    a counted step.
    """

    def __init__(self):
        self._steps: list[tuple[str, Observation]] = []

    def watch(self, name: str, df: DataFrame) -> DataFrame:
        seen = Observation()
        self._steps.append((name, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"))

    def rows(self) -> list[tuple[str, int]]:
        """(step, rows out), the input first. Waits for an action on the frame."""
        return [(name, seen.get["rows"]) for name, seen in self._steps]


def run_plan(plan, df: DataFrame, llm=None, frames: dict[str, DataFrame] | None = None, counts: StepCounts | None = None, verbose: bool = False) -> DataFrame:
    """The lazy frame that a plan makes of ``df``. Names and types are checked step by step, without running a job.

    frames: further frames by the names that steps may give. counts: has the rows of each step once the frame is
    executed. verbose: each step is logged with its parameters and the columns that it leaves.
    """
    steps = normalised(plan)
    if counts is not None:
        df = counts.watch("input", df)
    for k, (name, params) in enumerate(steps):
        step = STEPS[name]
        try:
            if step.semantic and llm is None:
                raise PlanError(f"{name} needs a model")
            extra = [llm] if step.semantic else [frames] if step.frames else []
            df = step.run(df, *extra, **params)
            df.schema  # noqa: B018  the analysis runs here
        except (PlanError, ValueError, TypeError, PySparkException) as error:
            raise StepFailed(k, {"operation": name, "params": params}, error) from error
        log.log(logging.WARNING if verbose else logging.INFO, "step %d: %s%s", k, name, f" {json.dumps(params, default=str)} -> {df.schema.simpleString()}" if verbose else "")
        if counts is not None:
            df = counts.watch(name, df)
    return finalize(df)


def planner_prompt(task: str, df: DataFrame, frames: dict[str, DataFrame] | None = None) -> str:
    listing = "\n".join(f"- {n}: params {', '.join([*s.required, *(f'{o} (optional)' for o in s.optional)])}" for n, s in STEPS.items())
    others = "".join(f"Frame {name}: {frame.schema.simpleString()}\n" for name, frame in (frames or {}).items())
    others += f"Registered functions: {', '.join(sorted(FUNCTIONS))}\n" if FUNCTIONS else ""
    others += f"Table functions: {', '.join(sorted(TABLE_FUNCTIONS))}\n" if TABLE_FUNCTIONS else ""
    return (
        "You plan dataframe work. Answer with a JSON list of steps and nothing else. A step is "
        '{"type": "dask" or "primitive", "operation": name, "params": {...}}; map and filter are primitive, all others dask.\n'
        "Expressions, conditions and functions are Spark SQL; in apply_function the argument is called x. Quote names that "
        "hold spaces or signs with backticks. Prefer plain steps; use map (new columns by meaning) and filter (rows by "
        "meaning) only where meaning is needed, in as few steps as can be.\n"
        f"Operations:\n{listing}\nColumns: {df.schema.simpleString()}\n{others}Task: {task}\n"
    )


def parse_plan(reply: str) -> list:
    text = re.sub(r"^\s*```[a-zA-Z]*\s*|\s*```\s*$", "", reply.strip())
    value = json.loads(text)
    if not isinstance(value, list):
        raise ValueError("the plan is not a list")
    return value


class Agent:
    """``Agent(llm).do(task, df)`` plans, runs and, on errors, plans again; it gives a lazy frame."""

    def __init__(self, llm):
        self.llm = llm

    def get_plan(self, prompt: str) -> list:
        for _ in range(JSON_TRIES):
            try:
                return parse_plan(self.llm(prompt))
            except ValueError:
                prompt += "\nAnswer with the JSON list only."
        raise ValueError(f"no valid plan in {JSON_TRIES} tries")

    def do(self, task: str, df: DataFrame, max_iterations: int = 5, frames: dict[str, DataFrame] | None = None, counts: StepCounts | None = None, verbose: bool = False) -> DataFrame:
        """Every plan starts from ``df``. After ``max_iterations`` failed plans AgentError tells the last error. frames,
        counts and verbose are those of ``run_plan``; with the latter plans are logged as they come."""
        base = prompt = planner_prompt(task, df, frames)
        last: Exception | None = None
        for _ in range(max_iterations):
            plan = self.get_plan(prompt)
            if verbose:
                log.warning("plan: %s", json.dumps(plan, default=str))
            try:
                own = StepCounts() if counts is not None else None
                made = run_plan(plan, df, self.llm, frames, own, verbose)
                if counts is not None:
                    counts._steps = own._steps
                return made
            except PlanError as error:
                last = error
                failed = f"\nFailed step: {json.dumps(error.step, default=str)}" if isinstance(error, StepFailed) else ""
                prompt = f"{base}\nThe plan {json.dumps(plan, default=str)} failed.\nError: {error}{failed}\nGive a corrected plan.\n"
        raise AgentError(f"no plan worked in {max_iterations} tries: {last}")
