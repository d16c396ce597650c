"""Stages over DataFrames with a trace: what each did, in order, and where it stopped."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class State:
    """Named tables, what was noted of each stage, and why the run abstained, if it did."""

    tables: dict[str, DataFrame]
    trace: tuple[tuple[str, str], ...] = field(default_factory=tuple)
    abstained: str | None = None

    def put(self, stage: str, note: str, **tables: DataFrame) -> State:
        return State({**self.tables, **tables}, (*self.trace, (stage, note)), self.abstained)

    def stop(self, stage: str, why: str) -> State:
        return State(self.tables, (*self.trace, (stage, why)), why)


def run(state: State, stages: list[tuple[str, Callable[[State], State]]]) -> State:
    """The stages in order, until one abstains."""
    for name, stage in stages:
        if state.abstained:
            break
        after = stage(state)
        state = after if len(after.trace) > len(state.trace) else after.put(name, "done")
    return state
