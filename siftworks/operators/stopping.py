"""Early stopping as a state machine over probes and full validations, folded over rows in order."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .state import fold_in_order

# Fixed values of the rules.
PATIENCE, MIN_DELTA, MAX_EPOCHS = 4, 0.005, 3
SYNTAX_DROP, TIMEOUT_RATE = 0.05, 0.08


@dataclass
class Stopping:
    """What is known after the events so far. snapshot() and restore() carry it on, without the histories of values.

    Rules that stop at once: a value that is no number, a bucket that is missing, over TIMEOUT_RATE timeouts, a syntax rate SYNTAX_DROP
    below the last one measured. An event without a syntax or timeout rate measures nothing and leaves the last rate as it is; with a timeout
    rate alone its syntax rate counts as 1. PATIENCE probes in a row without a gain of MIN_DELTA only make a stop pending; the next full
    validation confirms it or, by a gain of its own, lifts it. MAX_EPOCHS confirm a stop too.
    """

    best_probe: float | None = None
    best_full: float | None = None
    last_full: float | None = None
    idle: int = 0
    syntax: float | None = None
    pending: bool = False
    stopped: bool = False
    reason: str = ""

    def snapshot(self) -> dict:
        return asdict(self) | {"last_full": None}

    @classmethod
    def restore(cls, state: dict) -> Stopping:
        return cls(**state)

    def _stop(self, reason: str) -> bool:
        self.stopped, self.reason = True, reason
        return True

    def _at_once(self, value: float | None, syntax: float | None, timeout: float | None) -> bool:
        if value is None:
            return self._stop("bucket_missing")
        if not math.isfinite(value):
            return self._stop("nan_or_inf")
        if syntax is None and timeout is None:
            return False
        if timeout is not None and timeout > TIMEOUT_RATE:
            return self._stop("timeout_rate")
        syntax = 1.0 if syntax is None else syntax
        if self.syntax is not None and self.syntax - syntax > SYNTAX_DROP:
            return self._stop("syntax_drop")
        self.syntax = syntax
        return False

    def probe(self, value: float | None, syntax: float | None = None, timeout: float | None = None) -> None:
        if self._at_once(value, syntax, timeout):
            return
        if self.best_probe is None or value > self.best_probe + MIN_DELTA:
            self.best_probe, self.idle = value, 0
        else:
            self.idle += 1
        if self.idle >= PATIENCE and not self.pending:
            self.pending, self.reason = True, "pending"

    def full(self, value: float | None, epoch: float, syntax: float | None = None, timeout: float | None = None) -> None:
        if self._at_once(value, syntax, timeout):
            return
        before, self.last_full = self.last_full, value
        self.best_full = value if self.best_full is None else max(self.best_full, value)
        if self.pending:
            against = before if before is not None else self.best_probe
            gain = against is not None and value > against + MIN_DELTA
            if gain:
                self.pending, self.reason = False, ""
            elif before is not None:
                self._stop("confirmed")
                return
        if epoch >= MAX_EPOCHS:
            self._stop("max_epochs")


def advance(machine: Stopping, kind: str, value: float | None, epoch: float | None, syntax: float | None, timeout: float | None) -> None:
    """Applies one event to a machine that has not stopped. kind is 'probe' or 'full'."""
    if kind == "full":
        machine.full(value, epoch, syntax, timeout)
    else:
        machine.probe(value, syntax, timeout)


FOLDED = "seen bigint, stopped_at bigint, reason string, pending boolean, best_probe double, best_full double"


def fold(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, seen, stopped_at, reason, pending, best_probe, best_full) from rows (key, order..., kind, value, epoch, syntax, timeout).

    After a confirmed stop later rows are only counted.
    """

    def step(state, kind, missing, *numbers):
        machine, seen, at = state
        value, epoch, syntax, timeout = (None if x is None else float(x) for x in numbers)
        if value is None and not missing:
            value = float("nan")  # pandas does not tell it from null
        if not machine.stopped:
            advance(machine, kind, value, epoch, syntax, timeout)
            at = seen + 1 if machine.stopped else None
        return machine, seen + 1, at

    finish = lambda s: (s[1], s[2], s[0].reason, s[0].pending, s[0].best_probe, s[0].best_full)
    return fold_in_order(rows.withColumn("_missing", F.col("value").isNull()), key, order, ["kind", "_missing", "value", "epoch", "syntax", "timeout"], lambda: (Stopping(), 0, None), step, finish, FOLDED)
