"""Ordered correction steps over claims, with a choice of steps and a log."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dramaturg.operators import relations as R

Step = Callable[[DataFrame], DataFrame]


def correction_steps(events: DataFrame, breakup, reconciled, engaged, married, romantic) -> list[tuple[str, Step]]:
    """The corrections of relationships in their order; each takes claims and returns claims."""
    bare = lambda df: df.select(*R.KEY, "role")
    return [
        ("corroborate", lambda c: bare(R.corroborated(c, events, romantic))),
        ("unwarranted_ex", lambda c: bare(R.unwarranted_ex(c, events, breakup))),
        ("status_tiers", lambda c: bare(R.evidenced_tiers(c, events, engaged, married))),
        ("short_stays", lambda c: bare(R.without_short_stays(c))),
        ("reciprocity", lambda c: bare(R.propagated(c))),
        ("continuity", lambda c: bare(R.gap_filled(c))),
        ("auto_ex", lambda c: bare(R.auto_downgraded(c, events, breakup, reconciled))),
    ]


def chosen_steps(steps: list[tuple[str, Step]], only: list[str] | None = None, skip: list[str] | None = None) -> list[tuple[str, Step]]:
    unknown = {*(only or []), *(skip or [])} - {name for name, _ in steps}
    if unknown:
        raise ValueError(f"no steps named {sorted(unknown)}")
    return [(n, s) for n, s in steps if (only is None or n in only) and n not in (skip or [])]


def run_steps(rows: DataFrame, steps: list[tuple[str, Step]], fix: Callable[[DataFrame], DataFrame], only=None, skip=None, dry_run: bool = False) -> tuple[DataFrame, list[dict]]:
    """Apply the chosen steps one after the other; ``fix`` materialises each result, so a failure halts at its step.

    The log names each step with its seconds and its rows (with ``dry_run`` only the names, and
    ``rows`` comes back as it is).
    """
    log = []
    for name, step in chosen_steps(steps, only, skip):
        if dry_run:
            log.append({"step": name, "dry_run": True})
            continue
        began = time.perf_counter()
        rows = fix(step(rows))
        log.append({"step": name, "seconds": round(time.perf_counter() - began, 3), "rows": rows.count()})
    return rows, log


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Claims that steps changed, added or removed: key, ``old_role`` and ``new_role``."""
    old, new = before.select(*R.KEY, F.col("role").alias("old_role")), after.select(*R.KEY, F.col("role").alias("new_role"))
    return old.join(new, R.KEY, "full").filter(~F.col("old_role").eqNullSafe(F.col("new_role")))
