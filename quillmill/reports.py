"""Reports: timings and whether two may be compared, plans for one result against each other, small tables as text."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from statistics import median

from pyspark.sql import DataFrame


class ReportError(ValueError):
    """Two reports of different things."""


def compared(before: dict, after: dict) -> dict[str, dict[str, float | None]]:
    """By query: seconds before and after, and the change as a share. Both reports must be of one scale and unit and have the same queries."""
    for field in ("sf", "unit", "metric"):
        if before.get(field) != after.get(field):
            raise ReportError(f"{field} differs: {before.get(field)!r} and {after.get(field)!r}")
    if before["queries"].keys() != after["queries"].keys():
        raise ReportError("the reports have different queries")
    out = {}
    for name, old in before["queries"].items():
        new = after["queries"][name]
        out[name] = {"before": old, "after": new, "change": (new - old) / old if old else None}
    return out


def matrix(run: Callable[[str, int], object], kinds: Sequence[str] = ("word", "sentence"), sizes: Sequence[int] = (1, 100, 1_000, 10_000), times: int = 5) -> list[dict]:
    """Seconds of run(kind, size), the first time (cold) and then (warm: median, least, most, items a second), by kind and size."""
    out = []
    for kind in kinds:
        for size in sizes:
            seconds = []
            for _ in range(times + 1):
                began = time.perf_counter()
                run(kind, size)
                seconds.append(time.perf_counter() - began)
            middle = median(seconds[1:])
            out.append({"kind": kind, "size": size, "cold": seconds[0], "median": middle, "least": min(seconds[1:]), "most": max(seconds[1:]), "per_second": size / middle if middle else None})
    return out


def chosen(matrices: dict[str, list[dict]]) -> dict:
    """The strategy of least summed medians, by name where they are equal, and the sums. All must have the same kinds and sizes."""
    cells = {name: [(r["kind"], r["size"]) for r in rows] for name, rows in matrices.items()}
    if len({tuple(c) for c in cells.values()}) != 1:
        raise ReportError("the strategies were not timed on the same work")
    totals = {name: sum(r["median"] for r in rows) for name, rows in matrices.items()}
    return {"strategy": min(totals, key=lambda name: (totals[name], name)), "totals": totals}


def ab(plans: dict[str, Callable[[], DataFrame]], times: int = 3) -> dict:
    """Plans for one result against each other: {rows, parity, seconds (plan -> median), chosen}.

    Parity comes first: every plan's rows, repeated ones as often as they occur, have to be the first one's, and
    ValueError says which plan differs. Then each runs `times` times, in turns, and the plan of the least median is chosen.
    """
    names = list(plans)
    first = plans[names[0]]()
    for other in names[1:]:
        found = plans[other]().select(*first.columns)
        if not (first.exceptAll(found).isEmpty() and found.exceptAll(first).isEmpty()):
            raise ValueError(f"{other} does not give the rows of {names[0]}")
    seconds: dict[str, list[float]] = {n: [] for n in names}
    for _ in range(times):
        for n in names:
            began = time.perf_counter()
            plans[n]().write.format("noop").mode("overwrite").save()
            seconds[n].append(time.perf_counter() - began)
    medians = {n: median(x) for n, x in seconds.items()}
    return {"rows": first.count(), "parity": True, "seconds": medians, "chosen": min(names, key=lambda n: (medians[n], names.index(n)))}


def markdown(title: str, sections: dict[str, DataFrame], most: int = 200) -> str:
    """A report of small tables, a heading and a table each; a table of more than `most` rows says how many are left out."""

    def cell(v: object) -> str:
        text = "N/A" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
        return text.replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ")

    out = [f"# {title}"]
    for name, df in sections.items():
        rows = df.limit(most + 1).collect()
        out += ["", f"## {name}", "", "| " + " | ".join(map(cell, df.columns)) + " |", "|" + " --- |" * len(df.columns)]
        out += ["| " + " | ".join(map(cell, r)) + " |" for r in rows[:most]]
        if len(rows) > most:
            out += ["", f"{df.count() - most} rows more."]
    return "\n".join(out) + "\n"
