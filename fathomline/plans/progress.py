"""Progress of runs from Spark's own observed metrics: counts are taken as rows stream by, without a pass of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Progress:
    """Named points of a run and the rows that passed them, once the actions that they are part of are done.

    A task that runs again counts its rows once: Spark keeps the metrics of the attempt that it keeps.
    """

    def __init__(self) -> None:
        self.points: dict[str, Observation | int] = {}

    def watch(self, df: DataFrame, point: str, **more: Column) -> DataFrame:
        """``df`` itself, its rows counted as ``point``; ``more`` names further sums to take.

        Watch what a range exchange gives, not what it reads: it samples its input, which would count twice.
        """
        if point in self.points:
            raise ValueError(f"{point} is watched already")
        self.points[point] = Observation(point)
        return df.observe(self.points[point], F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in more.items()])

    def note(self, point: str, rows: int) -> None:
        """A count that is known already, as that of a stored table from its footers."""
        if point in self.points:
            raise ValueError(f"{point} is watched already")
        self.points[point] = rows

    def report(self) -> dict[str, dict[str, int]]:
        """Every point's counts; call it after the actions."""
        return {point: {"rows": o} if isinstance(o, int) else dict(o.get) for point, o in self.points.items()}

    def rows(self, point: str) -> int:
        return self.report()[point]["rows"] or 0

    def share(self, done: str, whole: str) -> float:
        """Rows that passed ``done`` in percent of those that passed ``whole``; 100 where there are none."""
        total = self.rows(whole)
        return 100.0 * self.rows(done) / total if total else 100.0

    def lines(self) -> list[str]:
        """One line a point, for people."""
        return [f"{point}: " + ", ".join(f"{k} {v}" for k, v in counts.items()) for point, counts in self.report().items()]


def watched(progress: Progress | None, df: DataFrame, point: str, **more: Column) -> DataFrame:
    """``df``, watched if there is someone to tell."""
    return progress.watch(df, point, **more) if progress else df
