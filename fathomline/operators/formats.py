"""Line formats: how a raw line becomes a record. A format is a name, a pattern and Column expressions.

Two dialects: ``strict`` wants exactly two fields; ``joined`` takes all further fields as the value,
put together without the delimiter.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions.exprs import fields, utrim

# Fixed value: what an address looks like at the start of a line.
ADDRESS = r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]{2,63}"


@dataclass(frozen=True)
class Format:
    name: str
    pattern: str
    pieces: Callable[[Column], Column]
    strict: bool = True

    def accepts(self, line: Column) -> Column:
        """The regex gate and, if strict, the field count."""
        gate = line.rlike(self.pattern)
        return gate & (F.size(self.pieces(line)) == 2) if self.strict else gate

    def record(self, line: Column) -> dict[str, Column]:
        """The four fields of an accepted line: address, its two sides in lower case, the value as it is."""
        pieces = self.pieces(line)
        email = F.lower(F.get(pieces, F.lit(0)))
        sides = F.split(email, "@", -1)
        value = F.get(pieces, F.lit(1)) if self.strict else F.array_join(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), "")
        return {"email": email, "user": F.get(sides, F.lit(0)), "domain": F.get(sides, F.lit(1)), "password": F.coalesce(value, F.lit(""))}


def _by(delimiter: str) -> Callable[[Column], Column]:
    return lambda line: F.split(line, delimiter, -1)


REGISTRY: dict[str, Format] = {}


def register(made: Format) -> Format:
    """Adds a format; a name can't be taken twice."""
    if made.name in REGISTRY:
        raise ValueError(f"format {made.name} exists")
    REGISTRY[made.name] = made
    return made


COLON = register(Format("colon-newline", ADDRESS + ":", _by(":")))
SEMICOLON = register(Format("semicolon-newline", ADDRESS + ";", _by(";")))
WHITESPACE = register(Format("whitespace-newline", ADDRESS + "[ \t]+", fields))
COLON_JOINED = register(Format("colon", ADDRESS + ":", _by(":"), strict=False))
SEMICOLON_JOINED = register(Format("semicolon", ADDRESS + ";", _by(";"), strict=False))
WHITESPACE_JOINED = register(Format("whitespace", ADDRESS + "[ \t]+", fields, strict=False))


def supported() -> list[str]:
    return sorted(REGISTRY)


def named(name: str) -> Format:
    if name not in REGISTRY:
        raise ValueError(f"unknown format {name!r}; choose one of {', '.join(supported())}")
    return REGISTRY[name]


def normalize(lines: DataFrame, format: str | Format, column: str = "line", keep: tuple[str, ...] = ()) -> DataFrame:
    """Records of the lines that the format accepts; other lines drop out silently.

    One narrow stage: no shuffle, no Python. ``keep`` names further columns to carry.
    """
    chosen = named(format) if isinstance(format, str) else format
    line = utrim(F.col(column))
    ready = lines.select(*keep, line.alias("__line")).where(F.length("__line") > 0).where(chosen.accepts(F.col("__line")))
    return ready.select(*keep, *[c.alias(n) for n, c in chosen.record(F.col("__line")).items()])


def line_counts(lines: DataFrame, format: str | Format, column: str = "line") -> DataFrame:
    """One row: lines, blank ones, accepted ones and rejected ones."""
    chosen = named(format) if isinstance(format, str) else format
    line = utrim(F.col(column))
    some = F.length(line) > 0
    taken = F.coalesce(some & chosen.accepts(line), F.lit(False))
    return lines.agg(F.count("*").alias("lines"), F.count_if(~some).alias("blank"), F.count_if(taken).alias("accepted"), F.count_if(some & ~taken).alias("rejected"))
