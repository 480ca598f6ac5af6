"""The fixed record model: four strings that are never null; a missing value is ''."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

FIELDS = ("email", "user", "domain", "password")
#: The fields that a lookup may be keyed by.
KEYS = ("email", "user", "domain")

RECORD = T.StructType([T.StructField(f, T.StringType(), True) for f in FIELDS])
INDEX = T.StructType([T.StructField("digest", T.LongType()), T.StructField("offset", T.LongType())])
RESULT_ROW = T.StructType([T.StructField("email", T.StringType()), T.StructField("password", T.StringType())])
RESULT = T.StructType([T.StructField("count", T.LongType()), T.StructField("page", T.LongType()), T.StructField("pages", T.LongType()), T.StructField("results", T.ArrayType(RESULT_ROW))])


@dataclass(frozen=True)
class QuerySet:
    """A lookup request: the first filled field of a routing order is used."""

    email: str = ""
    domain: str = ""
    user: str = ""
    page: int = 0

    @classmethod
    def from_json(cls, body: dict) -> QuerySet:
        """Names match in any case; a value of the wrong kind counts as missing."""
        low = {str(k).lower(): v for k, v in body.items()}
        text = {k: low[k] for k in KEYS if isinstance(low.get(k), str)}
        page = low.get("page")
        return cls(**text, page=page if isinstance(page, int) and not isinstance(page, bool) else 0)


@dataclass(frozen=True)
class ResultSet:
    count: int
    page: int
    pages: int
    results: list[dict[str, str]] = field(default_factory=list)

    def to_dict(self) -> dict:
        return {"count": self.count, "page": self.page, "pages": self.pages, "results": self.results}


def check_key(key: str, allowed: tuple[str, ...] = FIELDS) -> str:
    """The key itself; an unknown one is an error, not an index of nothing."""
    if key not in allowed:
        raise ValueError(f"unknown key {key!r}; choose one of {', '.join(allowed)}")
    return key
