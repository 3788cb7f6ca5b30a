"""Registry of named queries: a Spark plan, the inventory rows it covers, its SQL twin."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.plans.fragments import CTES
from slotwise.session import Tables


# Added before rounding so that exact ties (means of two-decimal values) round alike in both engines.
NUDGE = 1.3e-8


@dataclass(frozen=True)
class Query:
    name: str
    ids: tuple[str, ...]
    build: Callable[[Tables], DataFrame]
    rounded: tuple[str, ...]
    body: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        df = self.build(Tables(spark, folder))
        if not self.rounded:
            return df
        return df.withColumns({c: F.round(F.col(c).cast("double") + NUDGE, 6) for c in self.rounded})

    def sql(self) -> str | None:
        if self.body is None:
            return None
        text = with_fragments(self.body)
        if not self.rounded:
            return text
        swaps = ", ".join(f"round(CAST({c} AS DOUBLE) + {NUDGE}, 6) + 0 AS {c}" for c in self.rounded)
        return f"SELECT * REPLACE ({swaps}) FROM (\n{text}\n)"


QUERIES: dict[str, Query] = {}


def query(ids: str, rnd: str = "", sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under its own name.

    ``ids`` lists the inventory rows covered, ``rnd`` the double columns both
    engines round to 6 digits.
    """

    def register(fn: Callable[[Tables], DataFrame]):
        if fn.__name__ in QUERIES:
            raise ValueError(f"duplicate query {fn.__name__}")
        QUERIES[fn.__name__] = Query(fn.__name__, tuple(ids.split()), fn, tuple(rnd.split()), sql)
        return fn

    return register


def with_fragments(body: str) -> str:
    """Prefix ``body`` with the shared CTEs it mentions, directly or through each other."""
    needed: set[str] = set()
    frontier = [body]
    while frontier:
        text = frontier.pop()
        for name, fragment in CTES.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                frontier.append(fragment)
    parts = [f"{name} AS ({CTES[name].strip()})" for name in CTES if name in needed]
    body = body.strip()
    own = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    if own:
        body = body[own.end():]
        return "WITH RECURSIVE " + ",\n".join([*parts, body])
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" + body) if parts else body
