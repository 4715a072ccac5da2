"""Search queries, retries and the work ledger of connectors. Plain Python: fetching itself runs outside the engine."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..taxonomy import is_raw


def any_of(terms: Iterable[str], joint: str = " OR ") -> str:
    return joint.join(terms)


def bulk_term(term: str) -> str:
    """A term of letters and digits stays bare; any other is quoted once, with single spaces for spaces and hyphens."""
    bare = re.sub(r"[\s\-]+", " ", term.strip())
    return bare if bare.isascii() and bare.isalnum() else '"' + bare.strip('"') + '"'


def bulk_query(terms: Iterable[str]) -> str:
    return any_of(map(bulk_term, terms), " | ")


def concept_query(synonyms: Iterable[str], extra: Iterable[str] = ()) -> str:
    """Plain synonyms, the joined form of those that have one of six characters or more, then extras; the first of equals stays."""
    forms = []
    for s in filter(lambda x: not is_raw(x), synonyms):
        joined = re.sub(r"[\s\-]+", "", s)
        forms += [s, joined] if joined != s and joined.isascii() and joined.isalnum() and len(joined) >= 6 else [s]
    first: dict[str, str] = {}
    for term in map(bulk_term, [*forms, *extra]):
        first.setdefault(term.lower(), term)
    return any_of(first.values(), " | ")


def openalex_query(terms: Iterable[str]) -> str:
    return any_of(f'"{t}"' if " " in t else t for t in terms)


def ieee_query(terms: Iterable[str]) -> str:
    return any_of(f'"{t}"' for t in terms)


def arxiv_query(terms: Iterable[str]) -> str:
    words = [t.strip() for t in terms]
    return "(" + any_of(f'abs:"{t}"' if " " in t else f"abs:{t}" for t in words) + ")"


@dataclass(frozen=True)
class Backoff:
    """Waits of a connector: first wait, factor, longest wait, attempts, and how long all waits may be together."""

    first: float
    factor: float
    longest: float
    attempts: int
    total: float = float("inf")

    def waits(self) -> list[float]:
        every = [min(self.first * self.factor**i, self.longest) for i in range(self.attempts)]
        return [w for w, before in zip(every, accumulate(every, initial=0.0)) if before < self.total]

    def call(self, request: Callable[[], tuple[bool, object, float | None]], sleep: Callable[[float], None]) -> object:
        """Calls ``request`` (done, result, wait asked for by the server) until done; the last failure is raised."""
        for wait in self.waits():
            done, result, asked = request()
            if done:
                return result
            sleep(min(max(wait, asked or 0), self.longest))
        raise TimeoutError(f"no answer in {len(self.waits())} attempts")


# Waits by service
BACKOFF = {"s2": Backoff(4, 1.8, 120, 12), "openalex": Backoff(3, 2, 600, 10), "arxiv": Backoff(5, 2, 60, 12, 300), "ieee": Backoff(10, 1, 10, 10)}


def year_range(spec: str) -> range:
    """'2014-2026' or '2020', ends included."""
    first, _, last = spec.partition("-")
    return range(int(first), int(last or first) + 1)


def shard(items: list, index: int, of: int) -> list:
    return items[index::of]


def open_work(work: DataFrame, ledger: DataFrame) -> DataFrame:
    """Concept-years of ``work`` (concept, year, query) that the ledger does not hold as done with the same query."""
    return work.join(ledger.select("concept", "year", "query"), ["concept", "year", "query"], "left_anti")


def is_share(ord_column: str, index: int, of: int):
    """The rows of one worker when work is dealt by number."""
    return F.pmod(F.col(ord_column), F.lit(of)) == index
