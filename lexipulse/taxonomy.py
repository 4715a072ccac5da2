"""Concept taxonomies and their patterns.

A synonym with a lower-case letter is a phrase: any case, spaces and hyphens between its parts optional, plural s or es.
One without is an acronym: exact case, plural s. ``re:`` starts a raw pattern. Neither may touch a letter or digit.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

START, END = "(?<![A-Za-z0-9])", "(?![A-Za-z0-9])"
GAP = r"[\s\-]*"


def quoted(part: str) -> str:
    """The part with everything but letters and digits escaped; for Java and Python alike."""
    return "".join(c if c.isalnum() or not c.isascii() else "\\" + c for c in part)


def is_raw(synonym: str) -> bool:
    return synonym.startswith("re:")


def is_phrase(synonym: str) -> bool:
    return any(c.islower() for c in synonym)


def core(synonym: str) -> str:
    """A plain synonym without boundaries: parts, gaps and plural."""
    body = GAP.join(quoted(p) for p in re.split(r"[\s\-]+", synonym.strip()) if p)
    return f"(?iu:{body}(?:s|es)?)" if is_phrase(synonym) else f"(?:{body}s?)"


def pattern(synonym: str) -> str:
    """A Java pattern for one synonym."""
    if is_raw(synonym):
        body = synonym[3:]
        return f"(?iuU:{body[4:]})" if body.startswith("(?i)") else f"(?U:{body})"
    return START + core(synonym) + END


def python_pattern(synonym: str) -> str:
    """The same for Python's re, used by tests and the keyword tester."""
    return pattern(synonym).replace("(?iuU:", "(?i:").replace("(?iu:", "(?i:").replace("(?U:", "(?:")


def presence(synonyms: list[str]) -> str:
    """One pattern that finds a text with any of the synonyms; plain ones share one pair of boundaries."""
    plain, raw = [core(s) for s in synonyms if not is_raw(s)], [pattern(s) for s in synonyms if is_raw(s)]
    return "|".join(([f"{START}(?:{'|'.join(plain)}){END}"] if plain else []) + raw)


def linear_presence(synonyms: list[str]) -> str:
    """Presence for engines without look-around: boundaries that consume. Raw synonyms are left as they are."""
    both = "|".join(core(s).replace("(?iu:", "(?i:") for s in synonyms if not is_raw(s))
    plain = [f"(?:^|[^A-Za-z0-9])(?:{both})(?:$|[^A-Za-z0-9])"] if both else []
    return "|".join(plain + [s[3:] for s in synonyms if is_raw(s)])


@dataclass(frozen=True)
class Concept:
    key: str
    label: str
    category: str
    synonyms: tuple[str, ...]
    exclude: str | None = None
    require: str | None = None
    s2_extra: tuple[str, ...] = ()

    @property
    def groups(self) -> list[int]:
        """The capture group of each synonym in ``alternation``."""
        at, out = 1, []
        for s in self.synonyms:
            out.append(at)
            at += 1 + (re.compile(python_pattern(s)).groups if is_raw(s) else 0)
        return out

    @property
    def alternation(self) -> str:
        """All synonyms in order, a capture group each: the first in the list wins where several match."""
        return "|".join(f"({pattern(s)})" for s in self.synonyms)

    @property
    def warnings(self) -> list[str]:
        """Synonyms that probably mean an acronym but match any case."""
        return [s for s in self.synonyms if not is_raw(s) and is_phrase(s) and re.fullmatch(r"(?=.*[A-Z].*[A-Z])[A-Za-z0-9]{2,6}", s)]


@dataclass(frozen=True)
class Taxonomy:
    domain_terms: tuple[str, ...]
    concepts: tuple[Concept, ...]
    by_key: dict[str, Concept] = field(init=False, compare=False, hash=False)

    def __post_init__(self):
        object.__setattr__(self, "by_key", {c.key: c for c in self.concepts})
        if len(self.by_key) != len(self.concepts):
            raise ValueError("two concepts share a key")
        for c in self.concepts:
            if not c.synonyms:
                raise ValueError(f"{c.key} has no synonyms")

    @property
    def keys(self) -> list[str]:
        return [c.key for c in self.concepts]

    def frame(self, spark: SparkSession) -> DataFrame:
        """category, concept, label, ord: one row a concept."""
        return spark.createDataFrame([(c.category, c.key, c.label, i) for i, c in enumerate(self.concepts)], "category string, concept string, label string, ord int")

    def synonym_frame(self, spark: SparkSession) -> DataFrame:
        """concept, synonym, syn_idx: one row a synonym."""
        return spark.createDataFrame([(c.key, s, i) for c in self.concepts for i, s in enumerate(c.synonyms)], "concept string, synonym string, syn_idx int")


def from_dict(spec: dict) -> Taxonomy:
    return Taxonomy(
        tuple(spec["domain_terms"]),
        tuple(Concept(key, s.get("label", key), category, tuple(s["synonyms"]), s.get("exclude") or None, s.get("require") or None, tuple(s.get("s2_extra", ()))) for category, items in spec["categories"].items() for key, s in items.items()),
    )


def load(path: str | Path) -> Taxonomy:
    """Reads a taxonomy file: domain_terms and categories of concepts."""
    return from_dict(json.loads(Path(path).read_text(encoding="utf-8")))


def load_shared(spark: SparkSession, path: str) -> Taxonomy:
    """The same from any file system that Spark reads."""
    return from_dict(json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())))
