"""Rule sets: the built-in catalogues, custom rules and the regional subset."""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property, lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import regex
from ..functions.backtracking import loses_itself
from . import catalogue
from .catalogue import ANY, Rule

RULE_SCHEMA = (
    "rule_ord int, secret_type string, regex string, group_idx int, base_score int, category string, gate string"
)
_RULE_FIELDS = ["rule_ord", "secret_type", "regex", "group_idx", "base_score", "category"]
_RULE_STRUCT = "struct<rule_ord:int,secret_type:string,regex:string,group_idx:int,base_score:int,category:string,needed:array<string>>"

# Assigned names are indexed by the longest of these suffix lengths that fits.
NAME_SUFFIXES = (12, 8, 5)
START_LENGTH = 4


@dataclass(frozen=True)
class RuleSet:
    """An ordered set of rules, indexed by gate key.

    Every rule has exactly one key, so a line that yields distinct keys meets
    each rule at most once.  The set is configuration (hundreds of rules), and
    travels inside the plan as one literal map.
    """

    rules: tuple[Rule, ...]

    def __iter__(self):
        return iter(self.rules)

    def __len__(self):
        return len(self.rules)

    @cached_property
    def starts(self) -> list[str]:
        """Literals of the word-start gates, none of which starts another."""
        heads = sorted({r.gate[1][:START_LENGTH] for r in self.rules if r.gate[0] == "start"})
        return [h for h in heads if not any(h != o and h.startswith(o) for o in heads)]

    @cached_property
    def classes(self) -> list[str]:
        return sorted({key.removeprefix("class:") for key in self.keys if key.startswith("class:")})

    @cached_property
    def name_keys(self) -> list[str]:
        return sorted({key for key in self.keys if key.startswith("name:")})

    @cached_property
    def keys(self) -> list[str]:
        return [self.gate_key(r) for r in self.rules]

    def gate_key(self, rule: Rule) -> str:
        kind, value = rule.gate
        if kind == "name":
            for n in NAME_SUFFIXES:
                if len(value) >= n:
                    return f"name:{value[-n:]}"
            kind, value = ANY
        elif kind == "start":
            return "start:" + next(s for s in self.starts if value.startswith(s))
        return f"{kind}:{value}"

    def __hash__(self):
        return self._hash

    @cached_property
    def _hash(self) -> int:
        return hash(self.rules)

    @cached_property
    def rows(self) -> list[tuple]:
        return [
            (i, r.name, regex.java(r.regex), r.group, r.score, r.category, self.gate_key(r))
            for i, r in enumerate(self.rules)
        ]

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, RULE_SCHEMA)

    @cached_property
    def _index_json(self) -> str:
        by_key: dict[str, list[int]] = {}
        for row in self.rows:
            by_key.setdefault(row[-1], []).append(row[0])
        return json.dumps(by_key)

    def index(self) -> Column:
        """Literal map: gate key -> ordinals of the rules behind it (folded when planned)."""
        return F.from_json(F.lit(self._index_json), "map<string,array<int>>")

    def table(self) -> Column:
        """Literal array of the rules, by ordinal; ``needed`` are literals that a line of a match contains."""
        rules_ = [dict(zip(_RULE_FIELDS, row), needed=regex.literals(r.regex)) for row, r in zip(self.rows, self.rules)]
        return F.from_json(F.lit(json.dumps(rules_)), f"array<{_RULE_STRUCT}>")


@lru_cache
def rules(rule_set: str = "core") -> RuleSet:
    """A built-in set: ``core`` (the default), ``full`` or ``ru``."""
    if rule_set == "core":
        return RuleSet(tuple(catalogue.core_rules()))
    if rule_set == "full":
        return RuleSet(tuple(catalogue.full_rules()))
    if rule_set == "ru":
        return only_ru(rules("full"))
    raise ValueError(f"unknown rule set: {rule_set!r}")


def only_ru(base: RuleSet) -> RuleSet:
    """The rules of regional services."""
    return RuleSet(tuple(r for r in base if r.ru))


def ru_names() -> list[str]:
    return [r.name for r in rules("full") if r.ru]


def only_ru_findings(findings: DataFrame) -> DataFrame:
    """The findings of regional services; the name list is a fixed literal set."""
    return findings.filter(F.col("secret_type").isin(ru_names()))


def _compiles(spark: SparkSession, name: str, pattern: str) -> bool:
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(regex.java(pattern))
        return True
    except Exception as exc:  # noqa: BLE001 - Java's message is the useful part
        warnings.warn(f"invalid regex in custom rule {name!r}: {exc}; skipped", stacklevel=3)
        return False


def add_custom_rules(spark: SparkSession, base: RuleSet, custom: Iterable[dict]) -> RuleSet:
    """Append user rules after the built-in ones.

    A rule needs ``name`` and ``regex``; ``score`` and ``category`` have
    defaults.  Entries that lack either, whose regex is invalid, or whose regex
    could hold a task for ever on one line, are skipped, the latter two with a
    warning.
    A rule named like an earlier one takes that rule's place.
    """
    merged = {r.name: r for r in base}
    for entry in custom:
        if "name" not in entry or "regex" not in entry or not _compiles(spark, entry["name"], entry["regex"]):
            continue
        if loses_itself(entry["regex"]):
            warnings.warn(f"regex of custom rule {entry['name']!r} backtracks without bound; skipped", stacklevel=2)
            continue
        merged[entry["name"]] = Rule(
            entry["name"], entry["regex"], int(entry.get("score", fv.CUSTOM_RULE_SCORE)),
            entry.get("category", fv.CUSTOM_RULE_CATEGORY),
        )
    return RuleSet(tuple(merged.values()))
