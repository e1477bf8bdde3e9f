"""Lines x rules: find every rule match on a line without trying every rule.

Evaluating every rule on every line costs rules x lines regex searches.  Each
rule instead declares a gate, a condition any matching line must meet, and a
line computes the keys of the gates it passes:

* ``name:``  the end of an identifier that is followed by ``=`` or ``:``
* ``start:`` the literal that a word starts with
* ``class:`` a line condition such as "contains ``://``"

The keys look rules up in a literal map, so only candidate pairs reach a regex,
and of these only pairs where the line contains the rule's plain literals.
All of it is one expression per line: no join, no shuffle, no data-sized build
side, and the same code runs on batch and streaming input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import regex
from ..functions.text import col, fold_case
from .rules import NAME_SUFFIXES, RuleSet, rules

_NAME_CHARS = rf"A-Za-z0-9_\-{regex.FOLDED}"
_ASSIGNED_NAME = regex.java(rf"(?<![{_NAME_CHARS}])([{_NAME_CHARS}]++)\s*+[=:]")

_RUN = r"(?<![A-Za-z0-9_/+=\-])[A-Za-z0-9_/+=\-]{20}"

_LINE_CONDITIONS = {
    "url": lambda line: line.contains("://"),
    "pem": lambda line: line.contains("-----") & line.rlike("(?iu)-----begin"),
    "ssh": lambda line: line.contains("ssh-"),
    "bot id": lambda line: line.contains(":") & line.rlike(regex.java(r"\d{8}:")),
    "digits": lambda line: line.rlike(regex.java(r"\d{10}")),
    "run": lambda line: line.rlike(_RUN),
    # A plain first character lets a search pass over most places at once.
    "auth": lambda line: line.rlike("[bB](?iu:earer|asic)"),
    "aws": lambda line: line.rlike("[aA](?iu:ws)") & line.rlike(_RUN),
    "yandex": lambda line: line.contains("yandex"),
    "counter": lambda line: line.contains("(") & line.rlike(r"(?iu)ym\("),
    "cloud file": lambda line: (
        line.contains("service_account") | line.contains("AccountKey=") | line.contains("?sv=")
        | line.contains("_authToken")
    ),
    "setting": lambda line: _has_assignment(line) & line.rlike(regex.java(r"[=:]\s*['\"]?[^\s'\"]{8}")),
}
# These look at the identifiers before ``=`` or ``:``, in plain spelling.
_NAME_CONDITIONS = {
    "key": r"key\z",
    "secret": r"(?:secret|password|passwd|pwd)\z",
    "string": r"string\z",
    "host": r"(?:host|server|endpoint)\z",
}


def _has_assignment(line: Column) -> Column:
    return line.contains("=") | line.contains(":")


def _strings(*items: Column) -> Column:
    return F.array(*items) if items else F.array().cast("array<string>")


def _key_if(condition: Column, key: str) -> Column:
    return F.when(condition, _strings(F.lit(key))).otherwise(_strings())


def _start_pattern(starts: list[str]) -> str:
    """One alternation of the word-start literals, grouped by first character."""
    by_first: dict[str, list[str]] = {}
    for s in starts:
        by_first.setdefault(s[0], []).append(s[1:])

    def quoted(text: str) -> str:
        return "".join(c if c.isalnum() or c == "_" else "\\" + c for c in text)

    branches = [f"{first}(?:{'|'.join(map(quoted, rest))})" for first, rest in by_first.items()]
    return f"(?=[{''.join(by_first)}])(?<![{regex.WORD}])(?:{'|'.join(branches)})"


def _name_keys(line: Column, rule_set: RuleSet) -> Column:
    """Keys that follow from the identifiers before ``=`` or ``:`` on a line."""
    names = F.transform(
        F.regexp_extract_all(line, F.lit(_ASSIGNED_NAME), F.lit(1)),
        # Drop separators and fold case the way case-insensitive rules do.
        lambda name: F.translate(fold_case(name), "_-", ""),
    )
    known = rule_set.name_keys

    def keys(name):
        suffixes = F.array(*[F.concat(F.lit("name:"), F.right(name, F.lit(n))) for n in NAME_SUFFIXES])
        return F.concat(
            F.filter(suffixes, lambda key: key.isin(known)) if known else _strings(),
            *[_key_if(name.rlike(_NAME_CONDITIONS[c]), f"class:{c}") for c in rule_set.classes if c in _NAME_CONDITIONS],
        )

    return F.array_distinct(F.flatten(F.transform(names, keys)))


def gate_keys(line: Column | str, rule_set: RuleSet) -> Column:
    """Distinct keys of the gates that a line passes."""
    c = col(line)
    parts = [_strings()]
    for name in rule_set.classes:
        if name in _LINE_CONDITIONS:
            parts.append(_key_if(_LINE_CONDITIONS[name](c), f"class:{name}"))
        elif name not in _NAME_CONDITIONS:
            parts.append(_strings(F.lit(f"class:{name}")))
    if rule_set.starts:
        found = F.regexp_extract_all(c, F.lit(_start_pattern(rule_set.starts)), F.lit(0))
        parts.append(F.array_distinct(F.transform(found, lambda s: F.concat(F.lit("start:"), s))))
    if rule_set.name_keys or set(rule_set.classes) & set(_NAME_CONDITIONS):
        parts.append(F.when(_has_assignment(c), _name_keys(c, rule_set)).otherwise(_strings()))
    return F.concat(*parts)


def line_matches(line: Column | str, keys: Column, rule_set: RuleSet) -> Column:
    """All matches on a line: every non-overlapping, leftmost match of every candidate rule.

    Elements: ``rule_ord, secret_type, base_score, category, match_ord, value``,
    in (rule, match) order.
    """
    c, index, table = col(line), rule_set.index(), rule_set.table()
    candidates = F.sort_array(F.flatten(F.transform(keys, lambda key: F.element_at(index, key))))

    def one_rule(rule):
        values = F.regexp_extract_all(c, rule["regex"], rule["group_idx"])
        return F.transform(
            values,
            lambda value, i: F.struct(
                rule["rule_ord"].alias("rule_ord"),
                rule["secret_type"].alias("secret_type"),
                rule["base_score"].alias("base_score"),
                rule["category"].alias("category"),
                (i + 1).alias("match_ord"),
                value.alias("value"),
            ),
        )

    # A regex of a column is compiled anew for each candidate, so those that lack a literal are left out before.
    possible = F.filter(
        F.transform(candidates, lambda i: F.get(table, i)), lambda rule: F.forall(rule["needed"], lambda x: c.contains(x))
    )
    return F.flatten(F.transform(possible, one_rule))


def match_rules(lines: DataFrame, rule_set: RuleSet | None = None, line: str = "line") -> DataFrame:
    """One row per match of a rule on a line; the other columns are kept."""
    rule_set = rule_set or rules()
    return lines.select(
        "*", F.inline(line_matches(line, gate_keys(line, rule_set), rule_set))
    )
