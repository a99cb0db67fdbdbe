"""Rules over records: transforms, quality checks and validation.

A rule list becomes one Column expression, so any number of rules costs one
pass in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """One transform: its kind, the fields it applies to (all if none), and its arguments.

    ``target`` writes the result to a further field and leaves the value.
    """

    kind: str
    fields: tuple[str, ...] = ()
    mappings: dict[str, str] = field(default_factory=dict)
    pattern: str = ""
    replacement: str = ""
    target: str = ""


def _mapped(value: Column, rule: Rule) -> Column:
    table = F.create_map(*[F.lit(x) for pair in rule.mappings.items() for x in pair])
    return F.coalesce(table[F.trim(value)], value)


KINDS: dict[str, Callable[[Column, Rule], Column]] = {
    "exact_mapping": _mapped,
    "dictionary": lambda v, r: _chain(v, r.mappings),
    "regex_replace": lambda v, r: F.regexp_replace(v, r.pattern, r.replacement),
    "trim": lambda v, r: F.trim(v),
    "upper": lambda v, r: F.upper(v),
    "lower": lambda v, r: F.lower(v),
    "remove_chars": lambda v, r: F.translate(v, r.pattern, ""),
    "replace": lambda v, r: F.replace(v, F.lit(r.pattern), F.lit(r.replacement)),
}


def _chain(value: Column, mappings: dict[str, str]) -> Column:
    for old, new in mappings.items():
        value = F.replace(value, F.lit(old), F.lit(new))
    return value


def apply(records: DataFrame, fields: list[str], rules: list[Rule]) -> DataFrame:
    """``records`` with the rules applied in order to each of ``fields``, and how many of them changed."""
    values = {name: F.col(name) for name in fields}
    extra: dict[str, Column] = {}
    for rule in rules:
        if rule.kind not in KINDS:
            raise ValueError(f"unknown rule {rule.kind}")
        for name in rule.fields or fields:
            made = KINDS[rule.kind](values[name], rule)
            if rule.target:
                extra[rule.target] = made
            else:
                values[name] = made
    changed = sum((F.when(values[name].eqNullSafe(F.col(name)), 0).otherwise(1) for name in fields), F.lit(0))
    rest = [c for c in records.columns if c not in fields]
    return records.select(*rest, *[v.alias(n) for n, v in values.items()], *[v.alias(n) for n, v in extra.items()], changed.cast("int").alias("changed"))


def parsed_rules(text: str) -> dict[str, str]:
    """Mappings written as lines ``a -> b``, ``a => b`` or ``a改为b``."""
    found = {}
    for line in text.splitlines():
        for sign in ("=>", "->", "改为"):
            old, hit, new = line.partition(sign)
            if hit and old.strip():
                found[old.strip()] = new.strip()
                break
    return found


def quality(records: DataFrame, key: str, required: list[str], patterns: dict[str, str], unique: list[str]) -> DataFrame:
    """Failed checks of each record in a fixed order: missing values, wrong formats, values used twice."""
    checks = [F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", f"missing:{c}") for c in required]
    checks += [F.when(F.col(c).isNotNull() & ~F.col(c).cast("string").rlike(p), f"format:{c}") for c, p in patterns.items()]
    held = records
    for c in unique:
        # counts are small beside the records: repeated values only
        twice = records.groupBy(c).agg(F.count("*").alias("n")).where("n > 1").select(F.col(c).alias(f"_v_{c}"), F.lit(True).alias(f"_d_{c}"))
        held = held.join(twice, F.col(c) == F.col(f"_v_{c}"), "left")
        checks.append(F.when(F.coalesce(F.col(f"_d_{c}"), F.lit(False)), f"duplicate:{c}"))
    return held.select(key, F.array_join(F.array_compact(F.array(*checks)), ",").alias("failed"))


@dataclass(frozen=True)
class Field:
    """A field of a schema: key, type (string, number, boolean, enum), whether required, allowed values."""

    key: str
    type: str = "string"
    required: bool = False
    values: tuple[str, ...] = ()


def validated(records: DataFrame, key: str, fields: list[Field]) -> DataFrame:
    """Errors of each record against a schema, and whether it is completed or needs review."""
    checks = []
    for f in fields:
        value = F.col(f.key).cast("string")
        absent = value.isNull() | (F.trim(value) == "")
        if f.required:
            checks.append(F.when(absent, f"required:{f.key}"))
        if f.type == "number":
            # a truth value passes for a number
            checks.append(F.when(~absent & value.try_cast("double").isNull() & ~F.lower(value).isin("true", "false"), f"type:{f.key}"))
        if f.type == "boolean":
            checks.append(F.when(~absent & ~F.lower(value).isin("true", "false"), f"type:{f.key}"))
        if f.values:
            checks.append(F.when(~absent & ~value.isin(*f.values), f"enum:{f.key}"))
    errors = F.array_join(F.array_compact(F.array(*checks)), ",")
    return records.select(key, errors.alias("errors"), F.when(errors == "", "completed").otherwise("needs_review").alias("status"))


def line_pairs(texts: DataFrame, id_col: str, text_col: str, labels: dict[str, tuple[str, ...]]) -> DataFrame:
    """Values of ``label: value`` lines by the field whose label or alias it is; the first of each counts."""
    alias = {name.lower(): key for key, names in labels.items() for name in (key, *names)}
    table = F.create_map(*[F.lit(x) for pair in alias.items() for x in pair])
    lines = texts.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))
    part = [F.trim(F.regexp_extract("line", r"^\s*([^:：]{1,40})[:：]\s*(.+)$", k)) for k in (1, 2)]
    found = lines.select("id", "line_no", table[F.lower(part[0])].alias("field"), part[1].alias("value")).where("field is not null and value <> ''")
    return found.groupBy("id", "field").agg(F.min(F.struct("line_no", "value")).alias("b")).select("id", "field", F.col("b.value").alias("value"))
