"""`key=value` comments, decimal commas and rule tables as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: part types a comment may name
COMPONENT_TYPES = (
    "resistor", "capacitor", "inductor", "diode", "transistor", "op_amp", "connector", "power_rail",
    "ground", "ic_pin", "net_label", "measurement_point", "misc_symbol", "broken_line", "edge_connector",
)

# fixed values: fields each type must carry; other types need only "type"
REQUIRED_FIELDS = {
    "resistor": ["designator", "type"],
    "capacitor": ["designator", "type"],
    "inductor": ["designator", "type"],
    "diode": ["designator", "type"],
    "transistor": ["designator", "type"],
    "op_amp": ["designator", "type"],
    "net_label": ["type"],
    "power_rail": ["type"],
    "ground": ["type"],
    "broken_line": ["type", "reason", "severity"],
    "edge_connector": ["type", "edge_id", "page"],
}

# fixed values: accepted texts
VALUE_SHAPE = r"(?i)^[0-9]+\.?[0-9]*([pnumkKMG]|pF|nF|uF|µF|mF|pH|nH|uH|µH|mH|ohm|Ω)?$"
COMMA_DECIMAL = r"\d+,\d+"
EDGE_ID_SHAPE = r"^[ABCD][0-9]{2}$"
PAGE_SHAPE = r"^\d{1,3}$"
POWER_SHAPE = r"(?i)^\d+\.?\d*W$"
POLARITIES = ("unknown", "polarized", "electrolytic", "np")
SEVERITIES = ("minor", "major", "critical")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it many times in one expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _pairs(comment: Column) -> Column:
    fields = F.filter(F.split(F.trim(comment), r"\s+"), lambda p: F.instr(p, "=") > 0)
    return F.transform(
        fields,
        lambda p: F.struct(
            F.substring_index(p, "=", 1).alias("k"), F.substr(p, F.instr(p, "=") + 1).alias("v")
        ),
    )


def comment_map(comment: Column) -> Column:
    """Map of a comment; fields without `=` are ignored and the last of equal keys wins."""
    return bind(_pairs(comment), _last_wins)


def _last_wins(pairs: Column) -> Column:
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    last = F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"])
    return F.map_from_arrays(keys, last)


def entry(m: Column, key: str) -> Column:
    """Value of a key, null when it is missing or empty."""
    return F.nullif(F.try_element_at(m, F.lit(key)), F.lit(""))


def without_decimal_commas(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<=\d),(?=\d)", ".")


def map_without_decimal_commas(m: Column) -> Column:
    return F.transform_values(m, lambda _, v: without_decimal_commas(v))


def issue(when: Column, severity: str, field: Column | str, code: str) -> Column:
    f = F.lit(field) if isinstance(field, str) else field
    return F.when(when, F.struct(F.lit(severity).alias("severity"), f.alias("field"), F.lit(code).alias("code")))


def issues(*rules: Column) -> Column:
    return F.array_compact(F.array(*rules))


def metadata_issues(m: Column) -> Column:
    """All rule violations of one comment map, in rule order."""
    return bind(m, _metadata_issues)


def _metadata_issues(m: Column) -> Column:
    kind = entry(m, "type")
    empty = m.isNull() | (F.size(m) == 0)
    no_type = ~empty & kind.isNull()
    typed = ~empty & kind.isNotNull()
    cells = []
    for k, v in REQUIRED_FIELDS.items():
        cells += [F.lit(k), F.array(*[F.lit(x) for x in v])]
    required = F.coalesce(F.try_element_at(F.create_map(*cells), kind), F.array(F.lit("type")))
    absent = F.filter(required, lambda f: ~F.array_contains(F.map_keys(m), f))
    missing = F.transform(
        absent, lambda f: F.struct(F.lit("error").alias("severity"), f.alias("field"), F.lit("missing_field").alias("code"))
    )
    value, polarity, power = entry(m, "value"), entry(m, "polarity"), entry(m, "power")
    comma = value.rlike(COMMA_DECIMAL)
    severity, reason = entry(m, "severity"), F.trim(F.coalesce(F.try_element_at(m, F.lit("reason")), F.lit("")))
    edge = F.trim(F.coalesce(F.try_element_at(m, F.lit("edge_id")), F.lit("")))
    page = F.trim(F.coalesce(F.try_element_at(m, F.lit("page")), F.lit("")))
    note = entry(m, "note")
    of = lambda name: typed & (kind == name)
    head = issues(
        issue(empty, "warning", "metadata", "empty"),
        issue(no_type, "error", "type", "missing_type"),
        issue(typed & ~kind.isin(*COMPONENT_TYPES), "warning", "type", "unknown_type"),
    )
    tail = issues(
        issue(typed & comma, "error", "value", "decimal_comma"),
        issue(typed & ~comma & ~value.rlike(VALUE_SHAPE) & (F.lower(value) != "unknown"), "warning", "value", "value_format"),
        issue(of("capacitor") & polarity.isNull(), "warning", "polarity", "missing_polarity"),
        issue(of("capacitor") & polarity.isNotNull() & ~polarity.isin(*POLARITIES), "warning", "polarity", "invalid_polarity"),
        issue(of("resistor") & (power != "unknown") & ~power.rlike(POWER_SHAPE), "warning", "power", "power_format"),
        issue(of("broken_line") & (reason != "") & (F.length(reason) < 6), "warning", "reason", "short_reason"),
        issue(of("broken_line") & ~F.lower(severity).isin(*SEVERITIES), "error", "severity", "invalid_severity"),
        issue(of("broken_line") & F.lower(severity).isin(*SEVERITIES) & (severity != F.lower(severity)), "warning", "severity", "severity_case"),
        issue(of("edge_connector") & (edge != "") & ~edge.rlike(EDGE_ID_SHAPE), "error", "edge_id", "edge_id_format"),
        issue(of("edge_connector") & (page != "") & ~page.rlike(PAGE_SHAPE), "error", "page", "page_format"),
        issue(of("edge_connector") & (F.length(note) < 4), "warning", "note", "short_note"),
    )
    return F.concat(head, F.when(typed, F.concat(missing, tail)).otherwise(F.slice(head, 1, 0)))
