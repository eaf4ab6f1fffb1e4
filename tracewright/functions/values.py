"""Part values: number and unit to SI, display text and deck text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VALUE = r"^\s*([0-9]+\.?[0-9]*|\.[0-9]+)\s*([a-zA-ZµΩ]+)?\s*$"

# fixed values: power of ten and deck suffix by unit text; capacitors and inductors ignore case
REACTIVE_UNITS = {"": (0, ""), "p": (-12, "p"), "n": (-9, "n"), "u": (-6, "u"), "m": (-3, "m")}
RESISTOR_UNITS = {
    "": (0, ""), "r": (0, ""), "R": (0, ""), "k": (3, "k"), "K": (3, "K"), "M": (6, "Meg"), "m": (-3, "m"),
    "g": (9, "G"), "G": (9, "G"), "meg": (6, "Meg"), "Meg": (6, "Meg"), "MEG": (6, "Meg"),
}
BASE_UNITS = {"capacitor": "F", "inductor": "H", "resistor": "Ω"}


def _unit_map(table: dict, pick: int, kind: str) -> Column:
    cells = []
    for k, v in table.items():
        cells += [F.lit(k), F.lit(v[pick]).cast(kind)]
    return F.create_map(*cells)


def parse_value(text: Column, part: Column) -> Column:
    """struct(number, exponent, suffix, si, base) or null.

    A missing unit means micro on capacitors and inductors. The number stays text
    beside its exponent, so the SI value is the double nearest to the exact product.
    """
    number = F.regexp_extract(text, VALUE, 1)
    unit = F.regexp_replace(F.regexp_extract(text, VALUE, 2), "[µμ]", "u")
    reactive = F.regexp_replace(F.lower(unit), "[fh]$", "")
    ohmic = F.regexp_replace(F.regexp_replace(unit, "[ΩΩω]", "ohm"), "(?i)ohms?", "")
    is_r = part == "resistor"
    given = unit != ""
    exp = (
        F.when(~given, F.when(is_r, 0).otherwise(-6))
        .when(is_r, F.try_element_at(_unit_map(RESISTOR_UNITS, 0, "int"), ohmic))
        .otherwise(F.try_element_at(_unit_map(REACTIVE_UNITS, 0, "int"), reactive))
    )
    suffix = (
        F.when(~given, F.when(is_r, "").otherwise("u"))
        .when(is_r, F.try_element_at(_unit_map(RESISTOR_UNITS, 1, "string"), ohmic))
        .otherwise(F.try_element_at(_unit_map(REACTIVE_UNITS, 1, "string"), reactive))
    )
    base = F.when(part == "capacitor", "F").when(part == "inductor", "H").when(is_r, "Ω")
    si = F.concat(number, F.lit("e"), exp.cast("string")).try_cast("double")
    ok = text.rlike(VALUE) & (F.lower(F.trim(text)) != "unknown") & base.isNotNull() & exp.isNotNull()
    return F.when(ok, F.struct(number.alias("number"), exp.alias("exponent"), suffix.alias("suffix"), si.alias("si"), base.alias("base")))


def plain_number(text: Column) -> Column:
    """Decimal text without needless zeros: `4.70` to `4.7`, `007` to `7`, `.5` to `0.5`."""
    whole = F.regexp_replace(F.regexp_extract(text, r"^(\d*)", 1), r"^0+(?=\d)", "")
    part = F.regexp_replace(F.regexp_extract(text, r"\.(\d*)$", 1), "0+$", "")
    whole = F.when(whole == "", "0").otherwise(whole)
    return F.when(part == "", whole).otherwise(F.concat(whole, F.lit("."), part))


def deck_value(parsed: Column) -> Column:
    """Number in the user's own unit with the deck suffix."""
    return F.concat(plain_number(parsed["number"]), parsed["suffix"])


def six_digits(c: Column) -> Column:
    """Six significant digits without trailing zeros; below 1e-4 and from 1e6 on with an exponent, as in `1.5e-05`."""
    exact = F.format_string("%.5e", c)
    power = F.substring_index(exact, "e", -1)
    places = F.lit(5) - power.try_cast("int")
    short = lambda t: F.regexp_replace(F.regexp_replace(t, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    fixed = F.when(places == 0, F.format_string("%.0f", c))
    for p in range(1, 10):
        fixed = fixed.when(places == p, F.format_string(f"%.{p}f", c))
    return F.when(c == 0, "0").when(places.between(0, 9), short(fixed)).when(c.isNotNull(), F.concat(short(F.substring_index(exact, "e", 1)), F.lit("e"), power))


# fixed values: display scales by base unit, largest first (from, factor, prefix)
SMALL_SCALES = ((1e-3, 1e3, "m"), (1e-6, 1e6, "µ"), (1e-9, 1e9, "n"), (0.0, 1e12, "p"))
OHM_SCALES = ((1e9, 1e-9, "G"), (1e6, 1e-6, "M"), (1e3, 1e-3, "k"), (0.0, 1.0, ""))


def display_value(parsed: Column) -> Column:
    """Number with a scaled prefix, such as `4.7kΩ`."""
    si, base = parsed["si"], parsed["base"]

    def pick(scales) -> Column:
        out = None
        for floor, factor, prefix in scales:
            text = F.concat(six_digits(si / F.lit(1 / factor) if factor < 1 else si * F.lit(factor)), F.lit(prefix), base)
            cond = si >= F.lit(floor) if floor else F.lit(True)
            out = F.when(cond, text) if out is None else out.when(cond, text)
        return out

    return F.when(base == "Ω", pick(OHM_SCALES)).otherwise(pick(SMALL_SCALES))
