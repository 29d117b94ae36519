"""Text rules: vehicle class to category, sheet headers, month names."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: standard categories -------------------------------------
STANDARD_CATEGORIES = ["2-Wheelers", "3-Wheelers", "4-Wheelers", "Bus", "Others"]

# ---- fixed values: exact class names of the rule set ------------------------
EXACT_CLASSES = {
    "2-Wheelers": ["TWO WHEELER(NT)", "TWO WHEELER(T)"],
    "3-Wheelers": ["THREE WHEELER(T)", "THREE WHEELER(NT)", "E-RICKSHAW(P)",
                   "E-RICKSHAW WITH CART (G)"],
    "4-Wheelers": ["MOTOR CAR", "LIGHT MOTOR VEHICLE"],
    "Bus": ["BUS", "HEAVY PASSENGER VEHICLE"],
}

# ---- fixed values: substrings tried in this order after the exact names -----
SUBSTRING_CLASSES = {
    "2-Wheelers": ["TWO WHEELER", "M-CYCLE", "SCOOTER"],
    "3-Wheelers": ["THREE WHEELER", "RICKSHAW"],
    "4-Wheelers": ["MOTOR CAR", "LMV", "JEEP"],
    "Bus": ["BUS"],
}

# ---- fixed values: lookup used by the sheet ingest ---------------------------
CLASS_LOOKUP = {
    "2-Wheelers": ["TWO WHEELER(NT)", "TWO WHEELER (INVALID CARRIAGE)",
                   "MOTOR CYCLE/SCOOTER-USED FOR HIRE", "M-CYCLE/SCOOTER"],
    "3-Wheelers": ["THREE WHEELER(T)", "THREE WHEELER(NT)"],
    "4-Wheelers": ["FOUR WHEELER (INVALID CARRIAGE)", "MOTOR CAR", "MOTOR CAB",
                   "LIGHT MOTOR VEHICLE", "LIGHT PASSENGER VEHICLE"],
    "Bus": ["BUS", "HEAVY PASSENGER VEHICLE", "MEDIUM PASSENGER VEHICLE"],
    "Others": ["LIGHT GOODS VEHICLE", "HEAVY GOODS VEHICLE"],
}

# ---- fixed values: classes the trainer's lookup does not know ----------------
TRAINER_LOOKUP_LACKS = ["FOUR WHEELER (INVALID CARRIAGE)", "LIGHT PASSENGER VEHICLE"]

# ---- fixed values: month names ------------------------------------------------
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN",
          "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]


def category_by_rules(vehicle_class: Column) -> Column:
    """Exact name first, then substring, else Others (null counts as Others)."""
    name = F.upper(F.trim(vehicle_class))
    rules = [(name.isin(names), cat) for cat, names in EXACT_CLASSES.items()]
    for cat, parts in SUBSTRING_CLASSES.items():
        hit = F.lit(False)
        for part in parts:
            hit = hit | name.contains(part)
        rules.append((hit, cat))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for condition, cat in rules:
        out = out.when(condition, F.lit(cat))
    return out.otherwise(F.lit("Others"))


def category_by_lookup(vehicle_class: Column, trainer: bool = False) -> Column:
    """Case-sensitive lookup; standard names pass through, the rest are Others."""
    pairs = {name: cat for cat, names in CLASS_LOOKUP.items() for name in names
             if not (trainer and name in TRAINER_LOOKUP_LACKS)}
    pairs.update({cat: cat for cat in STANDARD_CATEGORIES})
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])
    known = F.coalesce(vehicle_class, F.lit(""))
    return F.coalesce(F.try_element_at(table, known), F.lit("Others"))


def state_from_header(header: Column) -> Column:
    """Text between 'of ' and ' (' of a sheet header, null where absent."""
    hit = F.trim(F.regexp_extract(header, r"of (.*?) \(", 1))
    return F.when(hit != "", hit)


def year_from_header(header: Column, default: int) -> Column:
    """The year in brackets, or the given default."""
    hit = F.regexp_extract(header, r"\((\d{4})\)", 1)
    return F.coalesce(hit.try_cast("int"), F.lit(default))


def state_key(state: Column) -> Column:
    """Key form of a state name: ' & ' becomes And, no blanks, no hyphens."""
    out = F.replace(state, F.lit(" & "), F.lit("And"))
    out = F.replace(out, F.lit(" "), F.lit(""))
    return F.replace(out, F.lit("-"), F.lit(""))


def month_number(month_name: Column, default: int | None = 1) -> Column:
    """1..12 for JAN..DEC; anything else gives the default."""
    table = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, i)])
    hit = F.try_element_at(table, F.coalesce(month_name, F.lit("")))
    return hit if default is None else F.coalesce(hit, F.lit(default))


def month_date(year: Column, month_name: Column, day: int = 1) -> Column:
    """Date of a named month, on the given day (1, or 15 for mid-month)."""
    return F.make_date(year, month_number(month_name), F.lit(day))


def mid_month_or_default(year: Column, month_name: Column, default: str) -> Column:
    """The 15th of the named month, or a fixed date where the name is unknown."""
    number = month_number(month_name, default=None)
    return F.coalesce(F.make_date(year, number, F.lit(15)), F.lit(default).cast("date"))
