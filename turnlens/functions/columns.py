"""Column-expression helpers (§2.3 P-rules and §2.8 F-families).

All return ``Column`` objects so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- F01 / P02 / P03: line splitting ---------------------------------------

def split_trim(line: str | Column, sep: str = ",") -> Column:
    """Split a delimited line and trim every field."""
    return F.transform(F.split(col(line), sep), lambda x: F.trim(x))


def field(parts: Column, i: int) -> Column:
    """Zero-based positional field; null when the line is short."""
    return F.get(parts, i)


def is_data_line(line: str | Column, header_marker: str = "Turn,") -> Column:
    """Not a header, not blank."""
    c = col(line)
    return ~c.contains(header_marker) & (F.trim(c) != "")


def contains_any(line: str | Column, needles: Sequence[str]) -> Column:
    """P01 (OR form)."""
    c = col(line)
    out = F.lit(False)
    for n in needles:
        out = out | c.contains(n)
    return out


def contains_all(line: str | Column, needles: Sequence[str]) -> Column:
    """P01 (AND form)."""
    c = col(line)
    out = F.lit(True)
    for n in needles:
        out = out & c.contains(n)
    return out


def truncating_int(c: str | Column) -> Column:
    """text → double → int, truncating toward zero; bad text → null."""
    return col(c).try_cast("double").cast("int")


def nullif_blank(c: str | Column) -> Column:
    """'' / whitespace → null (null, empty and NaN all mean "none")."""
    t = F.trim(col(c).cast("string"))
    return F.when((t == "") | (F.lower(t) == "nan"), F.lit(None)).otherwise(t)


# --- P04 / P05 / P06: one-hot -------------------------------------------------

def one_hot(c: str | Column, values: Sequence, prefix: str) -> dict[str, Column]:
    """1/0 flag per listed value."""
    return {f"{prefix}{v}": F.when(col(c) == F.lit(v), 1).otherwise(0) for v in values}


def one_hot_events_only(c: str | Column, values: Sequence, is_event: Column,
                        prefix: str) -> dict[str, Column]:
    """Flag as double on event rows, null elsewhere, so ``avg`` is a
    share over events only."""
    return {f"{prefix}{v}": F.when(is_event, (col(c) == F.lit(v)).cast("double"))
            for v in values}


# --- P13 / P14: buckets -------------------------------------------------------

def bucket_start(t: str | Column, width: int) -> Column:
    """Lower edge ``t - t % w``."""
    return col(t) - col(t) % F.lit(width)


def bucket_label(start: str | Column, width: int) -> Column:
    """Label like ``60-69``."""
    return F.format_string("%d-%d", col(start), col(start) + F.lit(width - 1))


# --- P15 / P16 / P17 ----------------------------------------------------------

# Texts read as "true" by the loose boolean rule (fixed values).
TRUE_WORDS = ("1", "1.0", "true", "t")


def loose_bool(c: str | Column) -> Column:
    """1.0 / 1 / "true" / "t" → 1, anything else → 0."""
    return F.lower(F.trim(col(c).cast("string"))).isin(*TRUE_WORDS).cast("int")


def recode(c: str | Column, mapping: Mapping[str, str]) -> Column:
    """Literal map lookup; unlisted → null (filter with isNotNull)."""
    m = F.create_map(*[x for kv in mapping.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return F.element_at(m, col(c)) if mapping else F.lit(None)


def first_non_empty(*cols: str | Column) -> Column:
    """P17."""
    return F.coalesce(*[nullif_blank(c) for c in cols])


# --- P21 / P23 / P26 / P31 / P32 / P33 ---------------------------------------

def strip_suffix(c: str | Column, suffix_regex: str = r"\s+Era$") -> Column:
    """P21."""
    return F.regexp_replace(col(c), suffix_regex, "")


def fixed_point(c: str | Column, scale: int = 100) -> Column:
    """x100 integer → double, null → 0."""
    return F.coalesce(col(c), F.lit(0)) / F.lit(scale)


def effective_owner(master: str | Column, owner: str | Column) -> Column:
    """P31."""
    return F.coalesce(col(master), col(owner))


def guarded_ratio(a: str | Column, b: str | Column, zero_as: float | None = None) -> Column:
    """A / b, null (or ``zero_as``) when b is 0 or null."""
    r = F.try_divide(col(a), F.nullif(col(b), F.lit(0)))
    return r if zero_as is None else F.coalesce(r, F.lit(zero_as))


def present_flag(c: str | Column) -> Column:
    """Presence of a nullable turn as 0/1."""
    return col(c).isNotNull().cast("int")


def rounded(c: str | Column, digits: int = 4) -> Column:
    """P33."""
    return F.round(col(c), digits)


# --- F04: time ----------------------------------------------------------------

def epoch_micros(ts: str | Column) -> Column:
    """Micro-seconds since epoch for TIMESTAMP or TIMESTAMP_NTZ (session zone)."""
    return F.unix_micros(col(ts).cast("timestamp"))


def day_index(ts: str | Column, origin: str) -> Column:
    """Whole days since ``origin`` (a 'YYYY-MM-DD' literal)."""
    return F.datediff(F.to_date(col(ts)), F.to_date(F.lit(origin)))


def hms(seconds: str | Column) -> Column:
    """seconds → 'Hh Mm Ss'."""
    s = col(seconds).cast("long")
    return F.format_string("%dh %dm %ds", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


# --- P07 / P19 / F08 ------------------------------------------------------------

def rename(df, mapping):
    """Rename a set of columns at once."""
    return df.withColumnsRenamed(dict(mapping))


def decision_class(rules, default: str) -> Column:
    """First matching (condition, label) wins, else ``default``."""
    out = F.lit(default)
    for cond, label in reversed(list(rules)):
        out = F.when(cond, F.lit(label)).otherwise(out)
    return out


def bitmask_of(index: str | Column) -> Column:
    """F08 (aggregate): OR of 1 << index over a group's rows."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1), col(index)))


def bit_is_set(mask: str | Column, bit: int) -> Column:
    """test one bit of a mask."""
    return col(mask).bitwiseAND(F.lit(1 << bit)) != 0


def grid_era_tier(gridx: str | Column) -> tuple[Column, Column, Column]:
    """Grid column → (era number, tier, label). Two columns per era:
    era = (g − 1) div 2 + 1, tier = (g − 1) mod 2 + 1; eras 8–9 carry the
    special labels, others "<era name> T<tier>". Null outside eras 1..9."""
    from turnlens.sources.dims import ERA_NAMES
    g = col(gridx).cast("int")
    era = F.floor((g - 1) / 2).cast("int") + 1
    tier = F.pmod(g - 1, F.lit(2)) + 1
    names = F.array(*[F.lit(n) for n in ERA_NAMES])
    label = (F.when((era == 8) & (tier == 1), F.lit("Information T1"))
             .when((era == 8) & (tier == 2), F.lit("Information T2"))
             .when((era == 9) & (tier == 1), F.lit("Information T3"))
             .when((era == 9) & (tier == 2), F.lit("Future"))
             .when(era.between(1, 7), F.concat(F.element_at(names, era), F.lit(" T"),
                                                tier.cast("string"))))
    ok = era.between(1, 9)
    return (F.when(ok, era), F.when(ok, tier), F.when(ok, label))


def hash_number(*parts: Column, digits: int = 13) -> Column:
    """A whole number below 16^digits from the MD5 of the parts joined by
    ``|``: the same on every engine that has MD5."""
    text = F.concat_ws("|", *[c.cast("string") for c in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")
