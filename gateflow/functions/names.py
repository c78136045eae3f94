"""Column expressions for station names, lines and slot labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gateflow.config import COLLATION, LINE_SUFFIX, STATION_SUFFIX

# what Python's str.strip() treats as blank, as a Java character class
_BLANK = r"[\s\p{Z}\x{1C}-\x{1F}\x{85}]"


def trim_space(c: Column) -> Column:
    """Strip all white space at both ends (F.trim strips blanks only)."""
    return F.regexp_replace(c, f"^{_BLANK}+|{_BLANK}+$", "")


def bare_name(c: Column, mode: str = "exact") -> Column:
    """Station name without alias and suffix.

    mode="exact" removes every suffix character, also inside the name;
    mode="suffix" removes it at the end only.
    """
    head = F.substring_index(c, "(", 1)
    if mode == "exact":
        return F.trim(F.replace(head, F.lit(STATION_SUFFIX), F.lit("")))
    if mode == "suffix":
        return F.trim(F.regexp_replace(F.trim(head), f"{STATION_SUFFIX}$", ""))
    raise ValueError(f"unknown mode {mode!r}")


def station_name(c: Column, mode: str = "exact") -> Column:
    """Standard station name: bare name with exactly one suffix."""
    return F.concat(bare_name(c, mode), F.lit(STATION_SUFFIX))


def with_suffix(c: Column) -> Column:
    """Append the suffix when missing; null and empty pass through."""
    return F.when((c == "") | c.endswith(STATION_SUFFIX), c).otherwise(
        F.concat(c, F.lit(STATION_SUFFIX))
    )


def format_station(name: str | None) -> str | None:
    """The same rule for a station given as a parameter."""
    if not name or name.endswith(STATION_SUFFIX):
        return name
    return name + STATION_SUFFIX


def join_key(c: Column, collation: str | None = COLLATION) -> Column:
    """Key for joins on names: trimmed, suffix characters removed, collated."""
    key = F.replace(F.trim(c), F.lit(STATION_SUFFIX), F.lit(""))
    return F.collate(key, collation) if collation else key


def line_label(c: Column) -> Column:
    return F.trim(F.replace(c, F.lit(LINE_SUFFIX), F.lit("")))


def slot_hour(c: Column) -> Column:
    """Hour code of a slot label: 5 for "before 06", HH for "HH:00-..", 24 for "after 24"."""
    first = F.regexp_extract(c, r"(\d{1,2})", 1).try_cast("int")
    return F.when(c.contains("이전"), first - 1).otherwise(first)


def byte_view(c: Column) -> Column:
    """Bytes next to characters, to make invisible characters visible."""
    return F.struct(
        F.hex(F.encode(c, "UTF-8")).alias("hex"),
        F.octet_length(c).alias("n_bytes"),
        F.char_length(c).alias("n_chars"),
    )
