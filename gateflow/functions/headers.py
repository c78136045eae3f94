"""Rules on column names; they see names only, never rows."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from gateflow.config import HOURS, KEY_WORDS, NOT_A_SLOT


def quoted(name: str) -> str:
    """Column name for F.col, also when it holds dots, colons or blanks."""
    return "`" + name.replace("`", "``") + "`"


def strip_name(name: str, strip: str = "ends") -> str:
    if strip == "ends":
        return name.strip()
    if strip == "all":
        return name.replace(" ", "")
    raise ValueError(f"unknown strip {strip!r}")


def distinct_names(names: Sequence[str]) -> list[str]:
    """Blank names get a place number, repeated names a running number."""
    seen: dict[str, int] = {}
    out = []
    for place, name in enumerate(names):
        name = name or f"Unnamed: {place}"
        n = seen.get(name, 0)
        seen[name] = n + 1
        out.append(f"{name}.{n}" if n else name)
    return out


def slot_columns(names: Iterable[str], rule: str = "clock") -> list[str]:
    """Hour-slot columns, in order.

    colon: the name holds ':'; digit: a digit and none of the key words;
    clock: a digit, ':' or '~' and no total, date or number word.
    """
    signs = {"colon": ":", "digit": r"\d", "clock": "[0-9:~]"}
    if rule not in signs:
        raise ValueError(f"unknown rule {rule!r}")
    excluded = NOT_A_SLOT.get(rule, ())
    return [
        n
        for n in names
        if re.search(signs[rule], n) and not any(word in n for word in excluded)
    ]


def key_columns(names: Sequence[str], words: dict[str, str] = KEY_WORDS) -> dict[str, str | None]:
    """First column whose name holds the word, per role."""
    return {role: next((n for n in names if word in n), None) for role, word in words.items()}


def hour_code(label: str) -> int | None:
    """Hour code of a slot label, as functions.names.slot_hour gives it for data."""
    found = re.search(r"\d{1,2}", label)
    if not found:
        return None
    return int(found.group()) - ("이전" in label)


def slot_map(slots: Sequence[str]) -> dict[str, int]:
    """Slot column -> hour code, by label; by position when a label does not tell."""
    codes = [hour_code(s) for s in slots]
    if None in codes or len(set(codes)) < len(codes):
        codes = list(HOURS[: len(slots)])
    return dict(zip(slots, codes))
