"""Wide to long, directions, peak columns and hour bins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gateflow.config import BIN_LABELS, EVENING_PEAK, HOURS, LUNCH, MORNING, SLOT_HOURS
from gateflow.functions.headers import quoted
from gateflow.functions.names import line_label, station_name
from gateflow.functions.numbers import digits_int, in_window, sum_when

ID_COLS = ("base_date", "station", "line")
PEAKS = {"peak_morning": MORNING, "peak_lunch": LUNCH, "peak_evening": EVENING_PEAK}


def unpivot_slots(
    df: DataFrame,
    id_cols: Sequence[str],
    slot_map: Mapping[str, int | str] = SLOT_HOURS,
    value: str = "value",
    slot: str = "hour",
) -> DataFrame:
    """One row per slot column, in one pass and without a shuffle.

    slot_map names the slot columns and what stands for them in the slot column.
    """
    labels = {s: str(code) for s, code in slot_map.items()}
    narrow = df.select(
        *[F.col(quoted(c)) for c in id_cols],
        *[F.col(quoted(s)).alias(code) for s, code in labels.items()],
    )
    ids = [F.col(quoted(c)) for c in id_cols]
    codes = [F.col(quoted(code)) for code in labels.values()]
    long = narrow.unpivot(ids, codes, slot, value)
    if all(isinstance(code, int) for code in slot_map.values()):
        long = long.withColumn(slot, F.col(slot).cast("int"))
    return long


def to_raw_long(
    on_df: DataFrame,
    off_df: DataFrame,
    slot_map: Mapping[str, int] = SLOT_HOURS,
    id_cols: Sequence[str] = ID_COLS,
) -> DataFrame:
    """Raw layer: boarding rows carry alighting 0 and the reverse, so a key has two rows."""

    plain = {"station": F.trim("station"), "line": line_label(F.col("line"))}
    codes = _hour_codes(slot_map)

    def one(df: DataFrame, mine: str, other: str) -> DataFrame:
        # names are made plain before a row becomes twenty
        wide = df.select(*[plain.get(c, F.col(c)).alias(c) for c in id_cols], *[F.col(quoted(s)) for s in slot_map])
        long = unpivot_slots(wide, id_cols, codes, mine)
        count = F.coalesce(F.col(mine).try_cast("bigint"), F.lit(0).cast("bigint"))
        return long.select(*id_cols, "hour", count.alias(mine), F.lit(0).cast("bigint").alias(other))

    return one(on_df, "boarding", "alighting").unionByName(one(off_df, "alighting", "boarding"))


def _hour_codes(slot_map: Mapping[str, int]) -> dict[str, str]:
    """Hour as two digits per slot column."""
    return {s: f"{int(h):02d}"[:2] for s, h in slot_map.items()}


def raw_long(
    wide: DataFrame,
    on_word: str,
    off_word: str,
    slot_map: Mapping[str, int] = SLOT_HOURS,
    id_cols: Sequence[str] = ID_COLS,
) -> DataFrame:
    """Raw layer, as to_raw_long gives it, from rows that name their direction."""
    plain = {"station": F.trim("station"), "line": line_label(F.col("line"))}
    # names are made plain before a row becomes twenty
    wide = wide.select(*[plain.get(c, F.col(c)).alias(c) for c in id_cols], "direction", *[F.col(quoted(s)) for s in slot_map])
    long = unpivot_slots(wide, [*id_cols, "direction"], _hour_codes(slot_map), "count")
    count = F.coalesce(F.col("count").try_cast("bigint"), F.lit(0).cast("bigint"))
    mine = lambda word: F.when(F.col("direction") == word, count).otherwise(F.lit(0).cast("bigint"))
    return long.select(*id_cols, "hour", mine(on_word).alias("boarding"), mine(off_word).alias("alighting"))


def peak_flags(
    df: DataFrame,
    hour: str = "hour",
    measures: Mapping[str, str] | None = None,
    windows: Mapping[str, tuple[int, int]] | None = None,
) -> DataFrame:
    """Per hour window and measure a column that keeps the count inside the window."""
    measures = measures or {"on": "on_cnt", "off": "off_cnt"}
    return df.select(
        "*",
        *[
            F.when(in_window(F.col(hour), window), F.col(measure))
            .otherwise(F.lit(0).cast("bigint"))
            .alias(f"{name}_{short}")
            for name, window in (windows or PEAKS).items()
            for short, measure in measures.items()
        ],
    )


def hourly_kpi(raw: DataFrame, mode: str = "exact") -> DataFrame:
    """Hourly mart: standard names and numbers plus peak columns, rows not aggregated."""
    base = raw.select(
        "base_date",
        station_name(F.col("station"), mode).alias("stn_name"),
        digits_int(F.col("line")).alias("line_num"),
        digits_int(F.col("hour")).alias("hour"),
        F.col("boarding").alias("on_cnt"),
        F.col("alighting").alias("off_cnt"),
    )
    return peak_flags(base)


def join_directions(
    on_long: DataFrame, off_long: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Boarding and alighting per key, for keys that occur in both.

    The delivered keys are unique per direction, so the inner join is one row
    per key. It is computed as one aggregate over both inputs, which combines
    before its only shuffle; a key delivered twice is summed and can not
    multiply rows.
    """
    both = on_long.select(*keys, F.col("on_cnt"), F.lit(None).cast("bigint").alias("off_cnt"),
                          F.lit(1).alias("_side")).unionByName(
        off_long.select(*keys, F.lit(None).cast("bigint").alias("on_cnt"), F.col("off_cnt"),
                        F.lit(2).alias("_side"))
    )
    return _in_both(both, keys, [F.sum(c).alias(c) for c in ("on_cnt", "off_cnt")])


def _in_both(both: DataFrame, keys: Sequence[str], sums: Sequence[Column]) -> DataFrame:
    grouped = both.groupBy(*keys).agg(*sums, F.bit_or("_side").alias("_sides"))
    # equality in a join never holds for null keys
    not_null = F.lit(True)
    for k in keys:
        not_null = not_null & F.col(quoted(k)).isNotNull()
    return grouped.where((F.col("_sides") == 3) & not_null).drop("_sides")


def hourly_kpi_joined(
    on_df: DataFrame,
    off_df: DataFrame,
    slot_map: Mapping[str, int] = SLOT_HOURS,
    unique: bool = False,
) -> DataFrame:
    """Hourly mart with both directions in one row per (date, station, line, hour).

    The wide rows are joined before they are unpivoted: the shuffle carries one row
    per date, station and line and side instead of twenty. Unless the keys are known
    to be unique (quality.duplicate_keys checks them), each side is summed per key
    first, which uses the partitioning of the join.
    """
    keys = list(ID_COLS)
    hours = {s: int(h) for s, h in slot_map.items()}

    def side(df: DataFrame, mark: str) -> DataFrame:
        values = {f"{mark}_{h}": F.col(quoted(s)).try_cast("bigint") for s, h in hours.items()}
        wide = df.select(*keys, *[v.alias(n) for n, v in values.items()])
        return wide if unique else wide.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in values])

    wide = side(on_df, "on").join(side(off_df, "off"), keys)
    pairs = wide.select(
        *keys,
        *[
            F.struct(F.col(f"on_{h}").alias("on_cnt"), F.col(f"off_{h}").alias("off_cnt")).alias(str(h))
            for h in hours.values()
        ],
    )
    long = pairs.unpivot(keys, [F.col(quoted(str(h))) for h in hours.values()], "hour", "pair")
    return long.select(
        "base_date",
        F.col("station").alias("stn_name"),
        F.col("line").alias("line_num"),
        F.col("hour").cast("int").alias("hour"),
        F.col("pair.on_cnt").alias("on_cnt"),
        F.col("pair.off_cnt").alias("off_cnt"),
    )


def bin_of_hour(hour: Column) -> Column:
    """Number of the two-hour bin: first and last slot alone, nine pairs between."""
    return (
        F.when(hour == HOURS[0], 0)
        .when(hour == HOURS[-1], 10)
        .otherwise(F.floor((hour - 6) / 2) + 1)
        .cast("int")
    )


def two_hour_bins(
    df: DataFrame, keys: Sequence[str], hour: str = "hour", value: str = "value"
) -> DataFrame:
    """Eleven bins per key; all are 0 when the key has fewer than twenty slots."""
    h, v = F.col(hour), F.col(value)
    slot_bits = F.bit_or(F.expr(f"shiftleft(1, {quoted(hour)})"))
    sums = [sum_when(bin_of_hour(h) == b, v).alias(str(b)) for b in range(len(BIN_LABELS))]
    grouped = df.where(h.between(HOURS[0], HOURS[-1])).groupBy(*keys).agg(
        F.bit_count(slot_bits).alias("_slots"), *sums
    )
    full = F.col("_slots") >= len(HOURS)
    bins = grouped.select(
        *keys,
        *[
            F.when(full, F.col(str(b))).otherwise(F.lit(0).cast("bigint")).alias(str(b))
            for b in range(len(BIN_LABELS))
        ],
    )
    long = bins.unpivot(
        [F.col(quoted(k)) for k in keys],
        [F.col(quoted(str(b))) for b in range(len(BIN_LABELS))],
        "bin",
        value,
    )
    labels = F.array(*[F.lit(x) for x in BIN_LABELS])
    return long.select(
        *keys,
        F.col("bin").cast("int").alias("bin"),
        F.get(labels, F.col("bin").cast("int")).alias("bin_label"),
        value,
    )
