"""Ordered recurrences, as-of joins and lags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.constants import FORECAST_FEED_DEFAULTS, START_CODES
from emberlake.functions import fwi as codes
from emberlake.functions.base import bound_value
from emberlake.functions.score import confidence, danger_level, danger_ordinal, heuristic_forecast_score
from emberlake.operators.skew import dealt

STATE = ["ffmc", "dmc", "dc"]
DRIVERS = ["temperature_c", "rh_pct", "wind_kmh", "precip_24h_mm"]


def start_state() -> Column:
    return F.struct(*[F.lit(START_CODES[c]).alias(c) for c in STATE])


def seed_state(cells: DataFrame, snapshot: DataFrame, key: str = "cell_id") -> DataFrame:
    """Every cell with its carried codes, or the starting ones."""
    held = snapshot.select(key, *STATE)
    return cells.select(key).join(held, key, "left").fillna(START_CODES)


def _advance(state: Column, day: Column, carry: Sequence[str], round_state: bool) -> Column:
    """One day's struct from the previous day's."""
    parts = {
        "ffmc": codes.next_ffmc(state["ffmc"], day, bound_value),
        "dmc": codes.next_dmc(state["dmc"], day, bound_value),
        "dc": codes.next_dc(state["dc"], day, bound_value),
    }
    if round_state:
        parts = {name: F.bround(value, 1) for name, value in parts.items()}
    return F.struct(*[day[c].alias(c) for c in carry], *[v.alias(n) for n, v in parts.items()])


def fold_codes(
    weather: DataFrame,
    key: str = "cell_id",
    order: str = "date",
    month: Column | None = None,
    seed: DataFrame | None = None,
    reset: str = "season",
    carry: Sequence[str] = (),
    round_state: bool = False,
    consecutive_from: int | None = None,
    start: str | None = None,
    placed: bool = False,
) -> DataFrame:
    """Roll the moisture codes forward over the ordered days of each cell.

    One row per (key, order) is required (see ``daily_mean``), so a group is as
    long as the calendar, not as the data. ``reset`` starts the codes anew each
    ``season`` (calendar year), each ``month``, or never (``none``); ``seed`` gives
    the first state of a cell, or the column ``start`` where the rows have it. Rows that lie with their
    key already are ``placed`` and not moved again. With ``consecutive_from`` an integer ``order`` must
    run n, n+1, ... and the fold stops at the first gap (W03).

    All grouping happens after one exchange on the key, which moves the weather
    only; what each day does to the codes is worked out behind it in generated code,
    so the interpreted fold evaluates just the part that depends on the day before.
    Days are folded inside months and months inside cells, which keeps appending
    cheap however long the history is.
    """
    month = F.month(order) if month is None else month
    fields = [order, *DRIVERS, *[c for c in carry if c not in DRIVERS and c != order]]
    if reset == "season":
        span = F.year(order)
    elif reset == "month":
        span = F.year(order) * 100 + F.month(order)
    else:
        span = F.lit(0)
    part = F.year(order) * 100 + F.month(order) if consecutive_from is None else F.lit(0)
    given = [] if start is None else [F.coalesce(start, start_state()).alias("_start")]
    days = weather.select(key, *fields, month.cast("int").alias("_month"), span.alias("_span"), part.alias("_part"), *given)
    if seed is not None:
        first_codes = seed.select(key, F.struct(*STATE).alias("_start"))
        days = days.join(first_codes, key, "left").withColumn("_start", F.coalesce("_start", start_state()))
    elif start is None:
        days = days.withColumn("_start", start_state())
    terms = codes.day_terms(*[F.col(c) for c in DRIVERS], F.col("_month"))
    inner = F.struct(*fields, *codes.TERMS)
    months = (
        (days if placed else days.repartition(key))
        .withColumns(terms)
        .groupBy(key, "_span", "_part")
        .agg(F.array_sort(F.collect_list(inner)).alias("_days"), F.first("_start").alias("_start"))
    )
    seasons = months.groupBy(key, "_span").agg(
        F.array_sort(F.collect_list(F.struct("_part", "_days"))).alias("_months"), F.first("_start").alias("_start")
    )
    out_fields = [c for c in fields]

    def one_month(done: Column, block: Column) -> Column:
        day_list = block["_days"]
        if consecutive_from is not None:
            day_list = F.filter(day_list, lambda d, i: d[order] == i + consecutive_from)
        rolled = F.aggregate(
            day_list,
            F.slice(done, -1, 1),
            lambda acc, day: F.concat(
                acc, F.array(_advance(F.element_at(acc, -1), day, out_fields, round_state))
            ),
        )
        return F.concat(done, F.filter(rolled, lambda _, i: i > 0))

    schema = weather.select(*fields).schema
    blank = [F.lit(None).cast(schema[c].dataType).alias(c) for c in fields]
    first = F.array(F.struct(*blank, *[F.col(f"_start.{c}").alias(c) for c in STATE]))
    rolled = seasons.select(key, F.aggregate("_months", first, one_month).alias("_rolled"))
    rows = rolled.select(key, F.inline(F.filter("_rolled", lambda _, i: i > 0)))
    return codes.spread_columns(rows)


def final_state(rolled: DataFrame, key: str = "cell_id", order: str = "date") -> DataFrame:
    """The carried codes after each cell's last day."""
    last = rolled.groupBy(key).agg(F.max_by(F.struct(F.col(order).alias("as_of"), *STATE), order).alias("s"))
    return last.select(key, "s.*")


def one_day(weather: DataFrame, state: DataFrame, key: str = "cell_id") -> DataFrame:
    """The daily step: new codes of every cell from its carried ones, all in one projection."""
    seeded = weather.join(state.select(key, *[F.col(c).alias(f"_{c}") for c in STATE]), key, "left").fillna(
        {f"_{c}": START_CODES[c] for c in STATE}
    )
    return codes.day_columns(seeded, {c: F.col(f"_{c}") for c in STATE}, F.month("date")).drop(*[f"_{c}" for c in STATE])


def forecast_roll(
    weather: DataFrame,
    base_date: str,
    seed: DataFrame | None = None,
    observed_soil: DataFrame | None = None,
    max_days: int = 10,
    key: str = "cell_id",
) -> DataFrame:
    """Risk for lead days 1..n, up to the first missing day.

    Weather nulls take the feed's defaults; soil moisture takes the forecast
    value, else the observed one, else the default.
    """
    soils = [c for c in FORECAST_FEED_DEFAULTS if c.startswith("soil_")]
    feed = weather.where(F.col("lead_day").between(1, max_days))
    if observed_soil is not None:
        seen = observed_soil.select(key, *[F.col(c).alias(f"_{c}") for c in soils])
        feed = feed.join(seen, key, "left").withColumns({c: F.coalesce(c, f"_{c}") for c in soils}).drop(*[f"_{c}" for c in soils])
    feed = feed.fillna(FORECAST_FEED_DEFAULTS)
    valid = F.date_add(F.lit(base_date).cast("date"), F.col("lead_day"))
    rolled = fold_codes(
        feed,
        key=key,
        order="lead_day",
        month=F.month(valid),
        seed=seed,
        reset="none",
        carry=[*DRIVERS, "wind_dir_deg", "evapotrans_mm", *soils],
        consecutive_from=1,
    )
    scored = rolled.withColumns({"base_date": F.lit(base_date).cast("date"), "valid_date": valid, "confidence": confidence(F.col("lead_day"))})
    scored = scored.withColumn(
        "risk_score", heuristic_forecast_score(F.col("temperature_c"), F.col("fwi")) * F.col("confidence")
    )
    level = danger_level(F.col("risk_score"))
    return scored.withColumns(
        {
            "danger_label": level,
            "danger_level": danger_ordinal(level),
            "data_source": F.when(F.col("lead_day") <= 2, "GEM").otherwise("GEM_GLOBAL"),
        }
    )


def forecast_record(rolled: DataFrame, key: str = "cell_id") -> DataFrame:
    """The forecast's stored rounding."""
    places = {"ffmc": 1, "dmc": 1, "dc": 1, "isi": 2, "bui": 1, "fwi": 2, "temperature_c": 1, "rh_pct": 1, "wind_kmh": 0, "precip_24h_mm": 1}
    return rolled.select(
        key,
        "base_date",
        "lead_day",
        "valid_date",
        F.bround("risk_score", 4).alias("risk_score"),
        "danger_level",
        "danger_label",
        F.bround("confidence", 4).alias("confidence"),
        "data_source",
        *[F.bround(c, n).alias(c) for c, n in places.items()],
    )


# --- daily aggregates -----------------------------------------------------------------------------------


def daily_mean(steps: DataFrame, values: Sequence[str], key: str = "cell_id", ts: str = "ts", more: Sequence[Column] = ()) -> DataFrame:
    """A10: sub-daily steps to one mean row per (key, date), with ``more`` aggregates beside the means."""
    return steps.groupBy(key, F.to_date(ts).alias("date")).agg(*[F.avg(c).alias(c) for c in values], *more)


def hourly_to_daily(hourly: DataFrame, keys: Sequence[str], hour: str) -> DataFrame:
    """T max, RH min, wind max, direction at the first hour of maximum wind, rain sum."""
    windiest = F.max_by("wind_dir_deg", F.struct("wind_ms", -F.col(hour)))
    day = hourly.groupBy(*keys).agg(
        (F.max("temperature_k") - 273.15).alias("temperature_c"),
        F.min("rh_pct").alias("rh_pct"),
        (F.max("wind_ms") * 3.6).alias("wind_kmh"),
        windiest.alias("wind_dir_deg"),
        F.greatest(F.sum("precip_mm"), F.lit(0.0)).alias("precip_24h_mm"),
    )
    return day.fillna(
        {"temperature_c": 20.0, "rh_pct": 50.0, "wind_kmh": 10.0, "wind_dir_deg": 225.0, "precip_24h_mm": 0.0}
    )


def lead_day_of(hour: Column) -> Column:
    """Forecast hours 1..24 are day 1, 25..48 day 2, and so on; hour 0 is the analysis, not a day."""
    return F.when(hour >= 1, F.ceil(hour / 24.0).cast("int"))


def by_source_precedence(daily: DataFrame, key: str = "cell_id", fine: str = "HRDPS", fine_days: int = 2) -> DataFrame:
    """The fine model owns the first days, the global model the rest, up to day 10."""
    wanted = F.when(F.col("lead_day") <= fine_days, F.col("source") == fine).otherwise(F.col("source") != fine)
    return daily.where(wanted & F.col("lead_day").between(1, 10))


def afternoon_mean(levels: DataFrame, values: Sequence[str], key: str = "cell_id", ts: str = "ts") -> DataFrame:
    """Mean over 12..18 UTC inclusive, nulls skipped per variable."""
    picked = levels.where(F.hour(ts).between(12, 18))
    return picked.groupBy(key, F.to_date(ts).alias("date")).agg(*[F.avg(c).alias(c) for c in values])


def trailing_flashes(ticks: DataFrame, end: Column, key: str = "cell_id", ts: str = "ts") -> DataFrame:
    """Flashes in the 24 h and 72 h before ``end`` (exclusive), in one scan.

    Nodata (<= -999) and negative counts are 0.
    """
    flashes = F.greatest(F.col("flashes"), F.lit(0.0))
    in_window = lambda hours: (F.col(ts) >= end - F.expr(f"INTERVAL {hours} HOURS")) & (F.col(ts) < end)
    return (
        ticks.where(in_window(72))
        .groupBy(key)
        .agg(
            F.sum(F.when(in_window(24), flashes).otherwise(0.0)).alias("lightning_24h"),
            F.sum(flashes).alias("lightning_72h"),
        )
    )


def daily_flashes(ticks: DataFrame, key: str = "cell_id", ts: str = "ts") -> DataFrame:
    """A11 for every day: trailing 24 h and 72 h windows that end at each midnight.

    A tick belongs to the days its windows end on, so each row is spread over
    three days and combined before the shuffle.
    """
    flashes = F.greatest(F.col("flashes"), F.lit(0.0))
    spread = ticks.select(
        key, F.to_date(ts).alias("_d"), flashes.alias("_f"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("_ago")
    )
    return spread.groupBy(key, F.date_add("_d", F.col("_ago")).alias("date")).agg(
        F.sum(F.when(F.col("_ago") == 0, F.col("_f")).otherwise(0.0)).alias("lightning_24h"),
        F.sum("_f").alias("lightning_72h"),
    )


# --- as-of joins ------------------------------------------------------------------------------------------


def as_of(
    wanted: DataFrame,
    history: DataFrame,
    values: Sequence[str],
    days: int,
    key: str = "cell_id",
    include_same_day: bool = True,
    defaults: Mapping[str, object] | None = None,
    found_date: str = "as_of",
    ranges: int = 8,
) -> DataFrame:
    """The newest history row at most ``days`` old, for every (key, date).

    Time is cut into ranges ``ranges`` times as long as the tolerance. History is combined to a row per
    key and day, and offered once more to the next range if it is still young enough at its
    start (one row in ``ranges`` or so). Inside a range the wanted days and the history are
    read in order with the last history carried along, so a window holds a key's days of
    one range. Wanted days are taken once each; the rows meet their day's answer in an equi-join, which
    the adaptive join splits where one day is asked for very often.
    """
    span = max(days, 1) * ranges
    epoch = F.unix_date("date")
    hit = F.struct(F.col("date").alias("_seen"), *values)
    offers = history.where(F.col("date").isNotNull()).groupBy(key, "date").agg(F.max_by(F.struct(*values), "date").alias("_v")).select(key, "date", "_v.*")
    place = F.floor(epoch / span).cast("int")
    last_range = F.floor((epoch + days) / span).cast("int")
    offers = offers.select(key, "date", hit.alias("_offer"), F.explode(F.sequence(place, last_range)).alias("_range"))
    asked = wanted.where(F.col(key).isNotNull() & F.col("date").isNotNull()).select(key, "date").distinct()
    asked = asked.select(key, "date", F.lit(None).cast(offers.schema["_offer"].dataType).alias("_offer"), place.alias("_range"))
    both = asked.withColumn("_turn", F.lit(0 if not include_same_day else 1)).unionByName(offers.withColumn("_turn", F.lit(1 if not include_same_day else 0)))
    in_order = Window.partitionBy(key, "_range").orderBy("date", "_turn").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("_hit", F.last("_offer", ignorenulls=True).over(in_order)).where(F.col("_offer").isNull())
    young = F.when(F.col("_hit")["_seen"] >= F.date_sub("date", days), F.col("_hit"))
    answers = carried.select(key, "date", young.alias("_hit"))
    joined = wanted.join(answers, [key, "date"], "left")
    out = joined.withColumns({found_date: F.col("_hit._seen"), **{c: F.col(f"_hit.{c}") for c in values}}).drop("_hit")
    return out.fillna(dict(defaults)) if defaults else out


def merge_missing(primary: DataFrame, other: DataFrame, columns: Sequence[str], keys: Sequence[str], label: str) -> DataFrame:
    """Fill null columns from another source and say where each came from."""
    side = other.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = primary.join(side, list(keys), "left")
    taken = F.when(F.col(columns[0]).isNotNull(), F.lit("primary")).when(F.col(f"_{columns[0]}").isNotNull(), F.lit(label)).otherwise(F.lit("default"))
    return joined.withColumn("soil_source", taken).withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop(*[f"_{c}" for c in columns])


def change_24h(history: DataFrame, key: str = "cell_id") -> DataFrame:
    """Score minus the score of exactly one calendar day earlier, else null."""
    yesterday = history.select(key, F.date_add("date", 1).alias("date"), F.col("score").alias("_before"))
    joined = history.join(dealt(yesterday), [key, "date"], "left")
    return joined.withColumn("change_24h", F.bround(F.col("score") - F.col("_before"), 4)).drop("_before")


def velocity(history: DataFrame, key: str = "cell_id") -> DataFrame:
    """3- and 7-step change in percent at each cell's newest row.

    Three steps need 4 rows; seven steps need 7 rows and reach back 7 rows, or 6
    when there are exactly 7. Steps are rows, not calendar days.
    """
    by_day = Window.partitionBy(key).orderBy("date")
    stepped = history.select(
        key,
        "date",
        "score",
        F.row_number().over(by_day).alias("rows"),
        F.lag("score", 3).over(by_day).alias("_p3"),
        F.coalesce(F.lag("score", 7).over(by_day), F.lag("score", 6).over(by_day)).alias("_p7"),
    )
    change = lambda p: F.when(F.col(p) > 0, F.bround((F.col("score") - F.col(p)) / F.nullif(F.col(p), F.lit(0.0)) * 100.0, 1))
    newest = stepped.groupBy(key).agg(F.max_by(F.struct("rows", "score", "_p3", "_p7"), "date").alias("s"))
    return newest.select(key, "s.*").select(
        key,
        F.col("rows").alias("days_analyzed"),
        F.when(F.col("rows") >= 4, change("_p3")).alias("velocity_3day_pct"),
        F.when(F.col("rows") >= 7, change("_p7")).alias("velocity_7day_pct"),
    )


def usage_per_day(requests: DataFrame, key: str = "api_key", ts: str = "ts", limit: Column | int = 50) -> DataFrame:
    """Requests per key and Pacific day against a daily limit."""
    cap = F.lit(limit) if isinstance(limit, int) else limit
    day = F.to_date(F.from_utc_timestamp(F.col(ts), "America/Vancouver"))
    used = requests.groupBy(key, day.alias("day")).agg(F.count(F.lit(1)).alias("used"))
    return used.withColumns(
        {"remaining": F.greatest(cap - F.col("used"), F.lit(0)), "exceeded": F.col("used") > cap}
    )


