"""Fire weather codes as column expressions.

A code's update splits into terms that depend on the day's weather only and a
short rest that depends on the code of the day before. ``day_terms`` gives the
first part; it is projected in generated code for all days at once. ``next_*``
apply the rest and are all that the ordered fold has to evaluate step by step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.constants import DAY_LENGTH, DIURNAL_BASE, DROUGHT_FACTOR
from emberlake.functions.base import clip, inline_value

TERMS = ["wet_gain", "wet_extra", "dry_to", "wet_to", "dry_keep", "wet_keep", "dmc_net", "dmc_gain", "dc_wet", "dc_gain"]


def _by_month(values: list[float], month: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), month.cast("int"))


def _moisture(ffmc: Column) -> Column:
    return 147.2 * (101.0 - ffmc) / (59.5 + ffmc)


def day_terms(temp: Column, rh: Column, wind: Column, rain: Column, month: Column) -> dict[str, Column]:
    """What a day does to the codes, whatever they were. Rain terms are null on dry days."""
    net = rain - 0.5
    thermal = 0.18 * (21.1 - temp) * (1.0 - F.exp(-0.115 * rh))
    humid = F.exp((rh - 100.0) / 10.0)

    def keep(share: Column) -> Column:
        still = 0.424 * (1.0 - F.pow(share, F.lit(1.7)))
        blown = 0.0694 * F.sqrt(wind) * (1.0 - F.pow(share, F.lit(8.0)))
        return F.pow(F.lit(10.0), -((still + blown) * 0.581 * F.exp(0.0365 * temp)))

    warm_dmc = F.when(temp < 1.1, F.lit(-1.1)).otherwise(temp)
    warm_dc = F.when(temp < 2.8, F.lit(-2.8)).otherwise(temp)
    return {
        "wet_gain": F.when(rain > 0.5, 42.5 * net * (1.0 - F.exp(-6.93 / net))),
        "wet_extra": F.when(rain > 0.5, 0.0015 * F.sqrt(net)),
        "dry_to": 0.942 * F.pow(rh, F.lit(0.679)) + 11.0 * humid + thermal,
        "wet_to": 0.618 * F.pow(rh, F.lit(0.753)) + 10.0 * humid + thermal,
        "dry_keep": keep(rh / 100.0),
        "wet_keep": keep((100.0 - rh) / 100.0),
        "dmc_net": F.when(rain > 1.5, 0.92 * rain - 1.27),
        "dmc_gain": 100.0 * (1.894 * (warm_dmc + 1.1) * (100.0 - rh) * _by_month(DAY_LENGTH, month) * 1e-6),
        "dc_wet": F.when(rain > 2.8, 3.937 * (0.83 * rain - 1.27)),
        "dc_gain": 0.5 * F.greatest(0.36 * (warm_dc + 2.8) + _by_month(DROUGHT_FACTOR, month), F.lit(0.0)),
    }


def _rained(m: Column, gain: Column, extra: Column) -> Column:
    above = F.greatest(m - 150.0, F.lit(0.0))
    wet = m + gain * F.exp(-100.0 / F.greatest(251.0 - m, F.lit(1.0))) + above * above * extra
    return F.when(gain.isNotNull(), F.least(wet, F.lit(250.0))).otherwise(m)


def _settled(m: Column, term) -> Column:
    dry, wet = term["dry_to"], term["wet_to"]
    return (
        F.when(m > dry, dry + (m - dry) * term["dry_keep"])
        .when(m < wet, wet - (wet - m) * term["wet_keep"])
        .otherwise(m)
    )


def _code(m: Column) -> Column:
    return clip(59.5 * (250.0 - m) / (147.2 + m), 0.0, 101.0)


def next_ffmc(previous: Column, term, bind=inline_value) -> Column:
    """M08 from the day's terms."""
    rained = bind(_moisture(previous), lambda m: _rained(m, term["wet_gain"], term["wet_extra"]))
    return bind(bind(rained, lambda m: _settled(m, term)), _code)


def next_dmc(previous: Column, term, bind=inline_value) -> Column:
    """M09 from the day's terms."""
    net = term["dmc_net"]
    log_code = F.log(F.greatest(previous, F.lit(1e-10)))
    slope = (
        F.when(previous <= 33.0, 100.0 / (0.5 + 0.3 * previous))
        .when(previous <= 65.0, 14.0 - 1.3 * log_code)
        .otherwise(6.2 * log_code - 17.2)
    )
    content = 20.0 + F.exp(5.6348 - previous / 43.43) + 1000.0 * net / (48.77 + slope * net)
    wetted = F.greatest(244.72 - 43.43 * F.log(F.greatest(content - 20.0, F.lit(1e-10))), F.lit(0.0))
    base = F.when(net.isNotNull(), wetted).otherwise(previous)
    return bind(base + term["dmc_gain"], lambda v: F.when(v.isNotNull(), F.greatest(v, F.lit(0.0))))


def next_dc(previous: Column, term, bind=inline_value) -> Column:
    """M10 from the day's terms."""
    stored = 800.0 * F.exp(-previous / 400.0) + term["dc_wet"]
    wetted = F.greatest(400.0 * F.log(800.0 / F.greatest(stored, F.lit(1e-10))), F.lit(0.0))
    base = F.when(term["dc_wet"].isNotNull(), wetted).otherwise(previous)
    return bind(base + term["dc_gain"], lambda v: F.when(v.isNotNull(), F.greatest(v, F.lit(0.0))))


def ffmc(temp: Column, rh: Column, wind: Column, rain: Column, previous: Column) -> Column:
    """Fine Fuel Moisture Code after one day."""
    return next_ffmc(previous, day_terms(temp, rh, wind, rain, F.lit(1)))


def dmc(temp: Column, rh: Column, rain: Column, previous: Column, month: Column) -> Column:
    """Duff Moisture Code after one day."""
    return next_dmc(previous, day_terms(temp, rh, F.lit(0.0), rain, month))


def dc(temp: Column, rain: Column, previous: Column, month: Column) -> Column:
    """Drought Code after one day."""
    return next_dc(previous, day_terms(temp, F.lit(50.0), F.lit(0.0), rain, month))


def day_columns(df: DataFrame, previous: dict[str, Column], month: Column) -> DataFrame:
    """M08-M13 on a frame with the weather columns: adds all six codes.

    Built in a few projections, so that each intermediate value is a column that is
    computed once and not an expression repeated wherever it is used.
    """
    t, h, w, r = (F.col(c) for c in ("temperature_c", "rh_pct", "wind_kmh", "precip_24h_mm"))
    terms = {f"_t_{n}": c for n, c in day_terms(t, h, w, r, month).items()}
    at = {n: F.col(f"_t_{n}") for n in TERMS}
    staged = df.withColumns({**terms, "_m0": _moisture(previous["ffmc"]), "_p0": previous["dmc"], "_d0": previous["dc"]})
    staged = staged.withColumn("_m1", _rained(F.col("_m0"), at["wet_gain"], at["wet_extra"]))
    staged = staged.withColumn("_m2", _settled(F.col("_m1"), at))
    coded = staged.withColumns({"ffmc": _code(F.col("_m2")), "dmc": next_dmc(F.col("_p0"), at), "dc": next_dc(F.col("_d0"), at)})
    return spread_columns(coded.drop(*terms, "_m0", "_m1", "_m2", "_p0", "_d0"))


def isi(wind: Column, ffmc_code: Column) -> Column:
    """Initial Spread Index."""
    return _isi(wind, _moisture(ffmc_code))


def _isi(wind: Column, m: Column) -> Column:
    return 0.208 * F.exp(0.05039 * wind) * 91.9 * F.exp(-0.1386 * m) * (1.0 + F.pow(m, F.lit(5.31)) / 4.93e7)


def bui(dmc_code: Column, dc_code: Column) -> Column:
    """Build-Up Index."""
    total = F.greatest(dmc_code + 0.4 * dc_code, F.lit(1e-10))
    high = dmc_code - (1.0 - 0.8 * dc_code / total) * (0.92 + F.pow(0.0114 * dmc_code, F.lit(1.7)))
    value = F.when(dmc_code <= 0.4 * dc_code, 0.8 * dmc_code * dc_code / total).otherwise(high)
    return F.when(value.isNotNull(), F.greatest(value, F.lit(0.0)))


def fwi(isi_code: Column, bui_code: Column) -> Column:
    """Fire Weather Index."""
    fuel = F.when(bui_code <= 80.0, 0.626 * F.pow(bui_code, F.lit(0.809)) + 2.0).otherwise(
        1000.0 / (25.0 + 108.64 * F.exp(-0.023 * bui_code))
    )
    b = 0.1 * isi_code * fuel
    return F.when(b <= 1.0, b).otherwise(
        F.exp(2.72 * F.pow(0.434 * F.log(F.greatest(b, F.lit(1e-10))), F.lit(0.647)))
    )


def spread_columns(df, wind: str = "wind_kmh"):
    """Add isi, bui and fwi to a frame that holds ffmc, dmc and dc."""
    coded = df.withColumns({"_m": _moisture(F.col("ffmc")), "bui": bui(F.col("dmc"), F.col("dc"))})
    coded = coded.withColumn("isi", _isi(F.col(wind), F.col("_m"))).drop("_m")
    return coded.withColumn("fwi", fwi(F.col("isi"), F.col("bui")))


def diurnal_ffmc(ffmc_code: Column, temp: Column, rh: Column, hour: Column | int) -> Column:
    """FFMC at an hour of day; an hour outside 0..23 is an error."""
    if isinstance(hour, int):
        if not 0 <= hour <= 23:
            raise ValueError(f"hour must be in [0, 23], got {hour}")
        base = F.lit(DIURNAL_BASE[hour])
    else:
        base = F.element_at(F.array(*[F.lit(v) for v in DIURNAL_BASE]), hour.cast("int") + 1)
    amplifier = F.greatest((1.0 + 0.03 * (temp - 20.0)) * (1.0 + 0.012 * (40.0 - rh)), F.lit(0.1))
    return clip(ffmc_code + base * amplifier, 0.0, 101.0)


def apply_diurnal(df, hour: Column | int = 14):
    """Replace ffmc, isi and fwi by their diurnal values.

    dmc, dc and bui are daily and stay; the carried state is a separate table.
    """
    adjusted = df.withColumn("ffmc", diurnal_ffmc(F.col("ffmc"), F.col("temperature_c"), F.col("rh_pct"), hour))
    adjusted = adjusted.withColumn("isi", isi(F.col("wind_kmh"), F.col("ffmc")))
    return adjusted.withColumn("fwi", fwi(F.col("isi"), F.col("bui")))
