"""SQL text for the independent oracle: domain tables and formulas in DuckDB's dialect."""

from __future__ import annotations

from emberlake import constants as K


def hr(e: str, n: int) -> str:
    """Half-up rounding of the shortest decimal form, as Spark's ``round``."""
    return f"CAST(round(CAST(({e}) AS DECIMAL(38,12)), {n}) AS DOUBLE)"


def br(e: str, n: int) -> str:
    """Half-even rounding of the shortest decimal form, as Spark's ``bround``."""
    x = f"(CAST(({e}) AS DECIMAL(30,12)) * {10**n})"
    even = f"CASE WHEN abs({x} - trunc({x})) = 0.5 THEN 2 * round({x} / 2.0, 0) ELSE round({x}, 0) END"
    return f"(CAST(({even}) AS DOUBLE) / {float(10**n)!r}::DOUBLE)"


def clip(e: str, lo: float, hi: float) -> str:
    return f"least(greatest(({e}), {lo}::DOUBLE), {hi}::DOUBLE)"


def case_map(table: dict, key: str, default: str = "NULL") -> str:
    q = lambda v: f"'{v}'" if isinstance(v, str) else f"{v!r}::DOUBLE"
    arms = " ".join(f"WHEN '{k}' THEN {q(v)}" for k, v in table.items())
    return f"(CASE {key} {arms} ELSE {default} END)"


def steps(e: str, cuts: list, names: list) -> str:
    arms = " ".join(f"WHEN {e} < {c}::DOUBLE THEN '{n}'" for c, n in zip(cuts, names))
    return f"(CASE WHEN {e} IS NULL THEN NULL {arms} ELSE '{names[len(cuts)]}' END)"


def level(e: str) -> str:
    return steps(f"({e})", K.LEVEL_CUTS, K.LEVELS)


def by_month(values: list, m: str) -> str:
    return "[" + ", ".join(f"{v}::DOUBLE" for v in values) + f"][({m})]"


def zone(lat: str, lon: str, z: str) -> str:
    return (
        f"(CASE WHEN {lat} > 57 THEN 'BWBS' WHEN {lat} > 55 AND {z} > 1200 THEN 'SWB' WHEN {lat} > 55 THEN 'BWBS'"
        f" WHEN {z} > 1800 THEN 'AT' WHEN {z} > 1400 THEN 'ESSF' WHEN {z} > 1000 AND {lon} < -124 THEN 'MH' WHEN {z} > 1000 THEN 'MS'"
        f" WHEN {lat} < 49.5::DOUBLE AND {lon} > -120 AND {z} < 600 THEN 'PP' WHEN {lat} < 49.5::DOUBLE AND {lon} > -120 THEN 'IDF'"
        f" WHEN {lon} < -125 AND {z} < 800 THEN 'CWH' WHEN {lon} < -125 THEN 'MH' WHEN {lon} < -122 AND {lat} < 49.5::DOUBLE THEN 'CDF'"
        f" WHEN {lon} < -122 THEN 'ICH' WHEN {lat} > 52 THEN 'SBS' WHEN {z} < 1200 THEN 'IDF' ELSE 'ESSF' END)"
    )


def haversine(a1: str, o1: str, a2: str, o2: str) -> str:
    h = (
        f"(pow(sin(radians({a2} - {a1}) / 2), 2) + cos(radians({a1})) * cos(radians({a2})) * pow(sin(radians({o2} - {o1}) / 2), 2))"
    )
    return f"(2 * 6371.0::DOUBLE * atan2(sqrt({h}), sqrt(1 - {h})))"


# --- moisture codes, one day ------------------------------------------------------------------------------


def m0_sql(f: str) -> str:
    return f"(147.2::DOUBLE * (101.0::DOUBLE - {f}) / (59.5::DOUBLE + {f}))"


def wet_m_sql(m0: str, r: str) -> str:
    n = f"({r} - 0.5::DOUBLE)"
    gain = f"42.5::DOUBLE * {n} * exp(-100.0::DOUBLE / greatest(251.0::DOUBLE - {m0}, 1.0::DOUBLE)) * (1 - exp(-6.93::DOUBLE / {n}))"
    extra = f"CASE WHEN {m0} > 150 THEN 0.0015::DOUBLE * pow({m0} - 150, 2) * sqrt({n}) ELSE 0 END"
    return f"(CASE WHEN {r} > 0.5::DOUBLE THEN least({m0} + {gain} + {extra}, 250.0::DOUBLE) ELSE {m0} END)"


def ed_sql(t: str, h: str, a: float, p: float, b: float) -> str:
    return (
        f"({a}::DOUBLE * pow({h}, {p}::DOUBLE) + {b}::DOUBLE * exp(({h} - 100) / 10.0::DOUBLE)"
        f" + 0.18::DOUBLE * (21.1::DOUBLE - {t}) * (1 - exp(-0.115::DOUBLE * {h})))"
    )


def rate_sql(t: str, s: str, w: str) -> str:
    return (
        f"((0.424::DOUBLE * (1 - pow({s}, 1.7::DOUBLE)) + 0.0694::DOUBLE * sqrt({w}) * (1 - pow({s}, 8)))"
        f" * 0.581::DOUBLE * exp(0.0365::DOUBLE * {t}))"
    )


def ffmc_from_m(m: str) -> str:
    return clip(f"59.5::DOUBLE * (250 - {m}) / (147.2::DOUBLE + {m})", 0, 101)


def settle_sql(m: str, ed: str, ew: str, t: str, h: str, w: str) -> str:
    kd, kw = rate_sql(t, f"({h} / 100.0::DOUBLE)", w), rate_sql(t, f"((100 - {h}) / 100.0::DOUBLE)", w)
    return (
        f"(CASE WHEN {m} > {ed} THEN {ed} + ({m} - {ed}) * pow(10.0::DOUBLE, -{kd})"
        f" WHEN {m} < {ew} THEN {ew} - ({ew} - {m}) * pow(10.0::DOUBLE, -{kw}) ELSE {m} END)"
    )


def dmc_sql(t: str, h: str, r: str, p: str, month: str) -> str:
    tt = f"(CASE WHEN {t} < 1.1::DOUBLE THEN -1.1::DOUBLE ELSE {t} END)"
    rw = f"(0.92::DOUBLE * {r} - 1.27::DOUBLE)"
    lp = f"ln(greatest({p}, 1e-10))"
    b = (
        f"(CASE WHEN {p} <= 33 THEN 100 / (0.5::DOUBLE + 0.3::DOUBLE * {p}) WHEN {p} <= 65 THEN 14 - 1.3::DOUBLE * {lp}"
        f" ELSE 6.2::DOUBLE * {lp} - 17.2::DOUBLE END)"
    )
    mr = f"(20 + exp(5.6348::DOUBLE - {p} / 43.43::DOUBLE) + 1000 * {rw} / (48.77::DOUBLE + {b} * {rw}))"
    pr = f"greatest(244.72::DOUBLE - 43.43::DOUBLE * ln(greatest({mr} - 20, 1e-10)), 0)"
    base = f"(CASE WHEN {r} > 1.5::DOUBLE THEN {pr} ELSE {p} END)"
    gain = f"(1.894::DOUBLE * ({tt} + 1.1::DOUBLE) * (100 - {h}) * {by_month(K.DAY_LENGTH, month)} * 1e-6)"
    return f"greatest({base} + 100 * {gain}, 0)"


def dc_sql(t: str, r: str, d: str, month: str) -> str:
    tt = f"(CASE WHEN {t} < 2.8::DOUBLE THEN -2.8::DOUBLE ELSE {t} END)"
    q = f"(800 * exp(-{d} / 400.0::DOUBLE) + 3.937::DOUBLE * (0.83::DOUBLE * {r} - 1.27::DOUBLE))"
    base = f"(CASE WHEN {r} > 2.8::DOUBLE THEN greatest(400 * ln(800 / greatest({q}, 1e-10)), 0) ELSE {d} END)"
    return f"greatest({base} + 0.5::DOUBLE * greatest(0.36::DOUBLE * ({tt} + 2.8::DOUBLE) + {by_month(K.DROUGHT_FACTOR, month)}, 0), 0)"


def isi_sql(w: str, f: str) -> str:
    m = m0_sql(f)
    return f"(0.208::DOUBLE * exp(0.05039::DOUBLE * {w}) * 91.9::DOUBLE * exp(-0.1386::DOUBLE * {m}) * (1 + pow({m}, 5.31::DOUBLE) / 4.93e7))"


def bui_sql(p: str, d: str) -> str:
    t = f"greatest({p} + 0.4::DOUBLE * {d}, 1e-10)"
    high = f"{p} - (1 - 0.8::DOUBLE * {d} / {t}) * (0.92::DOUBLE + pow(0.0114::DOUBLE * {p}, 1.7::DOUBLE))"
    return f"greatest(CASE WHEN {p} <= 0.4::DOUBLE * {d} THEN 0.8::DOUBLE * {p} * {d} / {t} ELSE {high} END, 0)"


def fwi_sql(i: str, b: str) -> str:
    fuel = (
        f"(CASE WHEN {b} <= 80 THEN 0.626::DOUBLE * pow({b}, 0.809::DOUBLE) + 2 ELSE 1000 / (25 + 108.64::DOUBLE * exp(-0.023::DOUBLE * {b})) END)"
    )
    bb = f"(0.1::DOUBLE * {i} * {fuel})"
    return f"(CASE WHEN {bb} <= 1 THEN {bb} ELSE exp(2.72::DOUBLE * pow(0.434::DOUBLE * ln(greatest({bb}, 1e-10)), 0.647::DOUBLE)) END)"


def one_step(source: str, keep: str, t="t", h="h", w="w", r="r", f="f0", p="p0", d="d0", month="mon") -> str:
    """Rows of ``source`` with ffmc, dmc, dc after one day (nested so that values are named once)."""
    a = f"SELECT *, {m0_sql(f)} AS _m0, {ed_sql(t, h, 0.942, 0.679, 11.0)} AS _ed, {ed_sql(t, h, 0.618, 0.753, 10.0)} AS _ew FROM ({source})"
    b = f"SELECT *, {wet_m_sql('_m0', r)} AS _m1 FROM ({a})"
    c = f"SELECT *, {settle_sql('_m1', '_ed', '_ew', t, h, w)} AS _m2 FROM ({b})"
    return f"SELECT {keep}, {ffmc_from_m('_m2')} AS ffmc, {dmc_sql(t, h, r, p, month)} AS dmc, {dc_sql(t, r, d, month)} AS dc FROM ({c})"


def with_spread(source: str, keep: str = "*", w: str = "w") -> str:
    a = f"SELECT *, {isi_sql(w, 'ffmc')} AS isi, {bui_sql('dmc', 'dc')} AS bui FROM ({source})"
    return f"SELECT {keep}, {fwi_sql('isi', 'bui')} AS fwi FROM ({a})"


def heuristic(t: str, soil: str, w: str, fwi: str) -> str:
    return clip(
        f"0.3::DOUBLE * {clip(f'({t} - 10) / 30.0::DOUBLE', 0, 1)} + 0.3::DOUBLE * {clip(f'1 - {soil} / 0.5::DOUBLE', 0, 1)}"
        f" + 0.15::DOUBLE * {clip(f'{w} / 40.0::DOUBLE', 0, 1)} + 0.25::DOUBLE * {clip(f'{fwi} / 40.0::DOUBLE', 0, 1)}",
        0,
        1,
    )


def logit(p: str) -> str:
    b = clip(p, 1e-7, 1 - 1e-7)
    return f"ln({b} / (1 - {b}))"
