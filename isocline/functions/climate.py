"""Climate expressions over arrays of twelve months (January first), as Column functions.

Missing values are null; a null month makes a sum or mean of its months null, as only `complete` tells.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Days of the months, seasons (from December), summer halves.
DAYS = (31.0, 28.25, 31.0, 30.0, 31.0, 30.0, 31.0, 31.0, 30.0, 31.0, 30.0, 31.0)
SEASONS = ((12, 1, 2), (3, 4, 5), (6, 7, 8), (9, 10, 11))
APRIL_SEPTEMBER, OCTOBER_MARCH = (4, 5, 6, 7, 8, 9), (10, 11, 12, 1, 2, 3)
# Coefficients of the hardiness and frost-free estimators.
HARDINESS = (-10.47579, 1.38707, 0.06059, -0.2836)
FROST_FREE = (4.5625, 7.3276)
MIDS = tuple(sum(DAYS[: k + 1]) - DAYS[k] / 2 for k in range(12))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def each(*arrays: Column) -> Callable:
    """each(a, b)(f): f(month number from 0, a's month, b's month) for the twelve months."""
    return lambda f: F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: f(i, *[F.get(a, i) for a in arrays]))


def months(array: Column, numbers: Sequence[int]) -> Column:
    return F.array(*[F.get(array, F.lit(m - 1)) for m in numbers])


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, x: s + x)


def mean(array: Column) -> Column:
    return total(array) / F.size(array)


def sample_sd(array: Column) -> Column:
    m = mean(array)
    return F.sqrt(F.aggregate(array, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / (F.size(array) - 1))


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution function by the rational approximation 26.2.17 of Abramowitz and Stegun (error below 7.5e-8)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    tail = 0.3989422804014327 * F.exp(-z * z / 2) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def sat_vap(t: Column) -> Column:
    """Saturation vapour pressure in kPa."""
    return 0.61094 * F.exp(17.625 * t / (t + 243.04))


def dewpoint(e: Column) -> Column:
    x = F.log(F.greatest(e, F.lit(1e-4)) / 0.61094)
    return 243.04 * x / (17.625 - x)


def radiation_factors(k: int) -> tuple[float, float]:
    """Relative distance to the sun and its declination at mid-month."""
    j = MIDS[k]
    return 1 + 0.033 * math.cos(2 * math.pi * j / 365), 0.409 * math.sin(2 * math.pi * j / 365 - 1.39)


def hargreaves_pet(tmax: Column, tmin: Column, lat: Column) -> Column:
    """Monthly potential evapotranspiration in mm, an array."""
    phi = F.radians(lat)
    out = []
    for k in range(12):
        near, tilt = radiation_factors(k)
        angle = F.acos(clip(-F.tan(phi) * math.tan(tilt), -1, 1))
        ra = (24 * 60 / math.pi) * 0.0820 * near * (angle * F.sin(phi) * math.sin(tilt) + F.cos(phi) * math.cos(tilt) * F.sin(angle))
        tx, tn = F.get(tmax, F.lit(k)), F.get(tmin, F.lit(k))
        out.append(0.0023 * F.greatest(ra, F.lit(0.0)) / 2.45 * F.greatest((tx + tn) / 2 + 17.8, F.lit(0.0)) * F.sqrt(F.greatest(tx - tn, F.lit(0.1))) * DAYS[k])
    return F.array(*out)


def seasonal(tmax: Column, tmin: Column, ppt: Column, vap: Column) -> Column:
    """The 16 seasonal values: mean highs, mean lows, rain sums, dewpoints of mean vapour pressure."""
    return F.array(
        *[mean(months(tmax, s)) for s in SEASONS],
        *[mean(months(tmin, s)) for s in SEASONS],
        *[total(months(ppt, s)) for s in SEASONS],
        *[dewpoint(mean(months(vap, s))) for s in SEASONS],
    )


def metric_space(vector: Column) -> Column:
    """Rain (values 8 to 11) as ln(mm + 1), the rest as it is."""
    return F.transform(vector, lambda x, i: F.when((i >= 8) & (i < 12), F.log(F.greatest(x, F.lit(0.0)) + 1)).otherwise(x))


def encoded(vector: Column) -> Column:
    """The vector as short integers: temperatures by 100, logarithms of rain by 1000, null as 0; half to even."""
    return F.transform(metric_space(vector), lambda x, i: F.coalesce(F.rint(x * F.when((i >= 8) & (i < 12), 1000).otherwise(100)), F.lit(0.0)).cast("short"))


def ratio(after: Column, before: Column, low: float, high: float, dry: float = 0.0) -> Column:
    """after / before, 1 where before is dry, clipped."""
    return clip(F.when(before > dry, after / before).otherwise(F.lit(1.0)), low, high)


def apply_change(tmax: Column, tmin: Column, ppt: Column, vap: Column, dtx: Column, dtn: Column, rp: Column, rv: Column) -> tuple[Column, Column, Column, Column]:
    """A month's projected climate; without a humidity ratio, relative humidity stays as it is."""
    mid = (tmax + tmin) / 2
    tx = tmax + dtx
    return tx, F.least(tmin + dtn, tx - 0.1), ppt * rp, vap * F.coalesce(rv, sat_vap(mid + (dtx + dtn) / 2) / sat_vap(mid))


def wet_bulb(t: Column, rh: Column) -> Column:
    """Wet-bulb temperature after Stull (2011)."""
    t, h = clip(t, -20, 50), clip(rh, 5, 99)
    return t * F.atan(0.151977 * F.sqrt(h + 8.313659)) + F.atan(t + h) - F.atan(h - 1.676331) + 0.00391838 * F.pow(h, F.lit(1.5)) * F.atan(0.023101 * h) - 4.686035


def sat_vap_hpa(t: Column) -> Column:
    return 6.112 * F.exp(17.62 * t / (243.12 + t))


def rh_at_tmax(rh: Column, tmean: Column, tmax: Column) -> Column:
    return clip(rh * sat_vap_hpa(tmean) / sat_vap_hpa(tmax), 0, 100)


def koppen(tmax: Column, tmin: Column, ppt: Column) -> Column:
    """One of 30 climate classes; null if a month is missing."""
    t = F.zip_with(tmax, tmin, lambda a, b: (a + b) / 2)
    p = F.transform(ppt, lambda x: F.greatest(x, F.lit(0.0)))
    warm_north = mean(months(t, APRIL_SEPTEMBER)) >= mean(months(t, OCTOBER_MARCH))
    summer = F.when(warm_north, months(p, APRIL_SEPTEMBER)).otherwise(months(p, OCTOBER_MARCH))
    winter = F.when(warm_north, months(p, OCTOBER_MARCH)).otherwise(months(p, APRIL_SEPTEMBER))
    year, rain, cold, hot = mean(t), total(p), F.array_min(t), F.array_max(t)
    mild = F.size(F.filter(t, lambda x: x > 10))
    dry = F.when(total(winter) >= 0.7 * rain, 2 * year).when(total(summer) >= 0.7 * rain, 2 * year + 28).otherwise(2 * year + 14)
    group = F.when(cold > 0, F.lit("C")).otherwise(F.lit("D"))
    season = (
        F.when((F.array_min(summer) < 40) & (F.array_min(summer) < F.array_max(winter) / 3), F.lit("s"))
        .when(F.array_min(winter) < F.array_max(summer) / 10, F.lit("w"))
        .otherwise(F.lit("f"))
    )
    heat = F.when(hot >= 22, F.lit("a")).when(mild >= 4, F.lit("b")).when((cold <= 0) & (cold < -38), F.lit("d")).otherwise(F.lit("c"))
    known = (
        F.when((hot < 10) & (hot > 0), F.lit("ET"))
        .when(hot < 10, F.lit("EF"))
        .when(rain < 10 * dry, F.concat(F.when(rain < 5 * dry, F.lit("BW")).otherwise(F.lit("BS")), F.when(year >= 18, F.lit("h")).otherwise(F.lit("k"))))
        .when((cold >= 18) & (F.array_min(p) >= 60), F.lit("Af"))
        .when((cold >= 18) & (F.array_min(p) >= 100 - rain / 25), F.lit("Am"))
        .when(cold >= 18, F.lit("Aw"))
        .otherwise(F.concat(group, season, heat))
    )
    return F.when(complete(tmax, tmin, ppt), known)


def complete(*arrays: Column) -> Column:
    ok = F.lit(True)
    for a in arrays:
        ok = ok & a.isNotNull() & (F.size(a) == 12) & ~F.exists(a, lambda x: x.isNull())
    return ok


def extreme_min(tmax: Column, tmin: Column, ppt: Column) -> Column:
    """Estimated mean annual extreme minimum, in degrees Celsius."""
    a, b, c, d = HARDINESS
    rain = F.aggregate(ppt, F.lit(0.0), lambda s, x: s + F.greatest(x, F.lit(0.0)))
    return a + b * F.array_min(tmin) + c * (F.array_max(tmax) - F.array_min(tmin)) + d * F.log1p(rain)


def zone_index(celsius: Column) -> Column:
    """Half zones of 5 degrees Fahrenheit: 2 is 1a, 27 is 13b."""
    return F.least(F.greatest(F.floor((celsius * 9 / 5 + 32 + 60) / 5) + 2, F.lit(2)), F.lit(27)).cast("int")


def zone_label(index: Column) -> Column:
    return F.concat(F.floor(index / 2).cast("string"), F.when(index % 2 == 1, F.lit("b")).otherwise(F.lit("a")))


def days_below(tmin: Column, at: float, spread: float) -> Column:
    """Expected days a year with a low under `at`, lows being normal about their monthly means."""
    out = F.lit(0.0)
    for k in range(12):
        out = out + DAYS[k] * normal_cdf((at - F.get(tmin, F.lit(k))) / spread)
    return out


def frost_days(tmin: Column, spread: float = 3.0) -> Column:
    return days_below(tmin, 0.0, max(spread, 0.3))


def frost_free_days(tmin: Column) -> Column:
    at, spread = FROST_FREE
    out = F.lit(0.0)
    for k in range(12):
        out = out + DAYS[k] * normal_cdf((F.get(tmin, F.lit(k)) - at) / spread)
    return out


def bioclim(tmax: Column, tmin: Column, ppt: Column) -> dict[str, Column]:
    """Seven bioclimatic variables; bio15 is 0 where no rain falls."""
    t = F.zip_with(tmax, tmin, lambda a, b: (a + b) / 2)
    quarters = each(ppt)(lambda i, x: x + F.get(ppt, (i + 1) % 12) + F.get(ppt, (i + 2) % 12))
    rain = mean(ppt)
    return {
        "bio1": mean(t),
        "bio4": sample_sd(t) * 100,
        "bio5": F.array_max(tmax),
        "bio6": F.array_min(tmin),
        "bio12": total(ppt),
        "bio15": F.when(rain > 0, sample_sd(ppt) / rain * 100).otherwise(F.lit(0.0)),
        "bio17": F.array_min(quarters),
    }


def month_of_day(day: Column, length: Column) -> Column:
    """Month (1 to 12) of a day of the year (from 1), for years of 360, 365 or 366 days; other years are spread evenly."""

    def by(lengths: Sequence[int]) -> Column:
        out, at = F.lit(12), 0
        ends = []
        for n in lengths:
            at += n
            ends.append(at)
        for m in range(11, 0, -1):
            out = F.when(day <= ends[m - 1], F.lit(m)).otherwise(out)
        return out

    common = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
    leap = (31, 29, *common[2:])
    even = F.least(F.lit(12), (F.floor((day - 1) * 12 / length) + 1).cast("int"))
    return F.when(length == 365, by(common)).when(length == 366, by(leap)).when(length == 360, by((30,) * 12)).otherwise(even)


def sensitivity(distance: Column, moved: Column, moderate: float = 0.5, high: float = 1.0) -> Column:
    """high, moderate, ok, or null without data."""
    return (
        F.when(distance.isNull(), F.lit(None).cast("string"))
        .when((distance >= high) | (F.coalesce(moved, F.lit(False)) & (distance >= moderate)), F.lit("high"))
        .when((distance >= moderate) | F.coalesce(moved, F.lit(False)), F.lit("moderate"))
        .otherwise(F.lit("ok"))
    )


def quality_band(sigma: Column) -> Column:
    return F.when(sigma < 1, F.lit("excellent")).when(sigma < 2, F.lit("good")).when(sigma < 4, F.lit("fair")).otherwise(F.lit("poor"))


def quantised(score: Column, threshold: Column, at: int = 44) -> Column:
    """Suitability as 7 bits, the threshold at `at`; null as 0."""
    s, t = clip(F.coalesce(score, F.lit(0.0)), 0, 1), clip(threshold, 1e-6, 1 - 1e-6)
    low = F.least(F.floor(s / t * at), F.lit(at - 1))
    high = F.least(at + F.floor((s - t) / (1 - t) * (128 - at)), F.lit(127))
    return F.when(s >= t, high).otherwise(low).cast("int")


def lite_class(code: Column, at: int = 44) -> Column:
    """0 below the threshold, 1 to 3 for thirds above it; the reach bit (128) is kept."""
    s = code.bitwiseAND(F.lit(127))
    third = 1 + F.least(F.lit(2), F.floor((s - at) * 3 / (128 - at)))
    return F.when(s < at, F.lit(0)).otherwise(third).cast("int").bitwiseOR(code.bitwiseAND(F.lit(128)))


def gauss_curve(x: Column, optimum: float, width: float) -> Column:
    z = (x - optimum) / width
    return F.exp(-0.5 * z * z)


def rising_curve(x: Column, at: float, width: float) -> Column:
    return 1 / (1 + F.exp(-(x - at) / width))


def falling_curve(x: Column, at: float, width: float) -> Column:
    return 1 / (1 + F.exp((x - at) / width))


def celsius(kelvin: Column) -> Column:
    return kelvin - 273.15


def mm_a_day(rate: Column) -> Column:
    """Water of so many kilograms a square metre and second."""
    return rate * 86_400
