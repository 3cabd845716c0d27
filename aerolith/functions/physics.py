"""Scalar physics as Column -> Column: altitude, thermodynamics, rotation, wind, humidity. Ratios by zero are null."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: physical constants and coefficients that results depend on
GRAVITY = 9.80665
OMEGA = 7292115e-11
EARTH_RADIUS = 6371008.7714
DRY_GAS, VAPOUR_GAS = 287.0, 461.51
KAPPA = 0.28571428571428564
SEA_PRESSURE, TROPOPAUSE = 1013.25, 226.32
LAPSE = 0.0065
US_TEMPERATURE, ICAO_TEMPERATURE, TROPOPAUSE_TEMPERATURE = 288.0, 288.16, 216.66
ICAO_EXPONENT = 5.2561
ICE = (-6024.5282, 24.7219, 0.010613868, -1.3198825e-5, -0.49382577)
EDR_C1, EDR_C2 = -2.572, 0.5067


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def us_standard_altitude(pressure: Column) -> Column:
    """Metres from hPa, US standard atmosphere."""
    return US_TEMPERATURE / LAPSE * (1 - F.pow(pressure / SEA_PRESSURE, F.lit(DRY_GAS * LAPSE / GRAVITY)))


def _troposphere_altitude(p: Column) -> Column:
    return ICAO_TEMPERATURE / LAPSE * (1 - F.pow(p / SEA_PRESSURE, F.lit(1 / ICAO_EXPONENT)))


def _stratosphere_altitude(p: Column) -> Column:
    base = (ICAO_TEMPERATURE - TROPOPAUSE_TEMPERATURE) / LAPSE
    b = GRAVITY * math.log10(math.e) / (DRY_GAS * TROPOPAUSE_TEMPERATURE)
    shift = ICAO_EXPONENT / b * math.log10(TROPOPAUSE_TEMPERATURE / ICAO_TEMPERATURE)
    return base + shift - F.log10(p / SEA_PRESSURE) / b


def icao_troposphere_altitude(pressure: Column) -> Column:
    """Metres from hPa below the tropopause; other pressures are an error."""
    bad = F.raise_error(F.lit(f"pressure must be over {TROPOPAUSE} hPa")).cast("double")
    return F.when(pressure > TROPOPAUSE, _troposphere_altitude(pressure)).when(pressure.isNotNull(), bad)


def icao_stratosphere_altitude(pressure: Column) -> Column:
    """Metres from hPa above the tropopause; other pressures are an error."""
    bad = F.raise_error(F.lit(f"pressure must be {TROPOPAUSE} hPa or less")).cast("double")
    return F.when(pressure <= TROPOPAUSE, _stratosphere_altitude(pressure)).when(pressure.isNotNull(), bad)


def icao_altitude(pressure: Column) -> Column:
    return F.when(pressure > TROPOPAUSE, _troposphere_altitude(pressure)).otherwise(_stratosphere_altitude(pressure))


def icao_pressure(altitude: Column) -> Column:
    """hPa from metres in the troposphere."""
    return SEA_PRESSURE * F.pow((ICAO_TEMPERATURE - LAPSE * altitude) / ICAO_TEMPERATURE, F.lit(ICAO_EXPONENT))


def potential_temperature(temperature: Column, pressure: Column) -> Column:
    return temperature / F.pow(pressure / 1000.0, F.lit(KAPPA))


def coriolis(latitude: Column) -> Column:
    """2 omega sin(latitude), latitude in degrees."""
    return 2 * OMEGA * F.sin(F.radians(latitude))


def coriolis_over_radius(latitude: Column) -> Column:
    return coriolis(latitude) / EARTH_RADIUS


def absolute_vorticity(vorticity: Column, latitude: Column) -> Column:
    return vorticity + coriolis(latitude)


def vertical_vorticity(dv_dx: Column, du_dy: Column) -> Column:
    return dv_dx - du_dy


def shearing_deformation(dv_dx: Column, du_dy: Column) -> Column:
    return dv_dx + du_dy


def stretching_deformation(du_dx: Column, dv_dy: Column) -> Column:
    return du_dx - dv_dy


def magnitude(x: Column, y: Column, absolute: bool = False, squared: bool = False) -> Column:
    """Length of (x, y), or its square. absolute: of the absolute values, which have the same length."""
    x, y = (F.abs(x), F.abs(y)) if absolute else (x, y)
    return x * x + y * y if squared else F.sqrt(x * x + y * y)


def wind_speed(u: Column, v: Column) -> Column:
    return magnitude(u, v)


def total_deformation(shearing: Column, stretching: Column, squared: bool = False) -> Column:
    return magnitude(shearing, stretching, squared=squared)


def wind_direction(u: Column, v: Column) -> Column:
    """Radians in (0, 2 pi] that the wind comes from, clockwise from north; 0 for calm."""
    d = math.pi / 2 - F.atan2(-v, -u)
    return F.when((u == 0) & (v == 0), F.lit(0.0)).when(d <= 0, d + 2 * math.pi).otherwise(d)


def angle_difference(a: Column, b: Column) -> Column:
    """The smaller of the two angles between a and b, unsigned; null if either is."""
    apart = F.abs(a - b)
    return F.when(apart.isNotNull(), F.least(apart, 2 * math.pi - apart))


def jacobian(du_dx: Column, du_dy: Column, dv_dx: Column, dv_dy: Column) -> Column:
    return du_dx * dv_dy - du_dy * dv_dx


def ice_saturation_pressure(temperature: Column) -> Column:
    """Pa over ice, temperature in K."""
    a, b, c, d, e = ICE
    return 100.0 * F.exp(a / temperature + b + c * temperature + d * temperature * temperature + e * F.ln(temperature))


def ice_relative_humidity(specific_humidity: Column, pressure_pa: Column, temperature: Column) -> Column:
    return specific_humidity * pressure_pa * (VAPOUR_GAS / DRY_GAS) / ice_saturation_pressure(temperature)


def ice_supersaturated(temperature: Column, rhi: Column | None = None, specific_humidity: Column | None = None, pressure_pa: Column | None = None) -> Column:
    """Cold and supersaturated over ice; the humidity is given, or follows from specific humidity and pressure."""
    if rhi is None:
        if specific_humidity is None or pressure_pa is None:
            raise TypeError("give rhi, or specific_humidity and pressure_pa")
        rhi = ice_relative_humidity(specific_humidity, pressure_pa, temperature)
    return (temperature < 273.15) & (rhi > 1.0)


def feature_flags(a: Column, b: Column) -> Column:
    """Two features as bits: 4 for the first alone, 2 for the second alone, 7 for both, 0 for none."""
    a, b = a.cast("int"), b.cast("int")
    return F.shiftleft(a, 2).bitwiseOR(F.shiftleft(b, 1)).bitwiseOR(a.bitwiseAND(b))


def at_least(c: Column, least: float) -> Column:
    """c, but not under least; null stays null."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(least)))


def log_of_positive(c: Column) -> Column:
    """ln of positive values, null for others."""
    return F.when(c > 0, F.ln(c))


def eddy_dissipation(value: Column, mean: Column | float, variance: Column | float, c1: float = EDR_C1, c2: float = EDR_C2) -> Column:
    """exp(a) * max(value, 0) ** b, where b = c2 / sqrt(variance) and a = c1 - b * mean."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    b = ratio(F.lit(c2), F.sqrt(as_column(variance)))
    return F.exp(c1 - b * as_column(mean)) * F.pow(at_least(value, 0.0), b)
