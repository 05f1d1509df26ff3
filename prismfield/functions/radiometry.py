"""Atmosphere, radiance and thermal-transmittance formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published atmospheric transmission model.
X, ALPHA, BETA = 1.9, (0.006569, 0.01262), (-0.002276, -0.00667)
H = (1.5587, 6.939e-2, -2.7816e-4, 6.8455e-7)
KELVIN = 273.15


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def water_vapour(humidity, air_temp) -> Column:
    """g/m3 at a relative humidity in percent and an air temperature in deg C."""
    t = col(air_temp)
    return col(humidity) / 100 * F.exp(H[0] + H[1] * t + H[2] * t * t + H[3] * t * t * t)


def transmittance(distance, humidity, air_temp) -> Column:
    """Share of radiation that passes `distance` metres of air, in 0..1; null unless the distance is positive."""
    d = col(distance)
    d = F.when((d > 0) & ~F.isnan(d), F.sqrt(d))
    w = F.sqrt(water_vapour(humidity, air_temp))
    tau = X * F.exp(-d * (ALPHA[0] + BETA[0] * w)) + (1 - X) * F.exp(-d * (ALPHA[1] + BETA[1] * w))
    return F.when(d.isNotNull(), clip(tau, 0.0, 1.0))


def radiance(temp_c) -> Column:
    k = col(temp_c) + KELVIN
    return k * k * k * k


def temperature(w: Column) -> Column:
    """Inverse of `radiance`; null for radiances that are not positive."""
    return F.when(w > 0, F.sqrt(F.sqrt(w)) - KELVIN)


def corrected(apparent, emissivity, tau, reflected, air_temp) -> Column:
    """Object temperature behind an apparent one; null where emissivity * tau is 0."""
    e, t = col(emissivity), col(tau)
    w = radiance(apparent) - (1 - e) * t * radiance(reflected) - (1 - t) * radiance(air_temp)
    return temperature(F.try_divide(w, e * t))


def u_value(t_surf, t_in, t_out, hsi, solar=0.0) -> Column:
    """Transmittance W/m2K from the inner surface temperature, plus a solar term; null if both airs are equal."""
    return F.try_divide(col(hsi) * (col(t_in) - col(t_surf)) + col(solar), col(t_in) - col(t_out))


def quality_flag(t_surf: Column, material: Column, t_in: float, t_out: float, solar: list[str], maybe: list[str]) -> Column:
    """solar_suspected, solar_possible, implausible or empty, in this order of priority."""
    bad = (t_surf < min(t_in, t_out)) | (t_surf > max(t_in, t_out))
    return F.when(bad & material.isin(solar), "solar_suspected").when(bad & material.isin(maybe), "solar_possible").when(bad, "implausible").otherwise("")


def sol_air(t_out, absorptance, irradiance, h_out, emissivity=None, long_wave=0.0, shading=1.0) -> Column:
    """Sol-air temperature; the full form subtracts emissivity * long_wave and shades the gain."""
    gain = col(absorptance) * col(shading) * col(irradiance)
    if emissivity is not None:
        gain = gain - col(emissivity) * col(long_wave)
    return col(t_out) + gain / col(h_out)


def u_sol_air(t_surf, t_in, t_sa: Column, hsi) -> Column:
    """U with the sol-air temperature as the outer one; null where it meets the inner temperature within 1e-6."""
    den = col(t_in) - t_sa
    return F.when(F.abs(den) >= 1e-6, col(hsi) * (col(t_in) - col(t_surf)) / F.when(F.abs(den) >= 1e-6, den))


def film_ceiling(hsi, he) -> Column:
    """Largest transmittance that two surface films allow."""
    return 1 / (1 / col(hsi) + 1 / col(he))


def construction(u: Column, step: float, hsi: float, he: float, least_r: float) -> tuple[Column, Column, Column]:
    """Binned U (half-even), layer resistance and whether it is unphysical; a bin of 0 is unphysical."""
    key = F.rint(u / step) * step
    r = F.try_divide(F.lit(1.0), key) - 1 / hsi - 1 / he
    bad = r.isNull() & u.isNotNull() | (r <= least_r)
    return key, F.when(bad, F.lit(least_r)).otherwise(r), bad


def wall_irradiance(ghi: Column, latitude: Column, azimuth: Column, hour: Column, day: Column, albedo: float = 0.2, most_dni: float = 950.0) -> tuple[Column, Column]:
    """(irradiance on a vertical wall, direct normal irradiance) from the horizontal one.

    Declination by day of year, hour angle by solar hour; `azimuth` counts from south to west.
    The diffuse share follows Erbs' polynomial of the clearness index; the sky is isotropic and
    the incidence loss is ASHRAE's with b = 0.05.
    """
    d, w, f = F.radians(23.45 * F.sin(F.radians(360.0 * (284 + day) / 365.0))), F.radians(15.0 * (hour - 12)), F.radians(latitude)
    cz = F.greatest(F.lit(0.0), F.sin(f) * F.sin(d) + F.cos(f) * F.cos(d) * F.cos(w))
    up = cz > 0.05
    kt = F.when(up, F.least(F.lit(1.0), F.try_divide(ghi, 1361.0 * (1 + 0.033 * F.cos(F.radians(360.0 * day / 365.0))) * cz))).otherwise(0.0)
    share = F.when(kt <= 0.22, 1 - 0.09 * kt).when(kt <= 0.8, 0.9511 - 0.1604 * kt + 4.388 * kt * kt - 16.638 * kt * kt * kt + 12.336 * kt * kt * kt * kt).otherwise(0.165)
    dni = F.when(up, F.least(F.lit(most_dni), F.try_divide(ghi * (1 - share), cz))).otherwise(0.0)
    south, west = F.sin(f) * F.cos(d) * F.cos(w) - F.cos(f) * F.sin(d), F.cos(d) * F.sin(w)
    ci = F.greatest(F.lit(0.0), south * F.cos(F.radians(azimuth)) + west * F.sin(F.radians(azimuth)))
    loss = F.when(ci > 0.05, F.greatest(F.lit(0.0), 1 - 0.05 * (F.try_divide(F.lit(1.0), ci) - 1))).otherwise(0.0)
    return dni * ci * loss + (ghi - dni * cz) * 0.5 + ghi * albedo * 0.5, dni
