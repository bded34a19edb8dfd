"""Clear-sky irradiance on a tilted plane as one Column expression."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from dustledger.constants import TZ_MERIDIAN


def _c(value: Column | float) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def declination(doy: Column) -> Column:
    """Cooper declination, radians."""
    return F.radians(F.lit(23.45) * F.sin(F.radians(F.lit(360.0) * (doy + 284) / 365.0)))


def hour_angle(doy: Column, hour: Column, lon: Column | float) -> Column:
    """Hour angle at the middle of the hour, radians, with the equation of time."""
    b = F.radians(F.lit(360.0) * (doy - 81) / 364.0)
    eot = 9.87 * F.sin(2 * b) - 7.53 * F.cos(b) - 1.5 * F.sin(b)
    solar = hour + 0.5 + (4.0 * (_c(lon) - TZ_MERIDIAN) + eot) / 60.0
    return F.radians(15.0 * (solar - 12.0))


def cos_zenith(doy: Column, hour: Column, lat, lon) -> Column:
    dec, omega, phi = declination(doy), hour_angle(doy, hour, lon), F.radians(_c(lat))
    return F.sin(phi) * F.sin(dec) + F.cos(phi) * F.cos(dec) * F.cos(omega)


def cos_incidence(doy: Column, hour: Column, lat, lon, tilt, azimuth) -> Column:
    """Angle-of-incidence cosine (Duffie & Beckman 1.6.2); azimuth clockwise from north."""
    dec, omega = declination(doy), hour_angle(doy, hour, lon)
    phi, beta = F.radians(_c(lat)), F.radians(_c(tilt))
    gamma = F.radians(_c(azimuth) - 180.0)
    sun_up = F.sin(phi) * F.cos(beta) - F.cos(phi) * F.sin(beta) * F.cos(gamma)
    sun_side = F.cos(phi) * F.cos(beta) + F.sin(phi) * F.sin(beta) * F.cos(gamma)
    west = F.sin(beta) * F.sin(gamma)
    return (F.sin(dec) * sun_up + F.cos(dec) * F.cos(omega) * sun_side
            + F.cos(dec) * F.sin(omega) * west)


def clearsky_poa(doy: Column, hour: Column, lat, lon, tilt=20.0, azimuth=180.0) -> Column:
    """W/m2 on the plane; beam only, 1353 * 0.7^(AM^0.678); 0 when the sun is down or behind."""
    cosz = cos_zenith(doy, hour, lat, lon)
    aoi = cos_incidence(doy, hour, lat, lon, tilt, azimuth)
    air_mass = F.least(F.lit(20.0), F.greatest(F.lit(1.0), F.lit(1.0) / cosz))
    beam = 1353.0 * F.pow(F.lit(0.7), F.pow(air_mass, F.lit(0.678)))
    return F.when((cosz > 0.02) & (aoi > 0.0), aoi * beam).otherwise(F.lit(0.0))
