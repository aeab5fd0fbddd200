"""Physical and mathematical constants, unit prefixes and temperature scales. Fixed values, in SI units."""

from __future__ import annotations

import math

#: name: (value, unit). Exact by definition unless marked by a standard uncertainty in UNCERTAIN.
VALUES: dict[str, tuple[float, str]] = {
    "speed of light in vacuum": (299792458.0, "m s^-1"), "Planck constant": (6.62607015e-34, "J Hz^-1"), "reduced Planck constant": (6.62607015e-34 / (2 * math.pi), "J s"), "elementary charge": (1.602176634e-19, "C"),
    "Boltzmann constant": (1.380649e-23, "J K^-1"), "Avogadro constant": (6.02214076e23, "mol^-1"), "molar gas constant": (8.31446261815324, "J mol^-1 K^-1"), "Faraday constant": (96485.33212331001, "C mol^-1"),
    "Newtonian constant of gravitation": (6.6743e-11, "m^3 kg^-1 s^-2"), "electron mass": (9.1093837139e-31, "kg"), "proton mass": (1.67262192595e-27, "kg"), "neutron mass": (1.67492750056e-27, "kg"), "atomic mass constant": (1.66053906892e-27, "kg"),
    "fine-structure constant": (7.2973525643e-3, ""), "Rydberg constant": (10973731.568157, "m^-1"), "Bohr radius": (5.29177210544e-11, "m"), "vacuum electric permittivity": (8.8541878188e-12, "F m^-1"), "vacuum mag. permeability": (1.25663706127e-6, "N A^-2"),
    "Stefan-Boltzmann constant": (5.670374419184429e-8, "W m^-2 K^-4"), "Wien wavelength displacement law constant": (2.897771955185173e-3, "m K"), "standard acceleration of gravity": (9.80665, "m s^-2"), "standard atmosphere": (101325.0, "Pa"),
}
UNCERTAIN = {"Newtonian constant of gravitation": 1.5e-15, "electron mass": 2.8e-40, "proton mass": 5.2e-37, "neutron mass": 8.5e-37, "atomic mass constant": 5.2e-37, "fine-structure constant": 1.1e-12, "Rydberg constant": 1.2e-5, "Bohr radius": 8.2e-21, "vacuum electric permittivity": 1.4e-21, "vacuum mag. permeability": 2e-16}

PREFIXES = {name: 10.0**p for name, p in zip("quetta ronna yotta zetta exa peta tera giga mega kilo hecto deka deci centi milli micro nano pico femto atto zepto yocto ronto quecto".split(), [30, 27, 24, 21, 18, 15, 12, 9, 6, 3, 2, 1, -1, -2, -3, -6, -9, -12, -15, -18, -21, -24, -27, -30])}
BINARY_PREFIXES = {name: 2.0 ** (10 * (k + 1)) for k, name in enumerate("kibi mebi gibi tebi pebi exbi zebi yobi".split())}
UNITS = {
    "gram": 1e-3, "metric_ton": 1e3, "pound": 0.45359237, "ounce": 0.028349523125, "carat": 2e-4, "degree": math.pi / 180, "arcmin": math.pi / 10800, "arcsec": math.pi / 648000, "minute": 60.0, "hour": 3600.0, "day": 86400.0, "week": 604800.0, "year": 31536000.0, "Julian_year": 31557600.0,
    "inch": 0.0254, "foot": 0.3048, "yard": 0.9144, "mile": 1609.344, "nautical_mile": 1852.0, "angstrom": 1e-10, "micron": 1e-6, "au": 149597870700.0, "light_year": 9460730472580800.0, "parsec": 149597870700.0 / (math.pi / 648000),
    "atm": 101325.0, "bar": 1e5, "torr": 101325 / 760, "psi": 0.45359237 * 9.80665 / 0.0254**2, "hectare": 1e4, "acre": 4046.8564224, "litre": 1e-3, "gallon": 3.785411784e-3, "kmh": 1 / 3.6, "mph": 0.44704, "knot": 1852 / 3600, "eV": 1.602176634e-19, "calorie": 4.184, "erg": 1e-7, "hp": 745.6998715822702, "dyn": 1e-5, "lbf": 0.45359237 * 9.80665,
}


def value(name: str) -> float:
    return VALUES[name][0]


def unit(name: str) -> str:
    return VALUES[name][1]


def precision(name: str) -> float:
    return UNCERTAIN.get(name, 0.0) / VALUES[name][0]


def find(part: str) -> list[str]:
    return sorted(k for k in VALUES if part.lower() in k.lower())


_TO_KELVIN = {"kelvin": lambda t: t, "celsius": lambda t: t + 273.15, "fahrenheit": lambda t: (t + 459.67) * 5 / 9, "rankine": lambda t: t * 5 / 9}
_FROM_KELVIN = {"kelvin": lambda t: t, "celsius": lambda t: t - 273.15, "fahrenheit": lambda t: t * 9 / 5 - 459.67, "rankine": lambda t: t * 9 / 5}
_SHORT = {"k": "kelvin", "c": "celsius", "f": "fahrenheit", "r": "rankine"}


def convert_temperature(t, old: str, new: str):
    """Of numbers, arrays or Columns."""
    name = lambda s: _SHORT.get(s.lower(), s.lower())
    return _FROM_KELVIN[name(new)](_TO_KELVIN[name(old)](t))


def lambda2nu(x):
    return value("speed of light in vacuum") / x


nu2lambda = lambda2nu
