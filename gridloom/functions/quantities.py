"""Quantities: columns whose unit is known when the plan is built, held as doubles in that unit.

A ``Quantity`` pairs a column with a ``Unit``; sums and comparisons convert the right side to the left's unit, products
combine units, and a clash of dimensions is an error before anything runs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

Dimensions = tuple[int, ...]

# Base dimensions, prefixes and units of the SI and those in use with it.
BASES = ("m", "kg", "s", "A", "K", "mol", "cd", "rad", "bit")
PREFIXES = {"q": -30, "r": -27, "y": -24, "z": -21, "a": -18, "f": -15, "p": -12, "n": -9, "μ": -6, "u": -6, "m": -3, "c": -2, "d": -1, "da": 1, "h": 2, "k": 3, "M": 6, "G": 9, "T": 12, "P": 15, "E": 18, "Z": 21, "Y": 24, "R": 27, "Q": 30}
BINARY = {"Ki": 1, "Mi": 2, "Gi": 3, "Ti": 4, "Pi": 5, "Ei": 6, "Zi": 7, "Yi": 8, "Ri": 9, "Qi": 10}
UNITS = {
    "g": (1e-3, "kg"),
    "Hz": (1.0, "s^-1"),
    "N": (1.0, "kg.m.s^-2"),
    "Pa": (1.0, "kg.m^-1.s^-2"),
    "J": (1.0, "kg.m^2.s^-2"),
    "W": (1.0, "kg.m^2.s^-3"),
    "V": (1.0, "kg.m^2.s^-3.A^-1"),
    "C": (1.0, "A.s"),
    "F": (1.0, "kg^-1.m^-2.s^4.A^2"),
    "Ω": (1.0, "kg.m^2.s^-3.A^-2"),
    "S": (1.0, "kg^-1.m^-2.s^3.A^2"),
    "Wb": (1.0, "kg.m^2.s^-2.A^-1"),
    "T": (1.0, "kg.s^-2.A^-1"),
    "H": (1.0, "kg.m^2.s^-2.A^-2"),
    "Bq": (1.0, "s^-1"),
    "Gy": (1.0, "m^2.s^-2"),
    "Sv": (1.0, "m^2.s^-2"),
    "kat": (1.0, "mol.s^-1"),
    "sr": (1.0, "rad^2"),
    "lm": (1.0, "cd.rad^2"),
    "lx": (1.0, "cd.rad^2.m^-2"),
    "l": (1e-3, "m^3"),
    "L": (1e-3, "m^3"),
    "bar": (1e5, "kg.m^-1.s^-2"),
    "eV": (1.602176634e-19, "kg.m^2.s^-2"),
    "cal": (4.184, "kg.m^2.s^-2"),
    "Wh": (3600.0, "kg.m^2.s^-2"),
    "Da": (1.6605390666e-27, "kg"),
    "B": (8.0, "bit"),
    "b": (1.0, "bit"),
}
UNPREFIXED = {"t": (1000.0, "kg"), "ha": (1e4, "m^2"), "°": (0.017453292519943295, "rad"), "′": (0.0002908882086657216, "rad"), "″": (4.84813681109536e-06, "rad")}
#: Degrees Celsius: a Kelvin's size, shifted where a value is converted to another unit.
CELSIUS = 273.15


@dataclass(frozen=True)
class Unit:
    """``factor`` base units of ``dimensions``; ``shift`` is added after the factor (Celsius)."""

    name: str
    factor: float
    dimensions: Dimensions
    shift: float = 0.0


def _symbol(s: str) -> tuple[float, Dimensions, float]:
    if s == "°C":
        return 1.0, _one("K"), CELSIUS
    if s in BASES:
        return 1.0, _one(s), 0.0
    found = UNPREFIXED.get(s) or UNITS.get(s)
    if found:
        inner = unit(found[1])
        return found[0] * inner.factor, inner.dimensions, 0.0
    for n in (2, 1):
        head, rest = s[:n], s[n:]
        scale = 1024.0 ** BINARY[head] if head in BINARY and rest in ("b", "B") else 10.0 ** PREFIXES[head] if head in PREFIXES else None
        if scale is not None and (rest in UNITS or rest in BASES and rest not in ("kg", "bit")):
            factor, dimensions, _ = _symbol(rest)
            return scale * factor, dimensions, 0.0
    raise ValueError(f"not a unit: {s}")


def _one(base: str) -> Dimensions:
    return tuple(int(b == base) for b in BASES)


@cache
def unit(name: str) -> Unit:
    """Of ``kg.m^2.s^-2``: terms joined by dots, whole exponents."""
    factor, dimensions, shift = 1.0, (0,) * len(BASES), 0.0
    terms = name.split(".")
    for term in terms:
        m = re.fullmatch(r"([^\d^]+)(?:\^(-?\d+))?", term)
        if not m:
            raise ValueError(f"not a unit: {name}")
        n = int(m[2] or 1)
        f, d, s = _symbol(m[1])
        factor *= f**n
        dimensions = tuple(a + n * b for a, b in zip(dimensions, d, strict=True))
        shift = s if len(terms) == 1 and n == 1 else 0.0
    return Unit(name, factor, dimensions, shift)


def _product(a: Unit, b: Unit, n: int) -> Unit:
    """The unit of a * b^n."""
    names = [a.name] if a.name else []
    if b.name:
        names += [re.sub(r"^([^\^]+)(?:\^(-?\d+))?$", lambda m: f"{m[1]}^{n * int(m[2] or 1)}", t) for t in b.name.split(".")]
    powers: dict[str, int] = {}
    for t in ".".join(names).split("."):
        s, _, p = t.partition("^")
        powers[s] = powers.get(s, 0) + int(p or 1)
    name = ".".join(s if p == 1 else f"{s}^{p}" for s, p in powers.items() if p and s)
    return Unit(name, a.factor * b.factor**n, tuple(x + n * y for x, y in zip(a.dimensions, b.dimensions, strict=True)))


@dataclass(frozen=True)
class Quantity:
    value: Column
    unit: Unit

    def _same(self, other: Quantity) -> None:
        if self.unit.dimensions != other.unit.dimensions:
            raise ValueError(f"{self.unit.name} and {other.unit.name} measure different things")

    def to(self, name: str) -> Quantity:
        """In another unit of the same dimensions."""
        other = Quantity(self.value, unit(name))
        self._same(other)
        to = other.unit
        if to.name == self.unit.name:
            return self
        value = self.value * F.lit(self.unit.factor) + F.lit(self.unit.shift - to.shift) if self.unit.shift or to.shift else self.value * F.lit(self.unit.factor)
        return Quantity(value / F.lit(to.factor), to)

    def _as_mine(self, other: Quantity) -> Column:
        """The other's size in my unit: intervals, so no shift."""
        self._same(other)
        return other.value if other.unit == self.unit else other.value * F.lit(other.unit.factor / self.unit.factor)

    def __add__(self, other: Quantity) -> Quantity:
        return Quantity(self.value + self._as_mine(other), self.unit)

    def __sub__(self, other: Quantity) -> Quantity:
        return Quantity(self.value - self._as_mine(other), self.unit)

    def __mul__(self, other: Quantity) -> Quantity:
        return Quantity(self.value * other.value, _product(self.unit, other.unit, 1)).plain_if_bare()

    def __truediv__(self, other: Quantity) -> Quantity:
        return Quantity(F.try_divide(self.value, other.value), _product(self.unit, other.unit, -1)).plain_if_bare()

    def __pow__(self, n: int) -> Quantity:
        return Quantity(F.pow(self.value, F.lit(float(n))), _product(Unit("", 1.0, (0,) * len(BASES)), self.unit, n)).plain_if_bare()

    def plain_if_bare(self) -> Quantity:
        """Without dimensions the factor goes into the number."""
        if any(self.unit.dimensions):
            return self
        return Quantity(self.value * F.lit(self.unit.factor), Unit("", 1.0, self.unit.dimensions))

    def sqrt(self) -> Quantity:
        if any(d % 2 for d in self.unit.dimensions):
            raise ValueError(f"no root of {self.unit.name}")
        half = ".".join(b if d == 2 else f"{b}^{d // 2}" for b, d in zip(BASES, self.unit.dimensions, strict=True) if d)
        return Quantity(F.sqrt(self.value * F.lit(self.unit.factor)), unit(half))

    def __lt__(self, other: Quantity) -> Column:
        return self.value < self._as_mine(other)

    def __gt__(self, other: Quantity) -> Column:
        return self.value > self._as_mine(other)

    def same(self, other: Quantity) -> Column:
        return self.value == self._as_mine(other)

    def angle(self) -> Column:
        """Radians, for ``sin`` and kin."""
        return self.to("rad").value

    def total(self) -> Quantity:
        return Quantity(F.coalesce(F.sum(self.value), F.lit(0.0)), self.unit)

    def mean(self) -> Quantity:
        return Quantity(F.avg(self.value), self.unit)


def quantity(value: Column, name: str) -> Quantity:
    return Quantity(value.cast("double"), unit(name))


def scaled(number: float, prefix: str) -> int | float:
    """``1.5k.``: a prefix on its own as a number."""
    if prefix in BINARY:
        return number * 1024 ** BINARY[prefix]
    power = PREFIXES[prefix]
    out = number * 10**power if power >= 0 else number / 10**-power
    return int(out) if power >= 0 and out == int(out) else out


def dms(q: Quantity, places: int = 0) -> Column:
    """``45°30′0″``."""
    seconds = F.round(F.abs(q.to("°").value) * 3600, places)
    whole = F.floor(seconds)
    tail = (seconds - F.floor(seconds / 60) * 60).cast(f"decimal(10,{places})").cast("string")
    return F.concat(F.when(q.value < 0, "-").otherwise(""), F.floor(whole / 3600).cast("string"), F.lit("°"), F.pmod(F.floor(whole / 60), F.lit(60)).cast("string"), F.lit("′"), tail, F.lit("″"))
