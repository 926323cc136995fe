"""Physical dimensions: exponents of the seven SI base units, checked on the driver and never stored in rows."""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

BASE = ("m", "kg", "s", "A", "K", "mol", "cd")


class DimensionError(ValueError):
    """Two quantities, or a function and its argument, don't fit."""


Dim = tuple[Fraction, ...]
NONE: Dim = (Fraction(0),) * 7


def dim(**powers: float) -> Dim:
    return tuple(Fraction(powers.get(b, 0)).limit_denominator(1000) for b in BASE)


def times(a: Dim, b: Dim, sign: int = 1) -> Dim:
    return tuple(x + sign * y for x, y in zip(a, b, strict=True))


def power(a: Dim, n: float) -> Dim:
    return tuple(x * Fraction(n).limit_denominator(1000) for x in a)


def shown(d: Dim) -> str:
    return " ".join(f"{b}^{p}" if p != 1 else b for b, p in zip(BASE, d, strict=True) if p) or "1"


@dataclass(frozen=True)
class Quantity:
    """A number in base units with its dimension."""

    value: float
    dim: Dim = NONE

    def __mul__(self, other):
        other = quantity(other)
        return Quantity(self.value * other.value, times(self.dim, other.dim))

    def __truediv__(self, other):
        other = quantity(other)
        return Quantity(self.value / other.value, times(self.dim, other.dim, -1))

    def __add__(self, other):
        other = quantity(other)
        require(self.dim, other.dim, "+")
        return Quantity(self.value + other.value, self.dim)

    def __sub__(self, other):
        return self + quantity(other) * -1

    def __pow__(self, n):
        return Quantity(self.value**n, power(self.dim, n))

    def __neg__(self):
        return self * -1

    __rmul__, __radd__ = __mul__, __add__

    def __rtruediv__(self, other):
        return quantity(other) / self

    def __rsub__(self, other):
        return quantity(other) - self

    def __float__(self):
        return float(self.value)

    def in_unit(self, unit: str) -> float:
        u = UNITS[unit]
        require(self.dim, u.dim, f"in {unit}")
        return self.value / u.value

    def best(self) -> str:
        """The value in the unit of its dimension that shows 1 to 1000, if there is one."""
        fits = [(k, u) for k, u in UNITS.items() if u.dim == self.dim and u.value > 0]
        size = abs(self.value)
        good = [(k, u) for k, u in fits if 1 <= size / u.value < 1000] or fits
        if not good:
            return f"{self.value:g} {shown(self.dim)}"
        name, u = min(good, key=lambda x: (abs(size / x[1].value - 1) if size else 0, len(x[0])))
        return f"{self.value / u.value:g} {name}"


def quantity(x) -> Quantity:
    return x if isinstance(x, Quantity) else Quantity(float(x))


def require(a: Dim, b: Dim, what: str) -> None:
    if a != b:
        raise DimensionError(f"{what}: {shown(a)} does not fit {shown(b)}")


def same_dimensions(a, b) -> bool:
    return quantity(a).dim == quantity(b).dim


#: SI prefixes and named units with their dimensions; fixed values.
PREFIXES = {
    "": 1.0, "y": 1e-24, "z": 1e-21, "a": 1e-18, "f": 1e-15, "p": 1e-12, "n": 1e-9, "u": 1e-6, "m": 1e-3, "c": 1e-2,
    "d": 1e-1, "da": 1e1, "h": 1e2, "k": 1e3, "M": 1e6, "G": 1e9, "T": 1e12, "P": 1e15, "E": 1e18, "Z": 1e21, "Y": 1e24,
}
NAMED = {
    "meter": ("m", dim(m=1)), "second": ("s", dim(s=1)), "amp": ("A", dim(A=1)), "kelvin": ("K", dim(K=1)),
    "mole": ("mol", dim(mol=1)), "candle": ("cd", dim(cd=1)), "gram": ("g", dim(kg=1)), "hertz": ("Hz", dim(s=-1)),
    "newton": ("N", dim(m=1, kg=1, s=-2)), "pascal": ("Pa", dim(m=-1, kg=1, s=-2)),
    "joule": ("J", dim(m=2, kg=1, s=-2)), "watt": ("W", dim(m=2, kg=1, s=-3)), "coulomb": ("C", dim(s=1, A=1)),
    "volt": ("V", dim(m=2, kg=1, s=-3, A=-1)), "farad": ("F", dim(m=-2, kg=-1, s=4, A=2)),
    "ohm": ("ohm", dim(m=2, kg=1, s=-3, A=-2)), "siemens": ("S", dim(m=-2, kg=-1, s=3, A=2)),
    "weber": ("Wb", dim(m=2, kg=1, s=-2, A=-1)), "tesla": ("T", dim(kg=1, s=-2, A=-1)),
    "henry": ("H", dim(m=2, kg=1, s=-2, A=-2)), "molar": ("M", dim(mol=1, m=-3)), "liter": ("l", dim(m=3)),
}
#: Value in base units of those units that aren't 1.
SCALE = {"gram": 1e-3, "molar": 1e3, "liter": 1e-3}


def _registry() -> dict[str, Quantity]:
    """Every prefix with every unit, by long and short name, plus squares and cubes of lengths."""
    out = {}
    for name, (short, d) in NAMED.items():
        for prefix, factor in PREFIXES.items():
            q = Quantity(factor * SCALE.get(name, 1.0), d)
            out[prefix + name] = q
            # bare one-letter symbols would hide variables
            if len(prefix + short) > 1:
                out.setdefault(prefix + short, q)
            if name == "meter":
                for n in (2, 3):
                    out[f"{prefix}metre{n}"] = out[f"{prefix}meter{n}"] = q**n
                    out.setdefault(f"{prefix}m{n}", q**n)
    out |= {"metre": out["meter"], "kilogram": out["kgram"], "kg": out["kgram"], "msecond": out["msecond"]}
    return out


UNITS: dict[str, Quantity] = _registry()
#: Physical and mathematical constants by name; fixed values.
CONSTANTS = {
    "pi": Quantity(3.141592653589793),
    "e": Quantity(2.718281828459045),
    "inf": Quantity(float("inf")),
    "gas_constant": Quantity(8.3144598, dim(m=2, kg=1, s=-2, K=-1, mol=-1)),
    "faraday_constant": Quantity(96485.33289, dim(s=1, A=1, mol=-1)),
    "zero_celsius": Quantity(273.15, dim(K=1)),
}
