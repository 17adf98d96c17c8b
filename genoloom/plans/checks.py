"""SQL for the comparisons, computed in another way than the engine does: erfc by its series and its continued fraction."""

from __future__ import annotations

import math

_ROOT = math.sqrt(math.pi)


def _d(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def _erf_series(u: str, terms: int = 50) -> str:
    """erf(x) / x of u = x * x, small."""
    out = "0.0"
    for n in reversed(range(terms)):
        out = f"({_d((-1) ** n / (math.factorial(n) * (2 * n + 1)))} + ({u}) * {out})"
    return f"({_d(2 / _ROOT)} * {out})"


def _fraction(x: str, levels: int = 60) -> str:
    """erfc(x) * exp(x * x) of x >= 2."""
    out = f"({x})"
    for k in reversed(range(1, levels)):
        out = f"(({x}) + {_d(k / 2)} / {out})"
    return f"({_d(1 / _ROOT)} / {out})"


def with_erfc(name: str, source: str, z: str, columns: str = "*") -> str:
    """Two tables of a WITH clause; the second, `name`, has the columns of `source`, zx = |z| / sqrt 2, and PV and NL: the
    two-sided p-value of z and its -log10."""
    small = f"(1.0 - zx * {_erf_series('zu')})"
    return f"""{name}_x AS (SELECT {columns}, abs({z}) / {_d(math.sqrt(2))} AS zx, least(z_u, 4.0) AS zu FROM (SELECT *, ({z}) * ({z}) / 2.0 AS z_u FROM {source})),
{name} AS (SELECT *, CASE WHEN zx IS NULL THEN NULL WHEN zx < 2 THEN {small} ELSE exp(-zx * zx) * {_fraction('greatest(zx, 2.0)')} END AS PV,
  CASE WHEN zx IS NULL THEN NULL WHEN zx < 2 THEN -log10({small}) ELSE zx * zx / {_d(math.log(10))} - log10({_fraction('greatest(zx, 2.0)')}) END AS NL FROM {name}_x)"""
