"""Values of cells: None (empty), float, str, bool and Err; their coercions and order."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from decimal import Decimal


@dataclass(frozen=True)
class Err:
    code: str


class CellError(Exception):
    """An error value on its way up."""

    def __init__(self, code: str):
        self.code = code


_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")


def fail(code: str):
    raise CellError(code)


def finite(x: float) -> float:
    return x if math.isfinite(x) else fail("#NUM!")


def round_sig(x: float) -> float:
    """x cut to the 15 digits that a cell shows."""
    return float(f"{x:.14e}") if x and math.isfinite(x) else x


def text_number(text: str) -> float | None:
    t = text.strip()
    percent = t.endswith("%")
    t = t[:-1].rstrip() if percent else t
    if not _NUMBER.fullmatch(t):
        return None
    x = float(t) / (100 if percent else 1)
    return x if math.isfinite(x) else None


def to_number(v) -> float:
    if v is None:
        return 0.0
    if isinstance(v, bool):
        return float(v)
    if isinstance(v, float):
        return v
    if isinstance(v, Err):
        return fail(v.code)
    x = text_number(v)
    return fail("#VALUE!") if x is None else x


def number_text(x: float) -> str:
    x = round_sig(x)
    if x == 0:
        return "0"
    if 1e-9 <= abs(x) < 1e15:
        out = f"{Decimal(repr(x)):f}"
        return out.rstrip("0").rstrip(".") if "." in out else out
    mantissa, exponent = f"{x:.14e}".split("e")
    return f"{mantissa.rstrip('0').rstrip('.')}E{'-' if int(exponent) < 0 else '+'}{abs(int(exponent)):02d}"


def to_text(v) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, float):
        return number_text(v)
    return fail(v.code) if isinstance(v, Err) else v


def to_bool(v) -> bool:
    if v is None:
        return False
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return v != 0
    if isinstance(v, Err):
        return fail(v.code)
    low = v.lower()
    return low == "true" if low in ("true", "false") else fail("#VALUE!")


def _rank(v) -> int:
    return 2 if isinstance(v, bool) else 0 if isinstance(v, float) else 1


def compare(a, b) -> int:
    """-1, 0 or 1: numbers before texts before booleans, texts without regard to case."""
    for v in (a, b):
        if isinstance(v, Err):
            fail(v.code)
    if a is None and b is None:
        return 0
    if a is None:
        a = False if isinstance(b, bool) else 0.0 if isinstance(b, float) else ""
    if b is None:
        b = False if isinstance(a, bool) else 0.0 if isinstance(a, float) else ""
    if _rank(a) != _rank(b):
        return -1 if _rank(a) < _rank(b) else 1
    x, y = (a.lower(), b.lower()) if isinstance(a, str) else (a, b)
    return (x > y) - (x < y)


def same(a, b) -> bool:
    """As lookups compare: only values of one kind are equal."""
    if a is None or b is None or isinstance(a, Err) or isinstance(b, Err):
        return a is None and b is None
    return _rank(a) == _rank(b) and compare(a, b) == 0


def wildcard(pattern: str, whole: bool = True) -> re.Pattern:
    """* and ? stand for text, ~ takes the next one as it is; case does not count."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "~" and i + 1 < len(pattern) and pattern[i + 1] in "*?~":
            i += 1
            out += re.escape(pattern[i])
        else:
            out += ".*" if c == "*" else "." if c == "?" else re.escape(c)
        i += 1
    return re.compile(f"^{out}$" if whole else out, re.IGNORECASE | re.DOTALL)
