"""The duration grammar: ``-?(<n>(ns|us|ms|s|m|h|d|w|mo|q|y|i))+``."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import require

# Microseconds of the fixed units, months of the calendar units.
MICROS = {"us": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000, "w": 604_800_000_000}
MONTHS = {"mo": 1, "q": 3, "y": 12}
_PART = re.compile(r"(\d+)(ns|us|ms|mo|s|m|h|d|w|q|y|i)")


@dataclass(frozen=True)
class Duration:
    """Months, microseconds, and index steps; the last only by itself."""

    months: int = 0
    micros: int = 0
    index: int = 0

    def __neg__(self) -> "Duration":
        return Duration(-self.months, -self.micros, -self.index)

    @property
    def positive(self) -> bool:
        return self.months > 0 or self.micros > 0 or self.index > 0


def parse(text: str) -> Duration:
    body = text[1:] if text.startswith("-") else text
    parts = _PART.findall(body)
    require(bool(parts) and "".join(a + b for a, b in parts) == body, f"bad duration {text!r}")
    months = micros = index = 0
    for n, unit in parts:
        n = int(n)
        if unit == "i":
            index += n
        elif unit in MONTHS:
            months += n * MONTHS[unit]
        elif unit == "ns":
            require(n % 1000 == 0, "times are kept in microseconds")
            micros += n // 1000
        else:
            micros += n * MICROS[unit]
    require(not (index and (months or micros)), "index steps don't mix with times")
    found = Duration(months, micros, index)
    return -found if text.startswith("-") else found
