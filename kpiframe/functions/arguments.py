"""Request arguments: text or numbers as users type them, read by one small parser (ARG-5, ARG-6, ARG-13, PST-1)."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from typing import Any

_NUMBER = re.compile(r"\+?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")

# Texts that switch quantile mode on, and texts that mean "no threshold".
ON_WORDS = frozenset({"1", "true", "yes", "on", "quantile", "quantiles"})
NO_THRESHOLD_WORDS = frozenset({"", "0", "none", "-"})
MOST_TILES = 1000


@dataclass(frozen=True)
class Threshold:
    """A low-weight threshold: an amount of weight, or a share of the total."""

    amount: float = 0.0
    share: float = 0.0

    @property
    def active(self) -> bool:
        return self.amount > 0 or self.share > 0

    def of_total(self, total: float) -> float:
        return self.share * total / 100 if self.share else self.amount


class Argument:
    """One raw request value; each method reads it as one kind of argument."""

    def __init__(self, raw: Any):
        self.raw = raw
        self.word = "" if raw is None else str(raw).strip().lower()

    def amount(self) -> float | None:
        """A positive finite number, else None."""
        found = _NUMBER.fullmatch(self.word)
        number = float(found.group()) if found else 0.0
        return number if 0 < number < math.inf else None

    def tiles(self, most: int | None = None) -> int:
        """A tile count: halves round up, at least 1 (also when unreadable), at most ``most`` if given."""
        wanted = self.amount() or 1.0
        if most is not None:
            wanted = min(wanted, most)
        return max(1, math.floor(wanted + 0.5))

    def switched_on(self) -> bool:
        return self.raw is not False and self.word in ON_WORDS

    def threshold(self) -> Threshold:
        """``p%`` is a share of the total weight, a number an amount; anything else no threshold."""
        if self.word in NO_THRESHOLD_WORDS:
            return Threshold()
        if self.word.endswith("%"):
            return Threshold(share=Argument(self.word[:-1]).amount() or 0.0)
        return Threshold(amount=self.amount() or 0.0)
