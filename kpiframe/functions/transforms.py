"""Value transforms for display (TRF-2)."""

from __future__ import annotations


TRANSFORMS = ("none", "log", "exp", "logit", "zero", "one")


def transform_sql(v: str, transform: str, average: str) -> str:
    """Transformed value of SQL expression ``v`` as SQL; outside the domain (or overflowing) -> null.

    log: x > 0; exp: overflow -> null; logit: 0 < x < 1; zero: x - avg;
    one: x / avg (avg null or 0 -> null); anything else: x.
    """
    x = f"(CASE WHEN abs({v}) < double('inf') THEN {v} END)"
    name = str(transform or "none")
    if name == "log":
        out = f"CASE WHEN {x} > 0 THEN ln({x}) END"
    elif name == "exp":
        out = f"exp({x})"
    elif name == "logit":
        out = f"CASE WHEN {x} > 0 AND {x} < 1 THEN ln({x} / (1D - {x})) END"
    elif name == "zero":
        out = f"{x} - {average}"
    elif name == "one":
        out = f"CASE WHEN {average} <> 0 THEN {x} / {average} END"
    else:
        out = x
    return f"(CASE WHEN abs({out}) < double('inf') THEN {out} END)"
