"""D1/D2 (core) column roles from names, decided on the driver from ``df.columns``."""

from __future__ import annotations

import re
from collections.abc import Sequence

from tidemark import config as C


def norm(name) -> str:
    """Lower-case and keep only ``[a-z0-9]``."""
    return re.sub(r"[^a-z0-9]", "", str(name).lower())


def find_col(columns: Sequence[str], *keywords: str) -> str | None:
    """First column whose normalised name contains a keyword.

    Keyword order outranks column order, and the match is a substring, so
    ``age`` also matches ``usage`` and ``id`` matches ``paid``.
    """
    normed = [(c, norm(c)) for c in columns]
    for kw in keywords:
        for c, n in normed:
            if kw in n:
                return c
    return None


def detect_roles(columns: Sequence[str], lineage: str = "main") -> dict[str, str | None]:
    """Five roles in priority order; a column already taken leaves the later
    role empty (no second choice). The first four releases had no ``status``
    churn keyword and no one-column-per-role rule."""
    old = lineage in ("v1", "v2", "v3", "v4")
    found = {}
    for role in C.ROLE_PRIORITY:
        kws = list(C.ROLE_KEYWORDS[role])
        if old and role == "churn":
            kws = [k for k in kws if k != "status"]
        found[role] = find_col(columns, *kws)
    if old:
        return found
    taken: list[str] = []
    out: dict[str, str | None] = {}
    for role in C.ROLE_PRIORITY:
        col = found[role]
        if col and col not in taken:
            out[role] = col
            taken.append(col)
        else:
            out[role] = None
    return out
