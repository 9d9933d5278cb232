"""Residual formulas: parsed into sections of components."""

from __future__ import annotations

import re
from dataclasses import dataclass

STRUCTURES = ("id", "ar1", "exp", "diag", "iexp")


@dataclass(frozen=True)
class Component:
    kind: str
    var: str


@dataclass(frozen=True)
class Section:
    """One block of the residual: all rows, or those whose `factor` is in `levels` (all levels: one block each)."""

    components: tuple[Component, ...]
    factor: str | None = None
    levels: tuple[str, ...] | None = None


def _components(text: str) -> tuple[Component, ...]:
    out = []
    for part in text.split(":"):
        m = re.fullmatch(r"\s*(?:(\w+)\(\s*([\w.]+(?:\s*,\s*[\w.]+)?)\s*\)|([\w.]+))\s*", part)
        if not m:
            raise ValueError(f"not a residual component: {part.strip()}")
        kind, var = (m[1], m[2]) if m[1] else ("id", m[3])
        if kind not in STRUCTURES:
            raise ValueError(f"unknown residual structure: {kind}")
        out.append(Component(kind, var))
    return tuple(out)


def _terms(text: str) -> list[str]:
    """The text at its outer plus signs."""
    out, depth = [""], 0
    for c in text:
        depth += (c in "([") - (c in ")]")
        if c == "+" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def parse_residual(formula: str) -> tuple[Section, ...]:
    """'~ ar1(row):ar1(col)', or dsum terms '~ dsum(~ ar1(row):id(col) | zone, levels = [a + b]) + dsum(...)'."""
    terms = _terms(formula.strip().removeprefix("~"))
    sections = []
    for term in terms:
        m = re.fullmatch(r"\s*dsum\(\s*~\s*(.+?)\s*\|\s*([\w.]+)\s*(?:,\s*levels\s*=\s*\[(.*)\]\s*)?\)\s*", term)
        if m:
            levels = tuple(x.strip() for x in m[3].split("+")) if m[3] is not None else None
            sections.append(Section(_components(m[1]), m[2], levels))
        elif len(terms) > 1:
            raise ValueError("only dsum terms can be added")
        else:
            sections.append(Section(_components(term)))
    return tuple(sections)


def parse_fixed(formula: str) -> tuple[str, tuple[tuple[str, ...], ...]]:
    """'y ~ treat + block + zone:treat' as the response and its terms; a*b is a + b + a:b, 1 is always there."""
    response, right = (x.strip() for x in formula.split("~"))
    terms: list[tuple[str, ...]] = []
    for t in (x.strip() for x in right.split("+")):
        if "*" in t:
            names = [x.strip() for x in t.split("*")]
            parts = [tuple(n for i, n in enumerate(names) if mask >> i & 1) for mask in range(1, 1 << len(names))]
            terms += sorted(parts, key=len)
        elif t != "1":
            terms.append(tuple(x.strip() for x in t.split(":")))
    return response, tuple(dict.fromkeys(terms))


def parse_random(formula: str | None) -> tuple[tuple[str, ...], ...]:
    """'~ rep + rep:plot' as terms of factors."""
    if not formula:
        return ()
    return tuple(tuple(x.strip() for x in t.split(":")) for t in formula.strip().removeprefix("~").split("+"))
