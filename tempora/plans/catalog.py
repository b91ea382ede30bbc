"""Numbered example formulas over one signal x, from simple to deeply nested, and the three of the benchmark."""

from __future__ import annotations

from tempora.plans.formula import Formula, always, eventually, gt, lt, not_, until

LOW, HIGH = lt("x", 0.5), gt("x", -0.5)


def _nested(depth: int, layer) -> Formula:
    out = gt("x", 0)
    for _ in range(depth):
        out = layer(out)
    return out


def catalog(ids: list[int] | None = None) -> dict[int, Formula]:
    """Formulas by number; all, or those asked for."""
    out = {1: LOW & HIGH, 2: LOW | HIGH, 3: not_(LOW)}
    for k, b in enumerate((10, 100, 1000)):
        out |= {4 + k: always(0, b, LOW), 7 + k: eventually(0, b, LOW), 10 + k: until(0, b, LOW, HIGH)}
    layers = (
        lambda f: eventually(0, 10, f) & eventually(0, 10, f),
        lambda f: eventually(0, 10, always(0, 10, f)),
        lambda f: until(0, 10, f, f),
    )
    for j, layer in enumerate(layers):
        for k, depth in enumerate((2, 3, 5)):
            out[13 + 3 * j + k] = _nested(depth, layer)
    return {k: out[k] for k in (sorted(out) if ids is None else ids)}


BENCHMARK = {
    "phi1": LOW & HIGH,
    "phi2": always(0, 1000, gt("x", 0.5) >> eventually(0, 100, lt("x", 0))),
    "phi3": always(0, 100, LOW) | always(100, 150, gt("x", 0)),
}
