"""Tables as text: the first and the last rows of a frame, never all of it."""

from __future__ import annotations

from dataclasses import dataclass, replace

from tessera.operators.frame import Frame

#: Column separator, line and corner of each style.
STYLES = {"ascii": ("|", "-", "+"), "rounded": ("│", "─", "┼"), "minimal": (" ", "-", " "), "markdown": ("|", "-", "|")}


@dataclass(frozen=True)
class DisplayConfig:
    max_rows: int = 10
    max_cols: int = 12
    float_precision: int = 4
    style: str = "rounded"
    show_types: bool = True


_now = DisplayConfig()


def display_config() -> DisplayConfig:
    return _now


def set_display_config(config: DisplayConfig | None = None, **changes) -> DisplayConfig:
    global _now
    _now = replace(config or _now, **changes)
    if _now.style not in STYLES:
        raise ValueError(f"no such style: {_now.style}")
    return _now


def _cell(v, c: DisplayConfig) -> str:
    return "null" if v is None else f"{v:.{c.float_precision}f}" if isinstance(v, float) else str(v)


def render(frame: Frame, config: DisplayConfig | None = None) -> str:
    """With an order, half of the rows are from the end."""
    c = config or _now
    names = frame.columns if frame.width <= c.max_cols else [*frame.columns[: c.max_cols // 2], *frame.columns[-(c.max_cols - c.max_cols // 2) :]]
    shown = frame.df.select(*[f"`{n}`" for n in names])
    height = frame.height()
    if height <= c.max_rows or frame.order is None:
        rows = (frame.df.orderBy(frame.order).select(*names) if frame.order else shown).limit(c.max_rows).collect()
        cells = [[_cell(v, c) for v in r] for r in rows]
    else:
        half = c.max_rows // 2
        top, end = frame.head(c.max_rows - half).df.select(*names).collect(), frame.tail(half).df.select(*names).collect()
        cells = [[_cell(v, c) for v in r] for r in top] + [["…"] * len(names)] + [[_cell(v, c) for v in r] for r in end]
    heads = [names] + ([[frame.df.schema[n].dataType.simpleString() for n in names]] if c.show_types else [])
    width = [max(len(r[i]) for r in [*heads, *cells]) for i in range(len(names))]
    bar, dash, corner = STYLES[c.style]
    line = lambda r: f"{bar} " + f" {bar} ".join(x.ljust(w) for x, w in zip(r, width)) + f" {bar}"
    rule = corner + corner.join(dash * (w + 2) for w in width) + corner
    return "\n".join([f"{height} rows, {frame.width} columns", *map(line, heads), rule, *map(line, cells)])
