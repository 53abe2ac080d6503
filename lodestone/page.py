"""The statistics of an index as a page for the browser."""

from __future__ import annotations

import html

LINE = 220


def size(n: int) -> str:
    """A number of bytes in the largest unit that leaves one or more."""
    unit, units = 0, ("B", "KB", "MB", "GB")
    value = float(n)
    while value >= 1024 and unit < len(units) - 1:
        value, unit = value / 1024, unit + 1
    return f"{value:.2f} {units[unit]}" if unit else f"{n} B"


def count(n: int) -> str:
    return f"{n:,}"


def shortened(text: str, limit: int = LINE) -> str:
    """Texts over the limit end in three dots and are as long as the limit."""
    return text if len(text) <= limit else text[: limit - 3] + "..."


def escaped(text: str) -> str:
    return html.escape(text, quote=True)


def cell(column: str, value) -> str:
    if value is None:
        return "<td></td>"
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return f"<td>{escaped(shortened(str(value)))}</td>"
    shown = size(value) if column == "bytes" else count(value) if isinstance(value, int) else f"{value:,.6g}"
    return f'<td class="n">{shown}</td>'


def table(title: str, rows: list[dict]) -> str:
    if not rows:
        return f"<h2>{escaped(title)}</h2><p>none</p>"
    head = "".join(f"<th>{escaped(c)}</th>" for c in rows[0])
    body = "".join("<tr>" + "".join(cell(c, v) for c, v in r.items()) + "</tr>" for r in rows)
    return f"<h2>{escaped(title)}</h2><table><tr>{head}</tr>{body}</table>"


def page(name: str, tables: dict[str, list[dict]]) -> str:
    """A page with one table for each part of :meth:`lodestone.engine.Engine.layout`."""
    style = "body{font-family:sans-serif;margin:2em}td,th{padding:.2em .8em;text-align:left}td.n{text-align:right}"
    parts = "".join(table(title.replace("_", " "), rows) for title, rows in tables.items())
    return f"<!doctype html><html><head><meta charset=utf-8><title>{escaped(name)}</title><style>{style}</style></head><body><h1>{escaped(name)}</h1>{parts}</body></html>"
