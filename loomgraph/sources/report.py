"""A campaign's report: one HTML page with its drawing. Networks that people read are small, so
a page is made on the driver from the rows of one campaign."""

from __future__ import annotations

import html
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.pairs import KEY


def network_svg(names: list[str], edges: list[tuple[str, str, float, str]], size: int = 640) -> str:
    """Vertices on a circle, ordered so that neighbours stand near; wide lines are cheap edges,
    dashed ones counterpoised. A prefix that all names share is left out."""
    near: dict[str, list[str]] = {n: [] for n in names}
    for u, v, *_ in edges:
        near[u].append(v)
        near[v].append(u)
    seen: list[str] = []
    for start in sorted(names, key=lambda n: (-len(near[n]), n)):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.append(x)
                todo += sorted(near[x], reverse=True)
    place = {n: (size / 2 + size * 0.4 * math.cos(2 * math.pi * i / max(len(seen), 1)), size / 2 + size * 0.4 * math.sin(2 * math.pi * i / max(len(seen), 1))) for i, n in enumerate(seen)}
    prefix = len(_common(names))
    costs = [c for *_, c, k in edges if k != "cbfe"]
    low, high = (min(costs), max(costs)) if costs else (0.0, 1.0)
    lines = []
    for u, v, c, k in edges:
        width = 1.5 if k == "cbfe" else 4 - 3 * (c - low) / ((high - low) or 1)
        dash = ' stroke-dasharray="5 4"' if k == "cbfe" else ""
        (x1, y1), (x2, y2) = place[u], place[v]
        lines.append(f'<line x1="{x1:.1f}" y1="{y1:.1f}" x2="{x2:.1f}" y2="{y2:.1f}" stroke="#567" stroke-width="{width:.2f}"{dash}><title>{html.escape(f"{u}~{v} {c:.3f}")}</title></line>')
    dots = [f'<g><circle cx="{x:.1f}" cy="{y:.1f}" r="14" fill="#def" stroke="#567"/><text x="{x:.1f}" y="{y + 4:.1f}" font-size="10" text-anchor="middle">{html.escape(n[prefix:] or n)}</text></g>' for n, (x, y) in place.items()]
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {size} {size}" width="{size}">{"".join(lines)}{"".join(dots)}</svg>'


def _common(names: list[str]) -> str:
    if len(names) < 2:
        return ""
    a, b = min(names), max(names)
    return a[: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))]


def _table(rows: list, columns: list[str]) -> str:
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape('' if r[c] is None else f'{r[c]:.4g}' if isinstance(r[c], float) else str(r[c]))}</td>" for c in columns) + "</tr>" for r in rows)
    return f"<table><tr>{head}</tr>{body}</table>"


def html_report(vertices: DataFrame, selected: DataFrame, candidates: DataFrame, unmet: DataFrame, summary: DataFrame, campaign, rejected: int = 200) -> str:
    """The page of one campaign: figures, drawing, edges, unmet targets, and the first
    ``rejected`` rejected candidates (a report's limit, named on the page)."""

    def of(df: DataFrame) -> DataFrame:
        return df.where(F.col(KEY) == campaign)

    names = [r.name for r in of(vertices).orderBy("name").collect()]
    edges = of(selected).orderBy("u", "v").collect()
    figures = of(summary).collect()
    lost = of(candidates).where("NOT feasible").orderBy("source", "target")
    n_lost = lost.count()
    parts = [
        f"<h1>Network {html.escape(str(campaign))}</h1>", _table(figures, [c for c in summary.columns if c != KEY]), network_svg(names, [(r.u, r.v, r.total, r.kind) for r in edges]), "<h2>Edges</h2>", _table(edges, ["source", "target", "kind", "total"]),
        "<h2>Unmet</h2><ul>" + "".join(f"<li>{html.escape(r.message)}</li>" for r in of(unmet).orderBy("seq").collect()) + "</ul>", f"<h2>Rejected ({min(rejected, n_lost)} of {n_lost})</h2>", _table(lost.limit(rejected).collect(), ["source", "target"]),
    ]
    style = "<style>body{font:14px sans-serif}td,th{padding:2px 8px;text-align:left}</style>"
    return f"<!doctype html><html><head><meta charset='utf-8'><title>Network</title>{style}</head><body>{''.join(parts)}</body></html>"
