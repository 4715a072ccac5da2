"""A report of result tables as one HTML file without outside parts; tables are small by the time they get here."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.jsonl import write_text
from . import views
from .analysis import Result

STYLE = "body{font:15px/1.5 system-ui,sans-serif;max-width:70rem;margin:2rem auto;padding:0 1rem}table{border-collapse:collapse}td,th{padding:.2rem .6rem;border-bottom:1px solid #ccc}td.n{text-align:right}svg{max-width:100%}tr.new{background:#fff4d6}@media(prefers-color-scheme:dark){body{background:#16181c;color:#e6e6e6}tr.new{background:#4a3b12}}"


def shown(v: object, column: str = "") -> str:
    """A value as text: shares in percent, growth as a multiple with an arrow, slopes with their sign, thousands grouped."""
    if v is None or v != v:
        return "–"
    if isinstance(v, float):
        if column.endswith("_pct") or column == "pct":
            return f"{v:.2f}%"
        if column == "growth_ratio":
            return f"{'▲' if v >= 1 else '▼'} {v:.2f}×"
        if column in ("slope_pp_per_year", "delta_pp", "log2_ratio"):
            return f"{v:+.3f}"
        return f"{v:,.2f}" if abs(v) < 1000 else f"{v:,.0f}"
    return f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) and abs(v) > 9999 else str(v)


def grid(df: DataFrame, mark: str | None = None) -> str:
    rows = df.collect()
    columns = [c for c in df.columns if c != mark]
    number = {c for c, t in df.dtypes if t in ("int", "bigint", "double", "float")}
    cell = lambda c, v: f"<td{' class=n' if c in number else ''}>{html.escape(shown(v, c))}</td>"
    body = "".join(f"<tr{' class=new' if mark and r[mark] else ''}>" + "".join(cell(c, r[c]) for c in columns) + "</tr>" for r in rows)
    return "<table><tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in columns) + f"</tr>{body}</table>"


def lines(df: DataFrame, name: str, x: str, y: str, width: int = 640, height: int = 220) -> str:
    """An SVG line for each value of ``name``."""
    rows = df.select(name, x, y).orderBy(name, x).collect()
    if not rows:
        return ""
    xs, ys = [r[x] for r in rows], [r[y] or 0.0 for r in rows]
    fx = lambda v: 40 + (width - 60) * (v - min(xs)) / max(1, max(xs) - min(xs))
    fy = lambda v: height - 25 - (height - 45) * v / (max(ys) or 1.0)
    names, out = sorted({r[name] for r in rows}), []
    for i, k in enumerate(names):
        path = " ".join(f"{fx(r[x]):.1f},{fy(r[y] or 0.0):.1f}" for r in rows if r[name] == k)
        hue = 360 * i // len(names)
        out.append(f'<polyline fill="none" stroke="hsl({hue} 60% 45%)" stroke-width="2" points="{path}"/><text x="{45 + 110 * i}" y="12" fill="hsl({hue} 60% 45%)" font-size="12">{html.escape(str(k))}</text>')
    out.append(f'<text x="40" y="{height - 5}" font-size="11">{min(xs)}</text><text x="{width - 40}" y="{height - 5}" font-size="11">{max(xs)}</text>')
    return f'<svg viewBox="0 0 {width} {height}" role="img">{"".join(out)}</svg>'


def build(result: Result, source: str, path: str, headline: list[str] | None = None) -> None:
    """Key figures, risers and fallers, lines, ruler, heat map, growth, forms, pairs, emerging terms, examples."""
    cy, g = result.concept_year, result.growth
    top = headline or [r.concept for r in views.panels(cy.where(F.col("source") == source)).orderBy(F.desc("volume")).limit(8).collect()]
    years = [r.year for r in cy.select("year").distinct().orderBy("year").collect()]
    parts = [
        ("Key figures", grid(views.kpis(result.totals, cy))),
        ("Rising and falling", grid(views.risers_and_fallers(g, source))),
        ("Documents by source", lines(result.totals, "source", "year", "in_domain")),
        ("Headline concepts", lines(views.line_table(cy.where(F.col("source") == source), top), "concept", "year", "share_pct")),
        ("First appearance", grid(views.ruler(g, source, max(years, default=0)))),
        ("Concepts by volume", grid(views.panels(cy))),
        ("Heat map", grid(views.heatmap_pivot(cy, source, years).orderBy(F.desc("volume")))),
        ("Growth", grid(views.growth_bars(g, source).orderBy(F.desc("log2_ratio")))),
        *((f"Surface forms of {k}", grid(views.surface_forms(result.synonym_year.where(F.col("source") == source), k).orderBy("year", "base_pct"))) for k in top[:3]),
        ("Pairs", grid(views.cooccurrence_head(result.cooccurrence).orderBy("source", "rank"))),
        ("Emerging terms", grid(views.emerging_head(result.emerging).orderBy("source", "rank"), mark="uncovered")),
        ("Examples", grid(views.example_list(result.examples))),
    ]
    body = "".join(f"<h2>{html.escape(t)}</h2>{x}" for t, x in parts)
    write_text(result.matched.sparkSession, path, f"<!doctype html><meta charset=utf-8><title>Term trends</title><style>{STYLE}</style><h1>Term trends</h1>{body}")
