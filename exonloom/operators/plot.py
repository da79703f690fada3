"""ROC curves as SVG. The points come from a curve table of some 400 rows a model at most."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame

WIDTH, HEIGHT, LEFT, TOP, SIDE = 920, 680, 90, 60, 520
COLOURS = ("#1f77b4", "#d62728", "#2ca02c", "#9467bd", "#ff7f0e", "#17becf")


def _path(points: list[tuple[float, float]], smooth: bool) -> str:
    xy = [(LEFT + x * SIDE, TOP + (1 - y) * SIDE) for x, y in points]
    if not smooth or len(xy) < 3:
        return "M" + " L".join(f"{x:.1f},{y:.1f}" for x, y in xy)
    d = f"M{xy[0][0]:.1f},{xy[0][1]:.1f}"
    for (x, y), (x2, y2) in zip(xy[1:-1], xy[2:]):
        d += f" Q{x:.1f},{y:.1f} {(x + x2) / 2:.1f},{(y + y2) / 2:.1f}"
    return d + f" L{xy[-1][0]:.1f},{xy[-1][1]:.1f}"


def roc_svg(curve: DataFrame, aucs: DataFrame, title: str = "ROC", smooth: bool = True) -> str:
    """SVG text of the curves of (model, idx, fpr, tpr), with grid, diagonal and a legend of (model, auc)."""
    auc = {r.model: r.auc for r in aucs.collect()}
    lines: dict[str, list[tuple[float, float]]] = {}
    for r in curve.orderBy("model", "idx").collect():
        lines.setdefault(r.model, []).append((r.fpr, r.tpr))
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{HEIGHT}" font-family="sans-serif">', f'<rect width="{WIDTH}" height="{HEIGHT}" fill="white"/>', f'<text x="{WIDTH / 2}" y="34" text-anchor="middle" font-size="20">{escape(title)}</text>']
    for k in range(11):
        x, y = LEFT + k * SIDE / 10, TOP + k * SIDE / 10
        out.append(f'<path d="M{x:.1f},{TOP} V{TOP + SIDE} M{LEFT},{y:.1f} H{LEFT + SIDE}" stroke="#ddd" fill="none"/>')
        if k % 2 == 0:
            out.append(f'<text x="{x:.1f}" y="{TOP + SIDE + 20}" text-anchor="middle" font-size="12">{k / 10:.1f}</text><text x="{LEFT - 10}" y="{y + 4:.1f}" text-anchor="end" font-size="12">{1 - k / 10:.1f}</text>')
    out.append(f'<path d="M{LEFT},{TOP + SIDE} L{LEFT + SIDE},{TOP}" stroke="#999" stroke-dasharray="6 5" fill="none"/>')
    for k, (name, pts) in enumerate(lines.items()):
        c = COLOURS[k % len(COLOURS)]
        out.append(f'<path d="{_path(pts, smooth)}" stroke="{c}" stroke-width="2.5" fill="none"/>')
        value = f" (AUC {auc[name]:.4f})" if auc.get(name) is not None else ""
        out.append(f'<path d="M{LEFT + SIDE + 30},{TOP + 20 + 26 * k} h28" stroke="{c}" stroke-width="3"/><text x="{LEFT + SIDE + 66}" y="{TOP + 25 + 26 * k}" font-size="13">{escape(name)}{value}</text>')
    return "\n".join([*out, "</svg>"])
