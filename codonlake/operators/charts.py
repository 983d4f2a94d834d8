"""The charts of a run, drawn as SVG from the rows of `ranking.bars` and `ranking.heatmap`; nothing but the standard library.

What is drawn is small by its definition: at most TOP_BAR rows a model, and a heatmap of at most TOP_HEATMAP features a model.
Every mark has a tooltip, and the rows themselves are written beside the chart as tables.
"""

from __future__ import annotations

from collections.abc import Iterable
from xml.sax.saxutils import escape

from codonlake.operators.ranking import MODEL_ORDER

#: Ink, muted ink, grid and surface; hue of magnitudes, light to dark; hues of negative and positive coefficients.
INK, MUTED, GRID, SURFACE = "#0b0b0b", "#52514e", "#e1e0d9", "#fcfcfb"
RAMP = ("#cde2fb", "#0d366b")
MAGNITUDE, NEGATIVE, POSITIVE = "#2a78d6", "#2a78d6", "#e34948"
ROW, NAME, WIDE, GAP = 16, 110, 300, 40
KINDS = {"RandomForest": "MDI importance", "LightGBM": "gain", "XGBoost": "gain", "SVR": "drop of R2 when permuted"}


def _text(x: float, y: float, words: str, size: int = 10, anchor: str = "start", ink: str = INK, extra: str = "") -> str:
    return f'<text x="{x:.1f}" y="{y:.1f}" font-size="{size}" text-anchor="{anchor}" fill="{ink}"{extra}>{escape(words)}</text>'


def _bar(x: float, y: float, width: float, fill: str, tip: str) -> str:
    """A bar of a row, rounded at its end, with its tooltip."""
    return f'<rect x="{x:.1f}" y="{y + 2:.1f}" width="{max(width, 0.5):.1f}" height="{ROW - 4}" rx="3" fill="{fill}"><title>{escape(tip)}</title></rect>'


def _whole(width: float, height: float, marks: Iterable[str]) -> str:
    body = "\n".join(marks)
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width:.0f}" height="{height:.0f}" font-family="sans-serif"><rect width="100%" height="100%" fill="{SURFACE}"/>\n{body}\n</svg>\n'


def placed(models: Iterable[str]) -> list[str]:
    return sorted(models, key=lambda m: (MODEL_ORDER.index(m) if m in MODEL_ORDER else len(MODEL_ORDER), m))


def bar_chart(rows: list[dict], label: str) -> str:
    """For each model its features by importance and, where it has coefficients, their signs beside it.

    rows: model, rank, feature, importance, signed_coef, sign.
    """
    marks = [_text(12, 24, f"Feature importance: {label}", 15)]
    top = 44.0
    for model in placed({r["model"] for r in rows}):
        own = sorted((r for r in rows if r["model"] == model), key=lambda r: r["rank"])
        signed = [r for r in own if r["signed_coef"] is not None]
        most = max((r["importance"] for r in own), default=0) or 1
        marks.append(_text(12, top + 12, f"{model}: {KINDS.get(model, '|coefficient|')}", 12))
        left, middle = NAME + 12.0, NAME * 2 + 12.0 + WIDE + GAP + WIDE / 2
        if signed:
            marks.append(_text(middle, top + 12, "signed coefficient", 12, "middle"))
            for x, fill, words in ((middle + 80, NEGATIVE, "negative"), (middle + 140, POSITIVE, "positive")):
                marks += [f'<rect x="{x:.1f}" y="{top + 4:.1f}" width="9" height="9" rx="2" fill="{fill}"/>', _text(x + 12, top + 12, words, 9, ink=MUTED)]
        top += 20
        for r in own:
            y = top + ROW * (r["rank"] - 1)
            marks += [_text(left - 6, y + 12, r["feature"], 9, "end", MUTED), _bar(left, y, WIDE * r["importance"] / most, MAGNITUDE, f"{model} {r['feature']}: {r['importance']:.6g}")]
            if r["signed_coef"] is not None:
                reach = max(abs(s["signed_coef"]) for s in signed) or 1
                width = WIDE / 2 * abs(r["signed_coef"]) / reach
                positive = r["sign"] == "positive"
                marks += [_text(middle - WIDE / 2 - 6, y + 12, r["feature"], 9, "end", MUTED), _bar(middle if positive else middle - width, y, width, POSITIVE if positive else NEGATIVE, f"{model} {r['feature']}: {r['signed_coef']:.6g}")]
        bottom = top + ROW * len(own)
        marks.append(f'<line x1="{left}" x2="{left}" y1="{top:.1f}" y2="{bottom:.1f}" stroke="{GRID}"/>')
        if signed:
            marks.append(f'<line x1="{middle:.1f}" x2="{middle:.1f}" y1="{top:.1f}" y2="{bottom:.1f}" stroke="{MUTED}"/>')
        top = bottom + 24
    return _whole(NAME * 2 + WIDE * 2 + GAP + 40, top, marks)


def shade(value: float) -> str:
    """The step of the ramp for a value from 0 to 1."""
    low, high = ([int(c[i : i + 2], 16) for i in (1, 3, 5)] for c in RAMP)
    return "#" + "".join(f"{round(a + (b - a) * min(max(value, 0), 1)):02x}" for a, b in zip(low, high, strict=True))


def heatmap_chart(rows: list[dict], label: str) -> str:
    """Features by name in rows, models in columns, a model's largest value 1; models without any value stay empty.

    rows: feature, model, value.
    """
    models, features = placed({r["model"] for r in rows}), sorted({r["feature"] for r in rows})
    cell, top = 84, 76.0
    marks = [_text(12, 24, f"Importance by model, the largest is 1: {label}", 15)]
    for i in range(5):
        marks += [f'<rect x="{12 + 26 * i}" y="34" width="24" height="9" fill="{shade(i / 4)}"/>', _text(24 + 26 * i, 53, f"{i / 4:g}", 8, "middle", MUTED)]
    marks += [_text(NAME + 12 + cell * (i + 0.5), top - 6, m, 10, "middle") for i, m in enumerate(models)]
    marks += [_text(NAME + 6, top + ROW * j + 12, f, 9, "end", MUTED) for j, f in enumerate(features)]
    for r in rows:
        x, y = NAME + 12 + cell * models.index(r["model"]), top + ROW * features.index(r["feature"])
        fill = GRID if r["value"] is None else shade(r["value"])
        tip = f"{r['model']} {r['feature']}: {'none' if r['value'] is None else format(r['value'], '.4g')}"
        marks.append(f'<rect x="{x + 1}" y="{y + 1:.1f}" width="{cell - 2}" height="{ROW - 2}" fill="{fill}"><title>{escape(tip)}</title></rect>')
    return _whole(NAME + cell * max(len(models), 4) + 40, top + ROW * len(features) + 16, marks)
