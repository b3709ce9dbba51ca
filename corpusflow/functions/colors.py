"""Colours: Lab coordinates, distances of neighbours in a palette, and contrast of pairs.

{colors}: palette, name, hex. A distance is CIE76 between colours that follow each other by lightness; a palette is safe if none is below MIN_DISTANCE. The linear branch of
the Lab function has no offset, as the operator is defined. Contrast is the ratio of relative luminances, each with a share of stray light.
"""

from __future__ import annotations

from corpusflow.plans import adapters  # noqa: F401  the tables that operators name
from corpusflow.plans.catalog import operator, table

# Matrix and white of the colour space, weights of luminance, and limits.
MATRIX = {"x": ("0.4124564E0", "0.3575761E0", "0.1804375E0", "0.95047E0"), "y": ("0.2126729E0", "0.7151522E0", "0.0721750E0", "1.0E0"), "z": ("0.0193339E0", "0.1191920E0", "0.9503041E0", "1.08883E0")}
MIN_DISTANCE = 20
TEXT_CONTRAST, LARGE_CONTRAST = "4.5E0", "3.0E0"

# Palettes of the parts: a colour from each size and price of a brand.
_hex = lambda v: f"substr('0123456789abcdef', cast($div({v}, 16) AS INT) + 1, 1) || substr('0123456789abcdef', cast({v} % 16 AS INT) + 1, 1)"
table("colors", f"SELECT p_brand AS palette, 'c' || $text(p_partkey) AS name, '#' || {_hex('(p_partkey * 37 % 256)')} || {_hex('($long(p_size) * 5 % 256)')} || {_hex('($floor(p_retailprice) % 256)')} AS hex FROM {{part}}")
table("color_pairs", "SELECT palette, name AS text_name, back AS back_name, large FROM (SELECT palette, name, lead(name) OVER (PARTITION BY palette ORDER BY hex, name) AS back, substr(hex, 2, 1) < '8' AS large FROM {colors}) WHERE back IS NOT NULL")

_channel = lambda at: f"$double($hexint(substr(hex, {at}, 2))) / 255E0"
_linear = "CASE WHEN {0} <= 0.04045E0 THEN {0} / 12.92E0 ELSE power(({0} + 0.055E0) / 1.055E0, 2.4E0) END"
_cube = "power(6E0 / 29E0, 3E0)"
_lab = f"""
c AS (SELECT palette, name, hex, {_channel(2)} AS r, {_channel(4)} AS g, {_channel(6)} AS b FROM {{colors}}),
l AS (SELECT palette, name, hex, {', '.join(f"{_linear.format(k)} AS {k}" for k in 'rgb')} FROM c),
t AS (SELECT palette, name, hex, r, g, b, {', '.join(f"(r * {m[0]} + g * {m[1]} + b * {m[2]}) / {m[3]} AS {k}" for k, m in MATRIX.items())} FROM l),
f AS (SELECT palette, name, hex, r, g, b, {', '.join(f"CASE WHEN {k} <= {_cube} THEN {k} / (3E0 * {_cube}) ELSE power({k}, 1E0 / 3E0) END AS f{k}" for k in 'xyz')} FROM t),
lab AS (SELECT palette, name, hex, r, g, b, 116E0 * fy - 16E0 AS li, 500E0 * (fx - fy) AS la, 200E0 * (fy - fz) AS lb FROM f)"""
operator(
    "fn_color_lab",
    f"""
WITH {_lab},
n AS (SELECT palette, name, hex, li, la, lb, lead(name) OVER w AS next_name, lead(li) OVER w AS ni, lead(la) OVER w AS na, lead(lb) OVER w AS nb FROM lab WINDOW w AS (PARTITION BY palette ORDER BY round(li, 9), name))
SELECT palette, name, round(li, 6) AS lightness, round(la, 6) AS a, round(lb, 6) AS b, next_name, round(sqrt(power(li - ni, 2E0) + power(la - na, 2E0) + power(lb - nb, 2E0)), 2) AS delta_e,
       coalesce(round(sqrt(power(li - ni, 2E0) + power(la - na, 2E0) + power(lb - nb, 2E0)), 2) >= {MIN_DISTANCE}, true) AS safe
FROM n
""",
    "Lab coordinates of colours and their distance from the next by lightness in a palette.",
)
operator(
    "val_contrast",
    f"""
WITH {_lab.split("t AS (")[0].rstrip().rstrip(",")},
y AS (SELECT palette, name, 0.2126E0 * r + 0.7152E0 * g + 0.0722E0 * b AS lum FROM l),
p AS (SELECT x.palette, x.text_name, x.back_name, x.large, (greatest(a.lum, b.lum) + 0.05E0) / (least(a.lum, b.lum) + 0.05E0) AS ratio
      FROM {{color_pairs}} x JOIN y a ON a.palette = x.palette AND a.name = x.text_name JOIN y b ON b.palette = x.palette AND b.name = x.back_name)
SELECT palette, text_name, back_name, large, round(ratio, 6) AS ratio, ratio >= CASE WHEN large THEN {LARGE_CONTRAST} ELSE {TEXT_CONTRAST} END AS passes FROM p
""",
    "Contrast of pairs of colours against the limit for their size of text.",
)
