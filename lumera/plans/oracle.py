"""DuckDB SQL for the queries, written from the formulas and not from the Spark plans."""

from __future__ import annotations

# Published conversion matrices, row by row (here once more, so that a wrong one in the library shows).
RGB_TO_XYZ = (
    (0.41239079926595948, 0.35758433938387796, 0.18048078840183429),
    (0.21263900587151036, 0.71516867876775593, 0.072192315360733715),
    (0.019330818715591851, 0.11919477979462599, 0.95053215224966058),
)
XYZ_TO_RGB = (
    (3.2409699419045214, -1.5373831775700935, -0.49861076029300328),
    (-0.96924363628087983, 1.8759675015077207, 0.041555057407175613),
    (0.055630079696993609, -0.20397695888897657, 1.0569715142428786),
)
XYZ_TO_LMS = ((0.4002, 0.7075, -0.0807), (-0.228, 1.15, 0.0612), (0.0, 0.0, 0.9184))
LMS_TO_XYZ = ((1.8501, -1.1385, 0.2384), (0.3668, 0.6438, -0.0107), (0.0, 0.0, 1.0889))
XYZ_TO_CAT02 = ((0.7328, 0.4296, -0.1624), (-0.7036, 1.6974, 0.0061), (0.0030, 0.0136, 0.9834))
CAT02_TO_XYZ = ((1.0961, -0.2789, 0.1827), (0.4544, 0.4736, 0.0721), (-0.0096, -0.0057, 1.0153))
XYZ_TO_HPE = ((0.38971, 0.68898, -0.07868), (-0.22981, 1.18340, 0.04641), (0.0, 0.0, 1.0))
HPE_TO_XYZ = ((1.91020, -1.11212, 0.20191), (0.37095, 0.62905, -0.00001), (0.0, 0.0, 1.0))
LMS_TO_IPT = ((0.4, 0.4, 0.2), (4.455, -4.851, 0.396), (0.8056, 0.3572, -1.1628))
IPT_TO_LMS = ((1.0, 0.0976, 0.2052), (1.0, -0.1139, 0.1332), (1.0, 0.0326, -0.6769))
#: Tristimulus values of the D65 white.
D65 = (96.047, 100.0, 108.883)

EV = """ev AS (SELECT 'ev' AS image_id, (event_id % 50)::INT AS x, (event_id // 50)::INT AS y, value AS c1,
  (props->>'$.k')::DOUBLE + 1 AS c2, hour(ts) + minute(ts) / 60.0::DOUBLE AS c3 FROM events)"""
ORD = """ord AS (SELECT 'ord' AS image_id, (o_orderkey % 50)::INT AS x, (o_orderkey // 50)::INT AS y,
  o_totalprice / 1000 * (0.90::DOUBLE + 0.01::DOUBLE * (o_orderkey % 11)) AS c1, o_totalprice / 1000 AS c2,
  o_totalprice / 1000 * (0.95::DOUBLE + 0.02::DOUBLE * (o_orderkey % 13)) AS c3 FROM orders)"""


def _sq(j: int) -> str:
    v = f"embedding[3 * k + {j + 1}]::DOUBLE"
    return f"100 * ({v} * {v}) AS c{j + 1}"


EMB = f"""emb AS (SELECT 'emb' AS image_id, k::INT AS x, vec_id::INT AS y, {_sq(0)}, {_sq(1)}, {_sq(2)}
  FROM embeddings, (SELECT unnest(range(0, 21)) AS k))"""
BAT = f"""bat AS (SELECT label::VARCHAR AS image_id, k::INT AS x, n::INT AS y, {_sq(0)}, {_sq(1)}, {_sq(2)}
  FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS n FROM embeddings), (SELECT unnest(range(0, 21)) AS k))"""


def row(m, i: int, names=("c1", "c2", "c3")) -> str:  # noqa: ANN001
    """Row ``i`` of a linear map of three columns."""
    return "(" + " + ".join(f"{a!r}::DOUBLE * ({n})" for a, n in zip(m[i], names, strict=True)) + ")"


def lum(names=("c1", "c2", "c3")) -> str:  # noqa: ANN001
    return row(RGB_TO_XYZ, 1, names)


def rnd(e: str, places: int = 6) -> str:
    """A number for comparison; -0 is 0."""
    return f"round({e}, {places}) + 0.0"


def pixel(v: str) -> str:
    """Inverse pixel mapping."""
    r = f"round((CASE WHEN isnan({v}) THEN 2.0 ELSE least(2.0, greatest(-1.0, {v})) END)::DOUBLE * 65535, 6)"
    return f"(CASE WHEN {r} < 0 THEN 0 ELSE least(65535, floor({r})::INT + 1) END)::INT"


def whole(v: str) -> str:
    return f"floor(round(CASE WHEN isnan({v}) OR ({v}) < 0 THEN 0.0 ELSE least(65535.0, {v}) END, 6))::INT"


def gamma(v: str) -> str:
    return pixel(f"(CASE WHEN ({v}) > 0 AND NOT isnan({v}) THEN pow({v}, 1 / 1.8::DOUBLE) ELSE {v} END)")


LDR = "65535 AS a"
C = ("c1", "c2", "c3")

SQL: dict[str, str] = {}

SQL["linear_tmo"] = f"""WITH {EV}, s AS (SELECT min(least(c1, c2, c3)) AS lo, max(greatest(c1, c2, c3)) AS hi FROM ev)
SELECT image_id, x, y, {", ".join(f"{whole(f'(65535 * ({c} - lo) / (hi - lo))')} AS {n}" for c, n in zip(C, "rgb", strict=True))}, {LDR} FROM ev, s"""

_batch = ", ".join(f"{whole(f'(65535 * ({c} - lo) / (hi - lo))')} AS {n}" for c, n in zip(C, "rgb", strict=True))
SQL["linear_batch"] = f"""WITH {BAT}, s AS (SELECT image_id, min(least(c1, c2, c3)) AS lo, max(greatest(c1, c2, c3)) AS hi FROM bat GROUP BY image_id)
SELECT image_id, x, y, {_batch}, {LDR} FROM bat JOIN s USING (image_id)"""

_log = lambda c: f"(65535 * (CASE WHEN {c} > lo THEN ln({c} - lo) ELSE '-inf'::DOUBLE END) / ln(hi - lo))"
SQL["log_tmo"] = f"""WITH {EV}, s AS (SELECT min(least(c1, c2, c3)) AS lo, max(greatest(c1, c2, c3)) AS hi FROM ev)
SELECT image_id, x, y, {", ".join(f"{whole(_log(c))} AS {n}" for c, n in zip(C, "rgb", strict=True))}, {LDR} FROM ev, s"""

SQL["drago_tmo"] = f"""WITH {ORD}, s AS (SELECT exp(avg(ln(c2 + 1e-4))) AS mean, max(c2) AS top FROM ord),
t AS (SELECT *, c2 / mean AS q, top / mean AS peak FROM ord, s),
u AS (SELECT *, ln(q + 1) / ln(2 + 8 * pow(q / peak, log10(0.5::DOUBLE) / ln(0.5::DOUBLE))) / log10(peak + 1) / c2 AS k FROM t)
SELECT image_id, x, y, {", ".join(f"{pixel(row(XYZ_TO_RGB, i, ('c1 * k', 'c2 * k', 'c3 * k')))} AS {n}" for i, n in enumerate("rgb"))}, {LDR} FROM u"""

SAMPLE = """h AS (SELECT trunc((max(y) + 1)::FLOAT * 0.6::FLOAT)::INT AS rows FROM ev),
few AS (SELECT ev.x, v.y, c1, c2, c3 FROM (SELECT unnest(range(0, rows))::INT AS y FROM h) v JOIN ev ON ev.y = trunc(v.y::FLOAT * 0.6::FLOAT)::INT)"""
SQL["quick_sample_rows"] = f"WITH {EV}, {SAMPLE} SELECT x, y, {', '.join(f'{rnd(c)} AS {c}' for c in C)} FROM few"


def _reinhard(c: str, n: int) -> str:
    own = f"(0.89::DOUBLE * {c} + (1 - 0.89::DOUBLE) * lum)"
    mean = f"(0.89::DOUBLE * av{n} + (1 - 0.89::DOUBLE) * av)"
    return f"(CASE WHEN {c} = 0 THEN 0.0 ELSE {c} / ({c} + pow(exp(5.0::DOUBLE) * (0.89::DOUBLE * {own} + (1 - 0.89::DOUBLE) * {mean}), m)) END)"


_values = ", ".join(f"{_reinhard(c, i)} AS v{i}" for i, c in enumerate(C))
_scaled = lambda names: ", ".join(f"{gamma(f'((v{i} - lo) / (hi - lo))')} AS {n}" for i, n in enumerate(names))
SQL["reinhard_tmo"] = f"""WITH {EV}, {SAMPLE}, l AS (SELECT *, {lum()} AS lum FROM few),
s AS (SELECT avg(c1) AS av0, avg(c2) AS av1, avg(c3) AS av2, avg(lum) AS av,
  0.3::DOUBLE + 0.7::DOUBLE * pow((ln(max(lum)) - avg(ln(lum + 2.3e-5))) / (ln(max(lum)) - (CASE WHEN min(lum) > 0 THEN ln(min(lum)) ELSE '-inf'::DOUBLE END)), 1.4::DOUBLE) AS m FROM l),
w AS (SELECT least(1.0, min(least(v0, v1, v2))) AS lo, greatest(0.0, max(greatest(v0, v1, v2))) AS hi FROM (SELECT {_values} FROM l, s WHERE lum <> 0)),
p AS (SELECT image_id, x, y, {_values} FROM (SELECT *, {lum()} AS lum FROM ev), s)
SELECT image_id, x, y, {_scaled("rgb")}, {LDR} FROM p, w"""

_custom = lambda c: f"(CASE WHEN {c} = 0 THEN 0.0 ELSE {c} / ({c} + pow(lum, lum)) END)"
SQL["custom_reinhard_tmo"] = f"""WITH {EV}, {SAMPLE}, l AS (SELECT *, {lum()} AS lum FROM few),
w AS (SELECT least(1.0, min(least(v0, v1, v2))) AS lo, greatest(0.0, max(greatest(v0, v1, v2))) AS hi
  FROM (SELECT {", ".join(f"{_custom(c)} AS v{i}" for i, c in enumerate(C))} FROM l WHERE lum <> 0))
SELECT image_id, x, y, {", ".join(f"{gamma(f'(({c} - lo) / (hi - lo))')} AS {n}" for c, n in zip(C, "rgb", strict=True))}, {LDR} FROM ev, w"""

# A batch of images, one of them black: statistics by image; x / 0 spelled out.
BLACK = f"""{BAT}, blk AS (SELECT image_id, x, y, CASE WHEN dark THEN 0.0 ELSE c1 END AS c1, CASE WHEN dark THEN 0.0 ELSE c2 END AS c2, CASE WHEN dark THEN 0.0 ELSE c3 END AS c3
  FROM (SELECT *, image_id = '0' OR (x + y) % 17 = 0 AS dark FROM bat))"""
BLACK_FEW = """h AS (SELECT image_id, trunc((max(y) + 1)::FLOAT * 0.6::FLOAT)::INT AS rows FROM blk GROUP BY image_id),
few AS (SELECT blk.* FROM (SELECT image_id, unnest(range(0, rows)) AS t FROM h) v JOIN blk ON blk.image_id = v.image_id AND blk.y = trunc(v.t::FLOAT * 0.6::FLOAT)::INT)"""
_flat = lambda c: whole(f"(CASE WHEN hi > lo THEN 65535 * ({c} - lo) / (hi - lo) ELSE 'nan'::DOUBLE END)")
SQL["tmo_black_batch_linear"] = f"""WITH {BLACK}, s AS (SELECT image_id, min(least(c1, c2, c3)) AS lo, max(greatest(c1, c2, c3)) AS hi FROM blk GROUP BY image_id)
SELECT image_id, x, y, {", ".join(f"{_flat(c)} AS {n}" for c, n in zip(C, "rgb", strict=True))}, {LDR} FROM blk JOIN s USING (image_id)"""
_xyz = ", ".join(f"{row(RGB_TO_XYZ, i)} AS x{i}" for i in range(3))
SQL["tmo_black_batch_drago"] = f"""WITH {BLACK}, v AS (SELECT image_id, x, y, {_xyz} FROM blk),
s AS (SELECT image_id, exp(avg(ln(x1 + 1e-4))) AS mean, max(x1) AS top FROM v GROUP BY image_id),
u AS (SELECT *, CASE WHEN x1 = 0 THEN 'nan'::DOUBLE
  ELSE ln(x1 / mean + 1) / ln(2 + 8 * pow(x1 / mean / (top / mean), log10(0.5::DOUBLE) / ln(0.5::DOUBLE))) / log10(top / mean + 1) / x1 END AS k FROM v JOIN s USING (image_id))
SELECT image_id, x, y, {", ".join(f"{pixel(row(XYZ_TO_RGB, i, ('x0 * k', 'x1 * k', 'x2 * k')))} AS {n}" for i, n in enumerate("rgb"))}, {LDR} FROM u"""
_white = lambda e: f"(CASE WHEN hi < lo THEN ({e} - lo) / (hi - lo) WHEN hi = lo THEN 'nan'::DOUBLE ELSE ({e} - lo) / (hi - lo) END)"
SQL["tmo_black_batch_reinhard"] = f"""WITH {BLACK}, {BLACK_FEW}, l AS (SELECT *, {lum()} AS lum FROM few),
s AS (SELECT image_id, avg(c1) AS av0, avg(c2) AS av1, avg(c3) AS av2, avg(lum) AS av, CASE WHEN max(lum) = 0 THEN 'nan'::DOUBLE WHEN min(lum) > 0 THEN
  0.3::DOUBLE + 0.7::DOUBLE * pow((ln(max(lum)) - avg(ln(lum + 2.3e-5))) / (ln(max(lum)) - ln(CASE WHEN min(lum) > 0 THEN min(lum) ELSE 1 END)), 1.4::DOUBLE) ELSE 0.3::DOUBLE END AS m
  FROM (SELECT *, CASE WHEN lum > 0 THEN lum ELSE 0 END AS safe FROM l) GROUP BY image_id),
w AS (SELECT image_id, least(1.0, min(least(v0, v1, v2)) FILTER (lum <> 0)) AS lo, greatest(0.0, max(greatest(v0, v1, v2)) FILTER (lum <> 0)) AS hi
  FROM (SELECT image_id, lum, {_values} FROM l JOIN s USING (image_id)) GROUP BY image_id),
p AS (SELECT image_id, x, y, {_values} FROM (SELECT *, {lum()} AS lum FROM blk) JOIN s USING (image_id))
SELECT image_id, x, y, {", ".join(f"{gamma(_white(f'v{i}'))} AS {n}" for i, n in enumerate("rgb"))}, {LDR} FROM p JOIN w USING (image_id)"""
SQL["tmo_black_batch_custom_reinhard"] = f"""WITH {BLACK}, {BLACK_FEW}, l AS (SELECT *, {lum()} AS lum FROM few),
w AS (SELECT image_id, least(1.0, min(least(v0, v1, v2)) FILTER (lum <> 0)) AS lo, greatest(0.0, max(greatest(v0, v1, v2)) FILTER (lum <> 0)) AS hi
  FROM (SELECT image_id, lum, {", ".join(f"{_custom(c)} AS v{i}" for i, c in enumerate(C))} FROM l) GROUP BY image_id)
SELECT image_id, x, y, {", ".join(f"{gamma(_white(c))} AS {n}" for c, n in zip(C, "rgb", strict=True))}, {LDR} FROM blk JOIN w USING (image_id)"""

SQL["filter_log10"] = f"WITH {EMB} SELECT x, y, {', '.join(f'{rnd(f'log10(greatest({c}, 1e-4))')} AS {c}' for c in C)} FROM emb"
_pow = lambda c: f"pow(10.0, CASE WHEN {c} > 12 THEN 0.0 ELSE {c} END)"
SQL["filter_pow10"] = f"WITH {EMB} SELECT x, y, {', '.join(f'CASE WHEN {_pow(c)} < 1e6 THEN round({_pow(c)}, 4) ELSE round({_pow(c)} / 1e6, 4) * 1e6 END AS {c}' for c in C)} FROM emb"
SQL["apply2_ratio"] = f"WITH {EV}, {ORD} SELECT x, y, {', '.join(f'{rnd(f'ev.{c} / (ord.{c} + 1)')} AS {c}' for c in C)} FROM ev JOIN ord USING (x, y)"

_near = lambda e: ", ".join(f"{rnd(e(c))} AS {c}" for c in C)


def box(src: str, axis: str, r: int) -> str:
    """One box pass, pixel by pixel: clamped neighbours joined and averaged."""
    other = "y" if axis == "x" else "x"
    return f"""SELECT a.x, a.y, {", ".join(f"avg(b.{c}) AS {c}" for c in C)}
  FROM (SELECT x, y, greatest(0, least(max({axis}) OVER (), {axis} + d)) AS t FROM {src}, (SELECT unnest(range({-r}, {r + 1})) AS d)) a
  JOIN {src} b ON b.{axis} = a.t AND b.{other} = a.{other} GROUP BY a.x, a.y"""


SQL["box_blur_h"] = f"WITH {EMB}, q AS ({box('emb', 'x', 4)}) SELECT x, y, {_near(str)} FROM q"
SQL["box_blur_v"] = f"WITH {EMB}, q AS ({box('emb', 'y', 4)}) SELECT x, y, {_near(str)} FROM q"
# Deviation 3 gives boxes of 5, 5 and 7 pixels.
SQL["fast_gaussian"] = f"""WITH {EMB}, q1 AS ({box('emb', 'x', 2)}), q2 AS ({box('q1', 'y', 2)}), q3 AS ({box('q2', 'x', 2)}), q4 AS ({box('q3', 'y', 2)}),
q5 AS ({box('q4', 'x', 3)}), q6 AS ({box('q5', 'y', 3)}) SELECT x, y, {_near(str)} FROM q6"""


def stack(src: str, axis: str, r: int) -> str:
    other = "y" if axis == "x" else "x"
    return f"""SELECT a.x, a.y, {", ".join(f"sum(b.{c} * k) / {(r + 1) ** 2} AS {c}" for c in C)}
  FROM (SELECT x, y, {r + 1} - abs(d) AS k, greatest(0, least(max({axis}) OVER (), {axis} + d)) AS t FROM {src}, (SELECT unnest(range({-r}, {r + 1})) AS d)) a
  JOIN {src} b ON b.{axis} = a.t AND b.{other} = a.{other} GROUP BY a.x, a.y"""


SQL["stack_blur"] = f"WITH {EMB}, q1 AS ({stack('emb', 'x', 5)}), q2 AS ({stack('q1', 'y', 5)}) SELECT x, y, {_near(str)} FROM q2"

# The luminance grid: cell sums, two (1, 2, 1)/4 passes along each axis, reading between eight corners.
RGB_VALUES = (row(RGB_TO_XYZ, 0), lum(), row(RGB_TO_XYZ, 2))


def grid(values=RGB_VALUES, space: str = "16.0::DOUBLE") -> str:  # noqa: ANN001
    """The cells of ``src``: ``values`` are its X, Y and Z, ``space`` the step in pixels."""
    return f"""l AS (SELECT image_id, x, y, {values[0]} AS vx, {values[1]} AS vy, {values[2]} AS vz, c1, c2, c3 FROM src),
  s AS (SELECT *, floor(mx / space)::INT + 5 AS n0, floor(my / space)::INT + 5 AS n1, floor((hi - lo) / step)::INT + 5 AS n2
  FROM (SELECT min(vy) AS lo, max(vy) AS hi, (max(vy) - min(vy)) * 0.1::DOUBLE AS step, max(x) AS mx, max(y) AS my, {space} AS space FROM l)),
  g AS (SELECT floor(x / space + 0.5)::INT + 2 AS g0, floor(y / space + 0.5)::INT + 2 AS g1, floor((vy - lo) / step + 0.5)::INT + 2 AS g2, sum(vy) AS v, count(*)::DOUBLE AS w
  FROM l, s GROUP BY 1, 2, 3)"""


GRID = grid()


def _pass(src: str, axis: int, axes: int = 3, sums=("v", "w")) -> str:  # noqa: ANN001
    keys = ", ".join(f"g{i} + d AS g{i}" if i == axis else f"g{i}" for i in range(axes))
    cell = ", ".join(f"g{i}" for i in range(axes))
    return f"""SELECT {cell}, {", ".join(f"sum({v} * f) AS {v}" for v in sums)} FROM (SELECT {keys}, {", ".join(sums)}, (2 - abs(d)) / 4.0::DOUBLE AS f FROM {src}, (SELECT unnest([-1, 0, 1]) AS d)), s
  WHERE g{axis} BETWEEN 1 AND n{axis} - 2 GROUP BY {cell}"""


def passes(axes: int = 3, sums=("v", "w")) -> str:  # noqa: ANN001
    return ", ".join(f"p{i} AS ({_pass(f'p{i - 1}' if i else 'g', i // 2, axes, sums)})" for i in range(2 * axes))


PASSES = passes()


def corner(axes: int) -> tuple[str, str, str]:
    """Weight of a corner, all corners as relations, and where the corner's cell is."""
    weight = " * ".join(f"(CASE WHEN d{i} = 1 THEN q{i} - b{i} ELSE 1 - (q{i} - b{i}) END)" for i in range(axes))
    all_ = " ".join(f"CROSS JOIN (SELECT unnest([0, 1]) AS d{i})" for i in range(axes))
    return weight, all_, " AND ".join(f"g{i} = b{i} + d{i}" for i in range(axes))


_weight, _corners, _cell = corner(3)
READ = f"""placed AS (SELECT *, x / space + 2 AS q0, y / space + 2 AS q1, (vy - lo) / step + 2 AS q2, floor(x / space + 2)::INT AS b0, floor(y / space + 2)::INT AS b1,
  floor((vy - lo) / step + 2)::INT AS b2 FROM l, s),
base AS (SELECT x, y, sum(coalesce(CASE WHEN p5.w <> 0 THEN p5.v / p5.w END, 0) * {_weight}) AS yb
  FROM placed {_corners} LEFT JOIN p5 ON {_cell} GROUP BY x, y)"""
SRC = "src AS (SELECT * FROM emb)"
SQL["bilateral_splat"] = f"WITH {EMB}, {SRC}, {GRID} SELECT g0, g1, g2, {rnd('v')} AS s1, w FROM g"
SQL["bilateral_grid"] = f"WITH {EMB}, {SRC}, {GRID}, {PASSES} SELECT g0, g1, g2, {rnd('v')} AS s1, {rnd('w')} AS w FROM p5"
_out = ("vx - (vy - yb)", "yb", "vz - (vy - yb)")
SQL["y_fast_bilateral"] = f"""WITH {EMB}, {SRC}, {GRID}, {PASSES}, {READ}
SELECT x, y, {", ".join(f"{rnd(row(XYZ_TO_RGB, i, _out))} AS {c}" for i, c in enumerate(C))} FROM l JOIN base USING (x, y)"""
# The grid of five axes: all three channels are value axes and sums.
_five = ("v1", "v2", "v3", "w")
_depth = [f"({c} - lo{i}) / step" for i, c in enumerate(C)]
_q = ["x / 16.0::DOUBLE", "y / 16.0::DOUBLE", *_depth]
_weight5, _corners5, _cell5 = corner(5)
SQL["fast_bilateral_5d"] = f"""WITH {EMB},
m AS (SELECT min(c1) AS lo0, min(c2) AS lo1, min(c3) AS lo2, max(c1) AS hi0, max(c2) AS hi1, max(c3) AS hi2, max(x) AS mx, max(y) AS my FROM emb),
s AS (SELECT *, floor(mx / 16.0::DOUBLE)::INT + 5 AS n0, floor(my / 16.0::DOUBLE)::INT + 5 AS n1, {", ".join(f"floor((hi{i} - lo{i}) / step)::INT + 5 AS n{i + 2}" for i in range(3))}
  FROM (SELECT *, (greatest(hi0, hi1, hi2) - least(lo0, lo1, lo2)) * 0.1::DOUBLE AS step FROM m)),
g AS (SELECT {", ".join(f"floor({q} + 0.5)::INT + 2 AS g{i}" for i, q in enumerate(_q))}, sum(c1) AS v1, sum(c2) AS v2, sum(c3) AS v3, count(*)::DOUBLE AS w FROM emb, s GROUP BY 1, 2, 3, 4, 5),
{passes(5, _five)},
placed AS (SELECT x, y, {", ".join(f"{q} + 2 AS q{i}, floor({q} + 2)::INT AS b{i}" for i, q in enumerate(_q))} FROM emb, s),
r AS (SELECT x, y, {", ".join(f"sum(p9.{v} * {_weight5}) AS {v}" for v in _five)} FROM placed {_corners5} JOIN p9 ON {_cell5} GROUP BY x, y)
SELECT x, y, {", ".join(f"{rnd(f'v{i} / w')} AS c{i}" for i in (1, 2, 3))} FROM r"""
LOG = "src AS (SELECT image_id, x, y, log10(greatest(c1, 1e-4)) AS c1, log10(greatest(c2, 1e-4)) AS c2, log10(greatest(c3, 1e-4)) AS c3 FROM emb)"
_fin = lambda e: f"(CASE WHEN isnan({e}) OR isinf({e}) THEN 0.0 ELSE {e} END)"
SQL["durand_tmo"] = f"""WITH {EMB}, {LOG}, {GRID}, {PASSES}, {READ},
r AS (SELECT log10(5.0::DOUBLE) / (max(yb) - min(yb)) AS cf, log10(5.0::DOUBLE) / (max(yb) - min(yb)) * (max(yb) - min(yb)) AS absolute FROM base),
k AS (SELECT *, 2.48::DOUBLE * pow(pow(10.0, cf), 0.82::DOUBLE) / (1 + 1.48::DOUBLE * pow(pow(10.0, cf), 0.82::DOUBLE)) AS e FROM r),
d AS (SELECT emb.image_id, x, y, emb.c1, emb.c2, emb.c3, {lum(('emb.c1', 'emb.c2', 'emb.c3'))} AS lum, yb, cf, absolute, e FROM emb JOIN base USING (x, y), k),
f AS (SELECT *, pow(10.0, yb * cf + log10({_fin('(lum / pow(10.0, yb))')}) - absolute) AS level FROM d)
SELECT image_id, x, y, {", ".join(f"{pixel(f'pow({_fin(f'(pow({c} / lum, e) * level)')}, 1 / 2.2::DOUBLE)')} AS {n}" for c, n in zip(C, "rgb", strict=True))}, {LDR} FROM f"""

def _maps(m, names, to: str) -> str:  # noqa: ANN001
    return ", ".join(f"{row(m, i, names)} AS {to}{i + 1}" for i in range(3))


def _three(p: str) -> tuple[str, ...]:
    return (f"{p}1", f"{p}2", f"{p}3")


def _each(f, to: str) -> str:  # noqa: ANN001
    return ", ".join(f"{f(i)} AS {to}{i}" for i in (1, 2, 3))


def _adapted(y: str) -> str:
    k4 = f"pow(1 / ({y} + 1), 4.0)"
    return f"(0.2::DOUBLE * {k4} * {y} + 0.1::DOUBLE * pow(1 - {k4}, 2.0) * pow({y}, 1 / 3.0::DOUBLE))"


def _squeezed(p: str) -> str:
    return f"(400 * {p} / (27.13::DOUBLE + {p}))"


# iCAM06. The image is 21 pixels wide and higher than that: the blur's deviation is 10, its boxes 19, 19 and 21 pixels.
_d65 = [sum(a * b for a, b in zip(m, D65, strict=True)) for m in XYZ_TO_CAT02]
_low, _high = "max(v) FILTER (i = floor(0.01::DOUBLE * n))", "max(v) FILTER (i = floor(0.99::DOUBLE * n))"
_unit = lambda c: f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, ({c} - low) / (high - low)))"
_curve = lambda e: f"(CASE WHEN {e} > 0.0031308 THEN 1.055::DOUBLE * pow({e}, 1 / 2.4::DOUBLE) - 0.055::DOUBLE ELSE 12.92::DOUBLE * {e} END)"
SQL["icam_tmo"] = f"""WITH {EMB}, xyz AS (SELECT image_id, x, y, {_maps(RGB_TO_XYZ, C, "v")} FROM emb),
a AS (SELECT image_id, x, y, {_each(lambda i: f"greatest(1e-8, 20000.0::DOUBLE * (v{i} / (SELECT max(v2) FROM xyz)))", "a")} FROM xyz),
src AS (SELECT image_id, x, y, {_each(lambda i: f"log10(greatest(a{i}, 1e-4))", "c")} FROM a),
{grid(C, "(least(max(x), max(y)) + 1) * 0.02::DOUBLE")}, {PASSES}, {READ},
w0 AS (SELECT x, y, {_each(lambda i: f"a{i}", "c")} FROM a), w1 AS ({box("w0", "x", 9)}), w2 AS ({box("w1", "x", 9)}), w3 AS ({box("w2", "x", 10)}),
w4 AS ({box("w3", "y", 9)}), w5 AS ({box("w4", "y", 9)}), w6 AS ({box("w5", "y", 10)}),
h0 AS (SELECT a.*, w6.c1 AS w1, w6.c2 AS w2, w6.c3 AS w3, max(w6.c2) OVER () AS sw, vx - (vy - yb) AS e1, yb AS e2, vz - (vy - yb) AS e3
  FROM a JOIN l USING (x, y) JOIN base USING (x, y) JOIN w6 USING (x, y)),
h1 AS (SELECT *, {_each(lambda i: f"pow(10.0::DOUBLE, CASE WHEN e{i} > 12 THEN 0.0 ELSE e{i} END)", "b")}, 0.3::DOUBLE * (1 - exp(-(0.2::DOUBLE * w2 / 20000 - 42) / 92) / 3.6::DOUBLE) AS d FROM h0),
h2 AS (SELECT *, {_maps(XYZ_TO_CAT02, _three("b"), "p")}, {_maps(XYZ_TO_CAT02, _three("w"), "u")} FROM h1),
h3 AS (SELECT *, {_each(lambda i: f"p{i} * ({_d65[i - 1]!r}::DOUBLE * d / u{i} + 1 - d)", "k")} FROM h2),
h4 AS (SELECT *, {_maps(CAT02_TO_XYZ, _three("k"), "t")}, {_adapted("w2")} AS fl, {_adapted("b2")} AS flb FROM h3),
h5 AS (SELECT *, {_maps(XYZ_TO_HPE, _three("t"), "n")}, abs(t2) / sw AS st, pow(1e-5 / (w2 + 1e-5), 2.0) AS j FROM h4),
h6 AS (SELECT *, {_each(lambda i: f"pow(fl * n{i} / w2, 0.7::DOUBLE)", "o")}, pow((3800 * j * w2 + 0.2::DOUBLE * pow(1 - j, 4.0) * pow(w2, 1 / 6.0::DOUBLE)) * st, 0.7::DOUBLE) AS rods,
  0.5::DOUBLE / (1 + 0.3::DOUBLE * pow(w2 * st, 0.3::DOUBLE)) + 0.5::DOUBLE / (1 + 5 * w2) AS bleach FROM h5),
h7 AS (SELECT *, {_each(lambda i: f"{_squeezed(f'o{i}')} + 0.1::DOUBLE + 3.05::DOUBLE * bleach * {_squeezed('rods')} + 0.3::DOUBLE", "r")} FROM h6),
h8 AS (SELECT *, {_maps(HPE_TO_XYZ, _three("r"), "s")} FROM h7),
h9 AS (SELECT image_id, x, y, flb, {_each(lambda i: f"s{i} * pow(a{i} / b{i}, pow(flb + 0.8::DOUBLE, 0.25::DOUBLE))", "c")} FROM h8),
i0 AS (SELECT *, {_maps(XYZ_TO_LMS, C, "k")} FROM h9), i1 AS (SELECT *, {_each(lambda i: f"pow(abs(k{i}), 0.43::DOUBLE)", "l")} FROM i0),
i2 AS (SELECT *, {_maps(LMS_TO_IPT, _three("l"), "i")} FROM i1), i3 AS (SELECT *, i2 * i2 + i3 * i3 AS cc, sqrt(i2 * i2 + i3 * i3) AS ch FROM i2),
i4 AS (SELECT *, pow(flb + 1, 0.15::DOUBLE) * (1.29::DOUBLE * cc - 0.27::DOUBLE * ch + 0.42::DOUBLE) / (cc - 0.31::DOUBLE * ch + 0.42::DOUBLE) AS sc FROM i3),
i5 AS (SELECT image_id, x, y, {_maps(IPT_TO_LMS, ("i1", "i2 * sc", "i3 * sc"), "m")} FROM i4), i6 AS (SELECT image_id, x, y, {_each(lambda i: f"pow(abs(m{i}), 1 / 0.43::DOUBLE)", "g")} FROM i5),
i7 AS (SELECT image_id, x, y, {_maps(LMS_TO_XYZ, _three("g"), "x")} FROM i6), i8 AS (SELECT image_id, x, y, {_maps(XYZ_TO_RGB, _three("x"), "c")} FROM i7),
o AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM (SELECT c1 AS v FROM i8 UNION ALL SELECT c2 FROM i8 UNION ALL SELECT c3 FROM i8)),
z AS (SELECT least({_low}, 0.0) AS low, {_high} AS high FROM o)
SELECT image_id, x, y, {", ".join(f"{whole(f'(65535 * {_curve(_unit(c))})')} AS {n}" for c, n in zip(C, "rgb", strict=True))}, {LDR} FROM i8, z"""

SQL["percentile_clip"] = f"""WITH {EV}, e AS (SELECT c1 AS v FROM ev UNION ALL SELECT c2 FROM ev UNION ALL SELECT c3 FROM ev),
o AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM e)
SELECT 'ev' AS image_id, {rnd("max(v) FILTER (i = floor(0.01::DOUBLE * n))")} AS lo, {rnd("max(v) FILTER (i = floor(0.99::DOUBLE * n))")} AS hi FROM o"""


def _map(src: str, *ms) -> str:  # noqa: ANN002
    at = f"SELECT x, y, c1, c2, c3 FROM {src}"
    for m in ms:
        at = f"SELECT x, y, {', '.join(f'{row(m, i)} AS {c}' for i, c in enumerate(C))} FROM ({at})"
    return f"SELECT x, y, {_near(str)} FROM ({at})"


SQL["rgb_to_xyz"] = f"WITH {EV} {_map('ev', RGB_TO_XYZ)}"
SQL["xyz_to_rgb"] = f"WITH {ORD} {_map('ord', XYZ_TO_RGB)}"
SQL["lms_roundtrip"] = f"WITH {ORD} {_map('ord', XYZ_TO_LMS, LMS_TO_XYZ, XYZ_TO_CAT02, CAT02_TO_XYZ, XYZ_TO_HPE, HPE_TO_XYZ)}"
SQL["ipt_roundtrip"] = f"WITH {ORD} {_map('ord', XYZ_TO_LMS, LMS_TO_IPT, IPT_TO_LMS, LMS_TO_XYZ)}"

_k = "(floor(log2(top))::INT + 1)"
_exp = f"(CASE WHEN top >= pow(2.0, {_k}) THEN {_k} + 1 WHEN top < pow(2.0, {_k} - 1) THEN {_k} - 1 ELSE {_k} END)"
_rgbe = f"e AS (SELECT *, {_exp} AS k FROM (SELECT *, greatest(c1, c2, c3) AS top FROM ev) WHERE top > 1e-32)"
SQL["rgbe_pack"] = f"WITH {EV}, {_rgbe} SELECT x, y, {', '.join(f'trunc({c} * (top * pow(2.0, -k) * 256 / top))::INT AS b{i}' for i, c in enumerate(C))}, k + 128 AS e FROM e"
SQL["rgbe_unpack"] = f"""WITH {EV}, {_rgbe}, b AS (SELECT x, y, {', '.join(f'trunc({c} * (top * pow(2.0, -k) * 256 / top))::INT AS b{i}' for i, c in enumerate(C))}, k + 128 AS e FROM e)
SELECT x, y, {', '.join(f'{rnd(f"b{i} * pow(2.0, e - 136)")} AS c{i + 1}' for i in range(3))} FROM b"""
_luv = """b AS (SELECT x, y, floor(256 * (log2(c2) + 64))::INT AS word, floor(410 * (4 * c1 / (c1 + 15 * c2 + 3 * c3)))::INT AS u, floor(410 * (9 * c2 / (c1 + 15 * c2 + 3 * c3)))::INT AS v FROM ord)"""
SQL["logluv_pack"] = f"WITH {ORD}, {_luv} SELECT x, y, word // 256 AS high, word % 256 AS low, u, v FROM b"
SQL["logluv_unpack"] = f"""WITH {ORD}, {_luv}, f AS (SELECT x, y, pow(2.0, (word + 0.5::DOUBLE) / 256 - 64) AS c2, (u + 0.5::DOUBLE) / 410 AS u, (v + 0.5::DOUBLE) / 410 AS v FROM b),
t AS (SELECT *, 9 * u / (6 * u - 16 * v + 12) AS lx, 4 * v / (6 * u - 16 * v + 12) AS ly FROM f)
SELECT x, y, {rnd('lx / ly * c2')} AS c1, {rnd('c2')} AS c2, {rnd('(1 - lx - ly) / ly * c2')} AS c3 FROM t"""
SQL["codec_hli_logluv"] = f"""WITH {ORD}, {_luv}, f AS (SELECT x, y, pow(2.0, (word + 0.5::DOUBLE) / 256 - 64) AS c2, (u + 0.5::DOUBLE) / 410 AS u, (v + 0.5::DOUBLE) / 410 AS v FROM b),
t AS (SELECT *, 9 * u / (6 * u - 16 * v + 12) AS lx, 4 * v / (6 * u - 16 * v + 12) AS ly FROM f)
SELECT x, y, {rnd('(lx / ly * c2)::FLOAT::DOUBLE', 5)} AS c1, {rnd('c2::FLOAT::DOUBLE', 5)} AS c2, {rnd('((1 - lx - ly) / ly * c2)::FLOAT::DOUBLE', 5)} AS c3 FROM t"""
SQL["pixel_mapping"] = f"WITH {EV} SELECT x, y, {', '.join(f'{pixel(f"({c} / 24 - 0.1::DOUBLE)")} AS {n}' for c, n in zip(C, 'rgb', strict=True))} FROM ev"

_single = ", ".join(f"{rnd(f'{c}::FLOAT::DOUBLE', 5)} AS {c}" for c in C)
SQL["codec_pfm"] = SQL["codec_hli"] = SQL["codec_hli_normal"] = SQL["float_bytes"] = f"WITH {EV} SELECT x, y, {_single} FROM ev"
SQL["codec_rgbe"] = SQL["codec_rgbe_flat"] = f"""WITH {EV}, {_rgbe}, b AS (SELECT x, y, {', '.join(f'trunc({c} * (top * pow(2.0, -k) * 256 / top))::INT AS b{i}' for i, c in enumerate(C))}, k + 128 AS e FROM e)
SELECT x, y, {', '.join(f'{rnd(f"b{i} * pow(2.0, e - 136)", 5)} AS c{i + 1}' for i in range(3))} FROM b"""
_view = lambda top: ", ".join(f"trunc(greatest(0.0, least({top}.0, round({c} / 24, 9) * {top})))::INT AS {n}" for c, n in zip(C, "rgb", strict=True))
SQL["view_8_bit"] = f"WITH {EV} SELECT x, y, {_view(255)}, 255 AS a FROM ev"
SQL["view_16_bit"] = f"WITH {EV} SELECT x, y, {_view(65535)}, 65535 AS a FROM ev"
SQL["cone_views"] = f"WITH {EMB} {_map('emb', RGB_TO_XYZ, XYZ_TO_CAT02)} UNION ALL {_map('emb', RGB_TO_XYZ, XYZ_TO_HPE)}"
SQL["image_metadata"] = f"WITH {BAT} SELECT image_id, max(x) + 1 AS width, max(y) + 1 AS height, 'RGB' AS color_model FROM bat GROUP BY image_id"
# An HLi file is LogLuv unless its header says otherwise, which holds XYZ.
SQL["file_headers"] = f"""WITH {BAT}, i AS (SELECT image_id, max(x) + 1 AS width, max(y) + 1 AS height FROM bat GROUP BY image_id)
SELECT image_id, f AS format, width, height, CASE WHEN f = 'hli' THEN 'XYZ' ELSE 'RGB' END AS color_model FROM i, (SELECT unnest(['hdr', 'hli', 'pfm']) AS f)"""

# A batch of an RGB and an XYZ image: both readouts of each, by its own model.
_both = lambda m, name: f"SELECT image_id, x, y, {', '.join(f'{row(m, i)} AS {name}{i}' for i in range(3))}"
_mixed_rgb = f"SELECT image_id, x, y, c1 AS v0, c2 AS v1, c3 AS v2 FROM ev UNION ALL {_both(XYZ_TO_RGB, 'v')} FROM ord"
_mixed_xyz = f"{_both(RGB_TO_XYZ, 'v')} FROM ev UNION ALL SELECT image_id, x, y, c1 AS v0, c2 AS v1, c3 AS v2 FROM ord"
SQL["mixed_linear_tmo"] = f"""WITH {EV}, {ORD}, mix AS ({_mixed_rgb}),
s AS (SELECT image_id, min(least(v0, v1, v2)) AS lo, max(greatest(v0, v1, v2)) AS hi FROM mix GROUP BY image_id)
SELECT image_id, x, y, {", ".join(f"{whole(f'(65535 * (v{i} - lo) / (hi - lo))')} AS {n}" for i, n in enumerate("rgb"))}, {LDR} FROM mix JOIN s USING (image_id)"""
_convert = lambda q, target: f"SELECT image_id, '{target}' AS target, x, y, {', '.join(f'{rnd(f'v{i}', 7)} AS {c}' for i, c in enumerate(C))} FROM ({q})"
SQL["mixed_convert"] = f"WITH {EV}, {ORD} {_convert(_mixed_rgb, 'RGB')} UNION ALL {_convert(_mixed_xyz, 'XYZ')}"
# The weight of each row of the sample, counted.
SQL["row_weights"] = f"""WITH {EV}, h AS (SELECT trunc((max(y) + 1)::FLOAT * 0.6::FLOAT)::INT AS rows FROM ev),
t AS (SELECT trunc(t::FLOAT * 0.6::FLOAT)::INT AS y, count(*) AS n FROM (SELECT unnest(range(0, rows)) AS t FROM h) GROUP BY 1)
SELECT DISTINCT ev.y, coalesce(n, 0)::INT AS weight FROM ev LEFT JOIN t USING (y)"""
SQL["tiles_f32"] = SQL["codec_pfm"]
SQL["tiles_f64"] = f"WITH {EV} SELECT x, y, {', '.join(f'{rnd(c, 5)} AS {c}' for c in C)} FROM ev"
SQL["sql_decode"] = f"""WITH {BAT} SELECT image_id, max(x) + 1 AS width, max(y) + 1 AS height, 'RGB' AS color_model, count(*) AS n, {rnd("max(c2)::FLOAT::DOUBLE", 5)} AS high FROM bat GROUP BY image_id"""
SQL["codec_xyze"] = SQL["codec_rgbe"].replace(EV, ORD).replace("FROM ev", "FROM ord")
# A sketch keeps its promise: the place of each percentile is within the error.
SQL["percentile_sketch"] = f"WITH {EV} SELECT image_id, name, count(*) AS n, true AS within FROM ev, (SELECT unnest(['p01', 'p50', 'p99']) AS name) GROUP BY image_id, name"
SQL["codec_hli_rgbe"], SQL["codec_hli_xyze"] = SQL["codec_rgbe"], SQL["codec_xyze"]
SQL["codec_hli_xyz"] = f"WITH {ORD} SELECT x, y, {_single} FROM ord"
SQL["codec_hli_logluv_gzip"] = SQL["codec_hli_logluv"]
SQL["clip_bounds"] = f"WITH {EV} SELECT x, y, {', '.join(f'{rnd(c)} AS {c}' for c in C)}, (y * 20 + x)::INT AS place FROM ev WHERE x < 20 AND y < 30"
SQL["blank_images"] = f"""WITH {BAT}, i AS (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h FROM bat GROUP BY image_id),
r AS (SELECT image_id, w, unnest(range(0, h))::INT AS y FROM i)
SELECT image_id, unnest(range(0, w))::INT AS x, y, 0.0::DOUBLE AS c1, 0.0::DOUBLE AS c2, 0.0::DOUBLE AS c3 FROM r"""
