"""DuckDB SQL of the catalogue's queries, built from one set of common table expressions."""

from __future__ import annotations

from pulsefield.config import EvalConfig, Frame, RBFScheme, Scaling
from pulsefield.sources.tables import GRID, WIDTH2

N = GRID


def scatter(key: str, prime: int) -> str:
    return f"((({key}) + 1) * {prime} % 10007) / 10007.0::DOUBLE"


def points(table: str, key: str, primes: tuple[int, int]) -> str:
    return f"SELECT {key} AS id, {scatter(key, primes[0])} AS x0, {scatter(key, primes[1])} AS x1 FROM {table}"


SUPPLIERS, CUSTOMERS = points("supplier", "s_suppkey", (4799, 8641)), points("customer", "c_custkey", (3571, 9227))
ORDERED = "SELECT DISTINCT o_custkey AS target_id, l_suppkey AS source_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey"
ALL_PAIRS = "SELECT t.id AS target_id, s.id AS source_id FROM tgt t, src s"

FIELD = f"""
nat AS (SELECT n_nationkey AS k, n_regionkey AS batch_id, 0.1::DOUBLE + 0.8::DOUBLE * {scatter("n_nationkey", 7919)} AS x0, 0.1::DOUBLE + 0.8::DOUBLE * {scatter("n_nationkey * (n_nationkey + 2)", 6271)} AS x1 FROM nation),
smp0 AS (SELECT k AS sample_id, batch_id, x0, x1, x0 + 0.02::DOUBLE AS m0, x1 - 0.01::DOUBLE AS m1, 1 + (k % 5) / 4.0::DOUBLE AS v, 0.02::DOUBLE + 0.001::DOUBLE * (k % 7) AS s00, 0.004::DOUBLE AS s01, 0.03::DOUBLE + 0.001::DOUBLE * (k % 5) AS s11 FROM nat),
smp1 AS (SELECT *, s00 * s11 - s01 * s01 AS sdet FROM smp0),
smp2 AS (SELECT *, sqrt(sdet) AS root, sqrt(s00 + s11 + 2 * sqrt(sdet)) AS tr FROM smp1),
smp AS (SELECT *, s11 / sdet AS i00, -s01 / sdet AS i01, s00 / sdet AS i11, (s00 + root) / tr AS r00, s01 / tr AS r01, (s11 + root) / tr AS r11 FROM smp2),
vrt0 AS (SELECT CAST(range AS INTEGER) AS vertex_id, (range % {N + 1}) / {N}.0::DOUBLE AS p0, (range // {N + 1}) / {N}.0::DOUBLE AS p1 FROM range({(N + 1) ** 2})),
vrt1 AS (SELECT *, 1 + 0.5::DOUBLE * p0 AS v, p0 + 0.02::DOUBLE AS m0, p1 - 0.01::DOUBLE AS m1, 0.02::DOUBLE + 0.01::DOUBLE * p0 AS a, 0.004::DOUBLE AS b, 0.03::DOUBLE + 0.01::DOUBLE * p1 AS c FROM vrt0),
vrt2 AS (SELECT *, sqrt(a * c - b * b) AS root, sqrt(a + c + 2 * sqrt(a * c - b * b)) AS tr FROM vrt1),
vrt AS (SELECT *, (c + root) / (tr * root) AS w00, -b / (tr * root) AS w01, (a + root) / (tr * root) AS w11 FROM vrt2),
psi AS (SELECT batch_id, vertex_id, sum(1 / (1 + ((p0 - smp.m0) * (p0 - smp.m0) + (p1 - smp.m1) * (p1 - smp.m1)) / {WIDTH2}::DOUBLE)) AS psi FROM smp, vrt GROUP BY batch_id, vertex_id)"""


def located(source: str, x: str, y: str) -> str:
    """Rows of source with inside, vertices a, b, c and coordinates l0, l1, l2 of the point (x, y) on the mesh."""
    return f"""(SELECT *, gj * {N + 1} + gi AS va, CASE WHEN gw <= gu THEN gj * {N + 1} + gi + 1 ELSE gj * {N + 1} + gi + {N + 2} END AS vb,
  CASE WHEN gw <= gu THEN gj * {N + 1} + gi + {N + 2} ELSE gj * {N + 1} + gi + {N + 1} END AS vc, 2 * (gj * {N} + gi) + CASE WHEN gw <= gu THEN 0 ELSE 1 END AS cell,
  CASE WHEN gw <= gu THEN 1 - gu ELSE 1 - gw END AS l0, CASE WHEN gw <= gu THEN gu - gw ELSE gu END AS l1, CASE WHEN gw <= gu THEN gw ELSE gw - gu END AS l2
  FROM (SELECT *, {x} * {N} - gi AS gu, {y} * {N} - gj AS gw FROM (SELECT *, {x} >= -1e-12 AND {x} <= 1 + 1e-12 AND {y} >= -1e-12 AND {y} <= 1 + 1e-12 AS on_mesh,
    CAST(least(greatest(floor({x} * {N}), 0), {N - 1}) AS INTEGER) AS gi, CAST(least(greatest(floor({y} * {N}), 0), {N - 1}) AS INTEGER) AS gj FROM {source})))"""


def mixed(names: tuple[str, ...]) -> str:
    return ", ".join(f"l0 * a.{n} + l1 * b.{n} + l2 * c.{n} AS {n}_x" for n in names)


def predictions(c: EvalConfig, src: str = SUPPLIERS, tgt: str = CUSTOMERS, pairs: str = ORDERED) -> str:
    """Common table expressions that end in pred: target_id, source_id, rnk, sample_id, x0, x1 (sample), sx0, sx1 (source), value, excluded."""
    z = {
        Frame.IDENTITY: ("t.x0", "t.x1"),
        Frame.TRANSLATION: ("t.x0 - n.sx0 + n.x0", "t.x1 - n.sx1 + n.x1"),
        Frame.MEAN_TRANSLATION: ("t.x0 - n.m0_x + n.m0", "t.x1 - n.m1_x + n.m1"),
        Frame.WHITENED_AFFINE: ("n.m0 + n.r00 * (n.w00_x * (t.x0 - n.m0_x) + n.w01_x * (t.x1 - n.m1_x)) + n.r01 * (n.w01_x * (t.x0 - n.m0_x) + n.w11_x * (t.x1 - n.m1_x))", "n.m1 + n.r01 * (n.w00_x * (t.x0 - n.m0_x) + n.w01_x * (t.x1 - n.m1_x)) + n.r11 * (n.w01_x * (t.x0 - n.m0_x) + n.w11_x * (t.x1 - n.m1_x))"),
    }[c.frame]
    if not c.gated:
        inside = "TRUE"
    elif c.frame is Frame.WHITENED_AFFINE:
        inside = f"(w00_x * (y0 - m0_x) + w01_x * (y1 - m1_x)) ** 2 + (w01_x * (y0 - m0_x) + w11_x * (y1 - m1_x)) ** 2 <= {c.tau**2}"
    else:
        inside = f"i00 * (z0 - m0) * (z0 - m0) + 2 * i01 * (z0 - m0) * (z1 - m1) + i11 * (z1 - m1) * (z1 - m1) <= {c.tau**2}"
    scale = {Scaling.NONE: "v", Scaling.VOLUME: "v_x", Scaling.VOLUME_DET: "v_x * sqrt(sdet) * (w00_x * w11_x - w01_x * w01_x)"}[c.scaling]
    return f"""{FIELD},
src AS ({src}), tgt AS ({tgt}), prs AS ({pairs}),
spot AS (SELECT s.id AS source_id, s.x0 AS sx0, s.x1 AS sx1, {mixed(("v", "m0", "m1", "w00", "w01", "w11"))} FROM {located("src", "x0", "x1")} s JOIN vrt a ON va = a.vertex_id JOIN vrt b ON vb = b.vertex_id JOIN vrt c ON vc = c.vertex_id WHERE on_mesh),
near AS (SELECT spot.*, smp.*, (sx0 - x0) * (sx0 - x0) + (sx1 - x1) * (sx1 - x1) AS d2 FROM spot, smp QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY (sx0 - x0) * (sx0 - x0) + (sx1 - x1) * (sx1 - x1), sample_id) <= {c.num_neighbors}),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY source_id ORDER BY d2, sample_id) AS INTEGER) AS rnk FROM near),
met AS (SELECT p.target_id, n.*, t.x0 AS y0, t.x1 AS y1, {z[0]} AS z0, {z[1]} AS z1 FROM prs p JOIN ranked n ON p.source_id = n.source_id JOIN tgt t ON p.target_id = t.id),
gate AS (SELECT *, {inside} AS inside FROM met),
pred AS (SELECT target_id, source_id, rnk, sample_id, x0, x1, sx0, sx1, CASE WHEN inside AND on_mesh THEN ({scale}) * (l0 * a.psi + l1 * b.psi + l2 * c.psi) ELSE 0.0 END AS value, inside AND NOT on_mesh AS excluded
  FROM {located("gate", "z0", "z1")} g JOIN psi a ON va = a.vertex_id AND g.batch_id = a.batch_id JOIN psi b ON vb = b.vertex_id AND g.batch_id = b.batch_id JOIN psi c ON vc = c.vertex_id AND g.batch_id = c.batch_id)"""


def phi(kernel: str, u: str) -> str:
    return {"gaussian": f"exp(-0.5 * ({u}) * ({u}))", "multiquadric": f"-sqrt(1 + ({u}) * ({u}))", "inverse_multiquadric": f"1 / sqrt(1 + ({u}) * ({u}))", "linear": f"-({u})", "cubic": f"({u}) * ({u}) * ({u})", "thin_plate_spline": f"CASE WHEN ({u}) = 0 THEN 0 ELSE ({u}) * ({u}) * ln({u}) END"}[kernel]


def fitted(rbf: RBFScheme) -> str:
    """Common table expressions from kept (target_id, source_id, ord, d0, d1: centre, value) to ker: target_id, source_id,
    value, by the closed forms for up to three centres in the plane."""
    k, far = rbf.kernel.value, "sqrt((a0 - b0) ** 2 + (a1 - b1) ** 2)"
    g = [phi(k, f"{rbf.shape} * sqrt({n}0 * {n}0 + {n}1 * {n}1) / {far}") for n in "ab"]
    two = f"0.5 + (({g[0]}) - ({g[1]})) / (2 * (({phi(k, '0.0')}) + {rbf.smoothing} - ({phi(k, str(rbf.shape))})))"
    cols = ", ".join(f"max(CASE WHEN nth = {i} THEN d0 END) AS {n}0, max(CASE WHEN nth = {i} THEN d1 END) AS {n}1, max(CASE WHEN nth = {i} THEN value END) AS f{n}" for i, n in enumerate("abc", 1))
    area = "((b0 - a0) * (c1 - a1) - (c0 - a0) * (b1 - a1))"
    three = f"(fa * (b0 * c1 - c0 * b1) + fb * (c0 * a1 - a0 * c1) + fc * (a0 * b1 - b0 * a1)) / {area}"
    return f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY target_id, source_id ORDER BY ord) AS nth FROM kept),
wide AS (SELECT target_id, source_id, count(*) AS n, bool_or(value <> 0) AS live, {cols} FROM numbered GROUP BY target_id, source_id),
ker AS (SELECT target_id, source_id, CASE n WHEN 1 THEN fa WHEN 2 THEN ({two}) * fa + (1 - ({two})) * fb ELSE {three} END AS value FROM wide WHERE live)"""


def kernel(c: EvalConfig, rbf: RBFScheme, src: str = SUPPLIERS, tgt: str = CUSTOMERS, pairs: str = ALL_PAIRS) -> str:
    """Common table expressions that end in ker: target_id, source_id, value."""
    return f"""{predictions(c, src, tgt, pairs)},
kept AS (SELECT target_id, source_id, rnk AS ord, x0 - sx0 AS d0, x1 - sx1 AS d1, value FROM pred WHERE NOT excluded),
{fitted(rbf)}"""
