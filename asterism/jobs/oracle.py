"""DuckDB SQL for the rows of the reference-style queries."""

from __future__ import annotations

import math

from .queries import CELL, DISCARD, DR, ERROR_CUT, FIXED, FOV_RATIO, GRID, HIGH, LINKS, LOW, MEMBER, MIN_STARS, NEIGHBOURS, OFTEN, PAD, RADII, RIDGE, SCATTER, STEP, THETAS, THIN

COS, SIN, SPAN = repr(math.cos(DR.theta)), repr(math.sin(DR.theta)), repr(DR.a1 - DR.a2)
_E = [f"embedding[{i}]::DOUBLE" for i in range(1, 9)]

STARS = f"""stars AS (SELECT vec_id AS star_id, 290 + {_E[0]} * 0.08::DOUBLE AS ra, 2 + {_E[1]} * 0.08::DOUBLE AS "dec", {_E[0]} * 1000 AS x, {_E[1]} * 1000 AS y,
  22 + 6 * {_E[2]} AS band1, 22 + 6 * {_E[2]} - (1.75::DOUBLE + 1.5::DOUBLE * {_E[3]}) AS band2, 1 - label / 20.0::DOUBLE AS membership,
  CASE WHEN label = 9 THEN 0 ELSE 1 END AS oktot, label < 6 AS is_cluster, label >= 4 AS is_field,
  -3 + 2 * {_E[4]} AS pm_ra, -6 + 2 * {_E[5]} AS pm_dec, 0.1::DOUBLE + abs({_E[6]}) AS epm_ra, 0.1::DOUBLE + abs({_E[7]}) AS epm_dec FROM embeddings)"""
PHOT = """phot AS (SELECT o_orderkey AS star_id, (o_orderkey * 7919 % 10007)::DOUBLE AS x, (o_orderkey * 104729 % 10009)::DOUBLE AS y, 14 + o_totalprice / 40000 AS band1,
  14 + o_totalprice / 40000 - (0.5::DOUBLE + (o_custkey % 300) / 100.0::DOUBLE) AS band2, (o_orderkey % 101) / 100.0::DOUBLE AS membership FROM orders)"""
CHAIN = """chain AS (SELECT user_id AS walker, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step, value::DOUBLE AS theta0, -value::DOUBLE AS log_prob FROM events)"""
SLICED = f"{CHAIN}, sliced AS (SELECT * FROM chain WHERE step >= {DISCARD} AND (step - {DISCARD + THIN - 1}) % {THIN} = 0)"


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0::DOUBLE"


def _rotated(table: str) -> str:
    b, c = f"(band1 - {DR.to_mag}::DOUBLE)", f"(band1 - band2 - {DR.to_color}::DOUBLE)"
    return f"rotated AS (SELECT *, {c} * {COS}::DOUBLE + {b} * {SIN}::DOUBLE AS rx, {b} * {COS}::DOUBLE - {c} * {SIN}::DOUBLE AS ry FROM {table})"


_RIDGE = "(" + " + ".join(f"{c}::DOUBLE * pow(ry, {i})" for i, c in enumerate(RIDGE)) + ")"
ROI = f"{PHOT}, {_rotated('phot')}, roi AS (SELECT * FROM rotated WHERE membership > {MEMBER} AND rx > -6 AND rx < 3 AND ry > -1.5 AND ry < 0.9::DOUBLE)"
CENTER = f"""{STARS}, center AS (SELECT min(ra) + (max(ra) - min(ra)) / 2 AS ra_mid, min("dec") + (max("dec") - min("dec")) / 2 AS dec_mid FROM stars)"""
SEPARATION = f"""{CENTER}, sep AS (SELECT star_id, degrees(atan2(sqrt(pow(cos(radians("dec")) * sin(radians(ra) - radians(ra_mid)), 2) + pow(cos(radians(dec_mid)) * sin(radians("dec")) - sin(radians(dec_mid)) * cos(radians("dec")) * cos(radians(ra) - radians(ra_mid)), 2)),
  sin(radians(dec_mid)) * sin(radians("dec")) + cos(radians(dec_mid)) * cos(radians("dec")) * cos(radians(ra) - radians(ra_mid)))) * 3600 AS sep FROM stars, center)"""
KNN = f"""{STARS}, {_rotated('stars')}, refs AS (SELECT star_id AS ref, x AS rfx, y AS rfy, rx AS value, rx - {_RIDGE} AS residual FROM rotated WHERE membership > {MEMBER}),
near AS (SELECT star_id, ref, value, residual, pow(x - rfx, 2) + pow(y - rfy, 2) AS d2, row_number() OVER (PARTITION BY star_id ORDER BY pow(x - rfx, 2) + pow(y - rfy, 2), ref) AS rank FROM rotated, refs QUALIFY rank BETWEEN 2 AND {NEIGHBOURS + 1})"""


def _clipped(value: str) -> str:
    return f"""mid AS (SELECT star_id, quantile_cont({value}, 0.5) AS m, stddev_pop({value}) AS s FROM near GROUP BY 1),
clip AS (SELECT mid.star_id, count(*) FILTER (abs({value} - m) < 2 * s) AS n_kept, coalesce(quantile_cont({value}, 0.5) FILTER (abs({value} - m) < 2 * s), any_value(m)) AS median FROM near JOIN mid USING (star_id) GROUP BY 1)"""


CORRECTED = f"""{KNN}, {_clipped('residual')},
fixed AS (SELECT star_id, band1, band2, band1 - median * {SIN}::DOUBLE AS new1, band2 - median * {SIN}::DOUBLE + median * {COS}::DOUBLE AS new2, median * {COS}::DOUBLE / {SPAN}::DOUBLE AS delta_e FROM stars JOIN clip USING (star_id))"""
REGIONS = f"""{STARS}, cmd AS (SELECT star_id, is_cluster, is_field, membership, band1 - band2 AS cx, band1 AS cy FROM stars),
gens AS (SELECT star_id AS region, cx AS gx, cy AS gy FROM cmd WHERE is_cluster AND membership = 1), box AS (SELECT min(gx) - {PAD}::DOUBLE AS a, max(gx) + {PAD}::DOUBLE AS b, min(gy) - {PAD}::DOUBLE AS c, max(gy) + {PAD}::DOUBLE AS d FROM gens),
placed AS (SELECT star_id, region, is_cluster, is_field, rank() OVER (PARTITION BY star_id ORDER BY pow(cx - gx, 2) + pow(cy - gy, 2)) AS r FROM cmd, gens, box WHERE (is_cluster OR is_field) AND cx BETWEEN a AND b AND cy BETWEEN c AND d QUALIFY r = 1),
field AS (SELECT region, star_id FROM placed WHERE is_field), cluster AS (SELECT region, star_id FROM placed WHERE is_cluster),
counts AS (SELECT region, count(*) AS n FROM field GROUP BY 1), rates AS (SELECT region, n * {FOV_RATIO}::DOUBLE AS rate FROM counts),
sizes AS (SELECT region, count(*) AS c FROM cluster GROUP BY 1),
losses AS (SELECT region, ((1 - (rate - floor(rate))) * least(floor(rate), c) + (rate - floor(rate)) * least(floor(rate) + 1, c)) / c AS loss FROM rates JOIN sizes USING (region)),
expected AS (SELECT star_id, 1 - sum(loss) AS membership FROM cluster JOIN losses USING (region) GROUP BY 1)"""


def _normal(x1: str, x2: str, mu1, mu2, s1: str, s2: str, rho: str) -> str:
    u, v = f"(({x1} - ({mu1}::DOUBLE)) / {s1})", f"(({x2} - ({mu2}::DOUBLE)) / {s2})"
    return f"(exp(-({u} * {u} - 2 * {rho} * {u} * {v} + {v} * {v}) / (2 * (1 - {rho} * {rho}))) / (2 * pi() * {s1} * {s2} * sqrt(1 - {rho} * {rho})))"


def _component(mu1, mu2, s1, s2, rho) -> str:
    o1, o2 = f"sqrt(pow({s1}::DOUBLE, 2) + epm_ra * epm_ra)", f"sqrt(pow({s2}::DOUBLE, 2) + epm_dec * epm_dec)"
    return _normal("pm_ra", "pm_dec", mu1, mu2, o1, o2, f"({rho * s1 * s2}::DOUBLE / ({o1} * {o2}))")


def _parts(t: list[float]) -> list[str]:
    return [f"({t[10]}::DOUBLE * {_component(*t[:5])})", f"((1 - {t[10]}::DOUBLE) * {_component(*t[5:10])})"]


def _loglik(t: list[float]) -> str:
    p = " + ".join(_parts(t))
    return f"sum(CASE WHEN {p} = 0 THEN '-inf'::DOUBLE ELSE ln({p}) END)"


def _effective(t: list[float]) -> list[float]:
    out = [v if f is None else f for v, f in zip(t, FIXED, strict=True)]
    for a, b in LINKS:
        out[b] = out[a]
    return out


def _allowed(t: list[float]) -> bool:
    return all(a <= v <= b for v, a, b in zip(t, LOW, HIGH, strict=True)) and t[10] <= 1


def _hist2d(source: str, x: str, y: str, bins: int) -> str:
    return f"""ends AS (SELECT min({x}) AS x0, (max({x}) - min({x})) / {bins} AS wx, min({y}) AS y0, (max({y}) - min({y})) / {bins} AS wy, count(*) AS total FROM {source}),
cells AS (SELECT least(floor(({x} - x0) / wx), {bins - 1})::BIGINT AS ix, least(floor(({y} - y0) / wy), {bins - 1})::BIGINT AS iy, count(*) AS n, count(*) / any_value(total * wx * wy) AS density FROM {source}, ends GROUP BY 1, 2)"""


_COLOR = f"{PHOT}, cm AS (SELECT star_id, x, y, band1 - band2 AS color, band1 AS mag FROM phot)"
_IX = "(x - x0) / wx"
_IY = "(y - y0) / wy"


def _percentiles(source: str, col: str) -> str:
    return " UNION ALL ".join(f"SELECT {q}::DOUBLE AS q, {r6(f'quantile_cont({col}, {q})')} AS value FROM {source}" for q in (0.16, 0.5, 0.84))


_THETA = ", ".join(f"{t}::DOUBLE + {SCATTER}::DOUBLE * (abs(theta0) * {i + 1} % 1)" for i, t in enumerate(THETAS[0]))
DRAWS = f"{SLICED}, draws AS (SELECT walker || '-' || step AS draw, [{_THETA}] AS t FROM sliced)"


def _draw_parts() -> str:
    out = []
    for c, w in ((0, "t[11]"), (1, "(1 - t[11])")):
        mu1, mu2, s1, s2, rho = (f"t[{5 * c + i}]" for i in range(1, 6))
        o1, o2 = f"sqrt(pow({s1}, 2) + epm_ra * epm_ra)", f"sqrt(pow({s2}, 2) + epm_dec * epm_dec)"
        out.append(f"{w} * {_normal('pm_ra', 'pm_dec', mu1, mu2, o1, o2, f'({rho} * {s1} * {s2} / ({o1} * {o2}))')} AS p{c}")
    return ", ".join(out)


def _corner() -> list[str]:
    names, out = ("theta0", "log_prob", "step"), []
    at = lambda p: f"least(floor(({p} - (SELECT min({p}) FROM params)) / {width(p)}), 19)::BIGINT"
    width = lambda p: f"(SELECT (max({p}) - min({p})) / 20 FROM params)"
    total = "(SELECT count(*) FROM params)"
    for k, p in enumerate(names):
        out.append(f"SELECT 'one' AS kind, '{p}' AS a, NULL::VARCHAR AS b, {at(p)} AS ia, NULL::BIGINT AS ib, count(*) AS n, {r6(f'count(*) / ({total} * {width(p)})')} AS value FROM params GROUP BY ALL")
        out += [f"SELECT 'two', '{p}', '{q}', {at(p)}, {at(q)}, count(*), {r6(f'count(*) / ({total} * ({width(p)} * {width(q)}))')} FROM params GROUP BY ALL" for q in names[k + 1 :]]
        out += [f"SELECT 'quantile', '{p}', NULL, NULL, {i}, NULL, {r6(f'quantile_cont({p}, {v})')} FROM params" for i, v in enumerate((0.16, 0.5, 0.84))]
    return out


_FIX_T = {0: "pm_ra", 1: "pm_dec", 2: "epm_ra", 3: "epm_ra", 4: "0.0::DOUBLE"}
_HEX_FIRST = "pow(u - round_even(u, 0), 2) + 3 * pow(v - round_even(v, 0), 2) < pow(u - floor(u) - 0.5, 2) + 3 * pow(v - floor(v) - 0.5, 2)"
#: Arrows around stars, with their boxes and areas.
ARROWS = f"""{STARS}, s AS (SELECT *, band1 - band2 AS x0, band1 AS y0, epm_ra / 4 AS w, epm_dec / 4 AS h FROM stars),
rings AS (SELECT star_id, is_cluster AS c, is_field AND NOT is_cluster AS f, x0 - w AS lx, x0 + w AS hx, y0 - h AS ly, y0 + h AS hy, [x0 - w, x0 + w, x0, x0 + w, x0 - w] AS xs, [y0 - h, y0 - h, y0, y0 + h, y0 + h] AS ys FROM s),
size AS (SELECT star_id, abs(sum(ax * "by" - bx * ay)) / 2 AS area FROM (SELECT star_id, unnest(xs) - lx AS ax, unnest(ys) - ly AS ay, unnest(list_concat(xs[2:], xs[1:1])) - lx AS bx, unnest(list_concat(ys[2:], ys[1:1])) - ly AS "by" FROM rings) GROUP BY 1)"""
#: What both outlines of each of ``pairs`` hold, by the even-odd rule in the middle of the strips between all corners and crossings.
SWEEP = """edges AS (SELECT a, b, 0 AS side, unnest(axs) AS px, unnest(ays) AS py, unnest(list_concat(axs[2:], axs[1:1])) AS qx, unnest(list_concat(ays[2:], ays[1:1])) AS qy FROM pairs
  UNION ALL SELECT a, b, 1, unnest(bxs), unnest(bys), unnest(list_concat(bxs[2:], bxs[1:1])), unnest(list_concat(bys[2:], bys[1:1])) FROM pairs),
crossings AS (SELECT a, b, e.px + (e.qx - e.px) * ((g.px - e.px) * (g.qy - g.py) - (g.py - e.py) * (g.qx - g.px)) / nullif((e.qx - e.px) * (g.qy - g.py) - (e.qy - e.py) * (g.qx - g.px), 0) AS x FROM edges e JOIN edges g USING (a, b) WHERE e.side = 0 AND g.side = 1),
strips AS (SELECT a, b, x AS lo, lead(x) OVER (PARTITION BY a, b ORDER BY x) AS hi FROM (SELECT a, b, px AS x FROM edges UNION SELECT a, b, x FROM crossings WHERE x IS NOT NULL)),
heights AS (SELECT a, b, lo, hi, side, py + ((lo + hi) / 2 - px) * (qy - py) / (qx - px) AS y FROM strips JOIN edges USING (a, b) WHERE hi IS NOT NULL AND (lo + hi) / 2 > least(px, qx) AND (lo + hi) / 2 < greatest(px, qx)),
between_them AS (SELECT a, b, hi - lo AS dx, lead(y) OVER o - y AS dy, sum(1 - side) OVER o % 2 = 1 AND sum(side) OVER o % 2 = 1 AS inside FROM heights WINDOW o AS (PARTITION BY a, b, lo ORDER BY y, side ROWS UNBOUNDED PRECEDING)),
shared AS (SELECT a, b, sum(dx * dy) AS shared_area FROM between_them WHERE inside GROUP BY 1, 2)"""


ORACLE_SQL = {
    "cmd_project": f"WITH {PHOT} SELECT star_id, round(band1 - band2, 9) AS color, round(band1, 9) AS mag FROM phot",
    "filter_members": f"WITH {PHOT} SELECT star_id, {r6('membership')} AS membership FROM phot WHERE membership > {MEMBER}",
    "split_members": f"WITH {PHOT} SELECT star_id, CASE WHEN membership > {MEMBER} THEN 'member' WHEN membership < {MEMBER} THEN 'rejected' END AS side FROM phot",
    "filter_error_cut": f"WITH {STARS} SELECT star_id FROM stars WHERE epm_ra < {ERROR_CUT} AND epm_dec < {ERROR_CUT} AND oktot = 1",
    "filter_quality": f"WITH {STARS} SELECT star_id FROM stars WHERE oktot = 1",
    "split_catalogs": f"WITH {STARS} SELECT star_id, 'cluster' AS catalog FROM stars WHERE is_cluster UNION ALL SELECT star_id, 'field' FROM stars WHERE is_field",
    "rotate_cmd": f"WITH {PHOT}, {_rotated('phot')} SELECT star_id, {r6('rx')} AS rx, {r6('ry')} AS ry FROM rotated",
    "roi_filter": f"WITH {ROI} SELECT star_id FROM roi",
    "fiducial_bins": f"""WITH {ROI}, ends AS (SELECT min(ry) AS lo, round_even((max(ry) - min(ry)) / {STEP}::DOUBLE, 0) AS bins FROM roi), k AS (SELECT floor((ry - lo) / {STEP}::DOUBLE)::BIGINT AS bin, rx, ry, lo, bins FROM roi, ends)
SELECT bin, count(*) AS n, {r6('quantile_cont(ry, 0.5)')} AS ordinate, {r6('quantile_cont(rx, 0.5)')} AS abscissa FROM k WHERE ry > lo + bin * {STEP}::DOUBLE AND ry < lo + (bin + 1) * {STEP}::DOUBLE AND bin < bins GROUP BY bin""",
    "hist_density": f"""WITH {PHOT}, ends AS (SELECT min(membership) AS lo, (max(membership) - min(membership)) / 30 AS w, count(*) AS total FROM phot)
SELECT least(floor((membership - lo) / w), 29)::BIGINT AS bin, count(*) AS n, {r6('count(*) / any_value(total * w)')} AS density FROM phot, ends GROUP BY 1""",
    "hist2d_density": f"WITH {_COLOR}, {_hist2d('cm', 'color', 'mag', 200)} SELECT ix, iy, n, {r6('density')} AS density FROM cells",
    "density_weights": f"""WITH {_COLOR}, {_hist2d('cm', 'color', 'mag', 200)}, uv AS (SELECT star_id, (color - x0) / wx - 0.5::DOUBLE AS u, (mag - y0) / wy - 0.5::DOUBLE AS v FROM cm, ends),
corner AS (SELECT star_id, u, v, floor(u)::BIGINT + i AS ix, floor(v)::BIGINT + j AS iy, CASE WHEN i = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END * CASE WHEN j = 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END AS w FROM uv, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j))
SELECT star_id, {r6('sum(CASE WHEN u < 0 OR u > 199 OR v < 0 OR v > 199 THEN 0 ELSE w * coalesce(density, 0) END)')} AS weight FROM corner LEFT JOIN cells USING (ix, iy) GROUP BY star_id""",
    "membership_percentiles": f"WITH {PHOT} {_percentiles('phot', 'membership')}",
    "hexbin_median": f"""WITH {_COLOR}, ends AS (SELECT min(x) AS x0, (max(x) - min(x)) / 100 AS wx, min(y) AS y0, (max(y) - min(y)) / {int(100 / math.sqrt(3))} AS wy FROM cm), uv AS (SELECT {_IX} AS u, {_IY} AS v, color FROM cm, ends),
hex AS (SELECT CASE WHEN {_HEX_FIRST} THEN 1 ELSE 2 END::BIGINT AS lattice, CASE WHEN {_HEX_FIRST} THEN round_even(u, 0) ELSE floor(u) END::BIGINT AS hx, CASE WHEN {_HEX_FIRST} THEN round_even(v, 0) ELSE floor(v) END::BIGINT AS hy, color FROM uv)
SELECT lattice, hx, hy, count(*) AS n, {r6('quantile_cont(color, 0.5)')} AS median FROM hex GROUP BY ALL""",
    "describe_column": f"WITH {PHOT} SELECT count(band1) AS n, {r6('avg(band1)')} AS mean, {r6('stddev_samp(band1)')} AS std, {r6('min(band1)')} AS min, {r6('quantile_cont(band1, 0.25)')} AS p25, {r6('quantile_cont(band1, 0.5)')} AS p50, {r6('quantile_cont(band1, 0.75)')} AS p75, {r6('max(band1)')} AS max FROM phot",
    "bbox_center": f"WITH {CENTER} SELECT {r6('ra_mid')} AS ra_mid, {r6('dec_mid')} AS dec_mid FROM center",
    "sky_separation": f"WITH {SEPARATION} SELECT star_id, {r6('sep')} AS sep FROM sep",
    "field_density": f"WITH {SEPARATION} SELECT count(*) AS n, {r6('max(sep)')} AS max_sep, {r6('count(*) / (pi() * max(sep) * max(sep))')} AS density, {r6(f'{MIN_STARS} / (count(*) / (pi() * max(sep) * max(sep)))')} AS min_area FROM sep",
    "annulus_assign": f"""WITH {CENTER}, far AS (SELECT star_id, sqrt(pow(ra - ra_mid, 2) + pow("dec" - dec_mid, 2)) AS d FROM stars, center), rings AS (SELECT * FROM (VALUES {', '.join(f'({i}::BIGINT, {a}::DOUBLE, {b}::DOUBLE)' for i, (a, b) in enumerate(zip((0.0, *RADII[:-1]), RADII, strict=True)))}) v(group_id, lo, hi))
SELECT star_id, group_id FROM far JOIN rings ON d > lo AND d < hi""",
    "knn_join": f"WITH {KNN} SELECT star_id, ref AS ref_id, rank - 1 AS rank, {r6('sqrt(d2)')} AS dist FROM near",
    "sigma_clip_median": f"WITH {KNN}, {_clipped('value')} SELECT star_id, n_kept, {r6('median')} AS median FROM clip",
    "dr_median": f"WITH {KNN}, {_clipped('residual')} SELECT star_id, {r6('median')} AS shift FROM clip",
    "dr_apply": f"WITH {CORRECTED} SELECT star_id, {r6('new1')} AS new1, {r6('new2')} AS new2, {r6('delta_e')} AS delta_e FROM fixed",
    "dr_threshold": f"""WITH {CORRECTED}, cut AS (SELECT 2 * stddev_pop(delta_e) AS limit_ FROM fixed), moved AS (SELECT *, abs(delta_e) > limit_ AND delta_e <> 0 AS moved FROM fixed, cut)
SELECT star_id, moved, {r6('CASE WHEN moved THEN new1 ELSE band1 END')} AS band1, {r6('CASE WHEN moved THEN new2 ELSE band2 END')} AS band2 FROM moved""",
    "spline_eval": f"WITH {PHOT}, {_rotated('phot')} SELECT star_id, {r6(_RIDGE)} AS ridge, {r6(f'rx - {_RIDGE}')} AS residual FROM rotated",
    "ring_centroid": f"""WITH {STARS}, p AS (SELECT star_id, x, y, epm_ra AS w, epm_dec AS h FROM stars), c AS (SELECT star_id, [x, x + w, x + 2 * w, x] AS px, [y, y, y + h, y + 2 * h] AS py FROM p),
t AS (SELECT star_id, unnest(range(1, 5)) AS i, px, py FROM c), e AS (SELECT star_id, px[i] AS ax, py[i] AS ay, px[i % 4 + 1] AS bx, py[i % 4 + 1] AS by_ FROM t),
s AS (SELECT star_id, sum(ax * by_ - bx * ay) AS a, sum((ax * by_ - bx * ay) * (ax + bx)) AS sx, sum((ax * by_ - bx * ay) * (ay + by_)) AS sy FROM e GROUP BY 1)
SELECT star_id, {r6('abs(a) / 2')} AS area, {r6('sx / (3 * a)')} AS cx, {r6('sy / (3 * a)')} AS cy FROM s""",
    "region_counts": f"WITH {REGIONS} SELECT region AS region_id, n FROM counts",
    "points_in_regions": f"WITH {REGIONS} SELECT region AS region_id, star_id FROM field",
    "median_region_count": f"WITH {REGIONS} SELECT quantile_cont(n::DOUBLE, 0.5) AS median_n FROM counts",
    "cell_count_norm": f"WITH {REGIONS} SELECT region AS region_id, {r6('n / (SELECT max(n) FROM counts)')} AS share FROM counts",
    "common_regions": f"WITH {REGIONS} SELECT region AS region_id, n AS n_field, c AS n_cluster FROM counts JOIN sizes USING (region)",
    "cell_counts_points": f"WITH {REGIONS} SELECT region AS region_id, n AS n_field, star_id FROM counts JOIN cluster USING (region)",
    "mc_rate": f"WITH {REGIONS} SELECT region AS region_id, {r6('rate')} AS rate, floor(rate)::BIGINT AS whole, {r6('rate - floor(rate)')} AS part FROM rates",
    "expected_membership": f"WITH {REGIONS} SELECT star_id, {r6('membership')} AS membership FROM expected",
    "membership_update": f"WITH {REGIONS} SELECT stars.star_id, {r6('coalesce(expected.membership, stars.membership)')} AS membership FROM stars LEFT JOIN expected USING (star_id)",
    "bivar_pdf": f"WITH {STARS} SELECT star_id, {r6(_component(*THETAS[0][5:10]))} AS pdf FROM stars",
    "mvar_pdf": f"WITH {STARS} SELECT star_id, {r6(_component(*THETAS[0][5:10]))} AS pdf FROM stars",
    "univar_pdf": f"WITH {STARS} SELECT star_id, {r6('0.7::DOUBLE * exp(-pow((pm_ra + 3) / 0.5::DOUBLE, 2) / 2) / (0.5::DOUBLE * sqrt(2 * pi()))')} AS pdf FROM stars",
    "mix_loglik": f"WITH {STARS} " + " UNION ALL ".join(f"SELECT {i}::BIGINT AS param_id, {r6(_loglik(t))} AS log_likelihood FROM stars" for i, t in enumerate(THETAS[:3])),
    "mix_log_prior": f"WITH {STARS} SELECT star_id, CASE WHEN pm_ra BETWEEN -4 AND -2 AND pm_dec BETWEEN -7 AND -5 AND epm_ra BETWEEN 0.1::DOUBLE AND 1 AND epm_dec BETWEEN 0.1::DOUBLE AND 1 AND epm_ra - epm_dec BETWEEN -0.5 AND 0.5 AND membership BETWEEN 0.6::DOUBLE AND 1 THEN 0.0::DOUBLE ELSE '-inf'::DOUBLE END AS log_prior FROM stars",
    "mix_fix_link": f"WITH {STARS} SELECT star_id, {', '.join(f'{r6(c)} AS t{i}' for i, c in _FIX_T.items())} FROM stars",
    "mix_posterior": f"WITH {STARS} " + " UNION ALL ".join(f"SELECT {i}::BIGINT AS param_id, {r6(_loglik(_effective(t))) if _allowed(t) else chr(39) + '-inf' + chr(39) + '::DOUBLE'} AS log_posterior FROM {'stars' if _allowed(t) else '(SELECT 1)'}" for i, t in enumerate(THETAS)),
    "mix_membership": f"WITH {STARS}, {DRAWS}, p AS (SELECT star_id, draw, {_draw_parts()} FROM stars, draws) SELECT star_id, 0::BIGINT AS comp, {r6('avg(p0 / (p0 + p1))')} AS p, count(*) AS draws FROM p WHERE p0 + p1 > 0 GROUP BY star_id UNION ALL SELECT star_id, 1::BIGINT, {r6('avg(p1 / (p0 + p1))')}, count(*) FROM p WHERE p0 + p1 > 0 GROUP BY star_id",
    "gauss_bands": f"""WITH {STARS}, {DRAWS}, err AS (SELECT quantile_cont(epm_ra, 0.5) AS e0, quantile_cont(epm_dec, 0.5) AS e1, min(pm_ra) AS a0, max(pm_ra) AS b0, min(pm_dec) AS a1, max(pm_dec) AS b1 FROM stars),
grid AS (SELECT 0::BIGINT AS axis, i, a0 + i * ((b0 - a0) / {GRID - 1}) AS x, e0 AS e FROM range({GRID}) r(i), err UNION ALL SELECT 1, i, a1 + i * ((b1 - a1) / {GRID - 1}), e1 FROM range({GRID}) r(i), err),
one AS (SELECT axis, i, draw, c AS component, CASE WHEN c = 0 THEN t[11] ELSE 1 - t[11] END * exp(-pow(x - t[5 * c + 1 + axis], 2) / (2 * (pow(t[5 * c + 3 + axis], 2) + e * e))) / (sqrt(pow(t[5 * c + 3 + axis], 2) + e * e) * sqrt(2 * pi())) AS p FROM grid, draws, (VALUES (0::BIGINT), (1::BIGINT)) v(c)),
every AS (SELECT axis, i, draw, component, p FROM one UNION ALL SELECT axis, i, draw, -1::BIGINT, sum(p) FROM one GROUP BY ALL)
SELECT axis, i, component, {r6('quantile_cont(p, 0.05)')} AS low, {r6('quantile_cont(p, 0.95)')} AS high FROM every GROUP BY ALL""",
    "chain_write_read": f"WITH {SLICED} SELECT 'kept' AS run_id, count(*) AS n, {r6('sum(theta0)')} AS total FROM sliced UNION ALL SELECT 'burn_in', count(*), {r6('sum(theta0)')} FROM chain WHERE step < {DISCARD}",
    "chain_slice": f"WITH {SLICED} SELECT walker, step, {r6('theta0')} AS theta0 FROM sliced",
    "theta_percentiles": f"WITH {DRAWS}, each AS (SELECT unnest(range(11)) AS param, unnest(t) AS v FROM draws), qs(q) AS (VALUES (0.16::DOUBLE), (0.5::DOUBLE), (0.84::DOUBLE)) SELECT param, q, round(CASE q WHEN 0.5::DOUBLE THEN quantile_cont(v, 0.5) WHEN 0.16::DOUBLE THEN quantile_cont(v, 0.16) ELSE quantile_cont(v, 0.84) END, 6) + 0.0::DOUBLE AS value FROM each, qs GROUP BY param, q",
    "theta_argmax": f"WITH {SLICED}, best AS (SELECT walker, step, [{_THETA}] AS t FROM sliced ORDER BY log_prob DESC, step, walker LIMIT 1) SELECT walker, step, unnest(range(11)) AS param, round(unnest(t), 6) + 0.0::DOUBLE AS value FROM best",
    "regions_join": f"""WITH {STARS}, s AS (SELECT *, band1 - band2 AS x0, band1 AS y0, epm_ra / 4 AS w, epm_dec / 4 AS h FROM stars),
rings AS (SELECT star_id AS region, [x0 - w, x0 + w, x0, x0 + w, x0 - w] AS xs, [y0 - h, y0 - h, y0, y0 + h, y0 + h] AS ys FROM s
  UNION ALL SELECT -1, [min(x0), max(x0), max(x0), min(x0)], [min(y0), min(y0), max(y0), max(y0)] FROM s),
edges AS (SELECT region, unnest(xs) AS ax, unnest(ys) AS ay, unnest(list_concat(xs[2:], xs[1:1])) AS bx, unnest(list_concat(ys[2:], ys[1:1])) AS "by" FROM rings),
met AS (SELECT region, star_id, (y0 < ay) != (y0 < "by") AND x0 < ax + (y0 - ay) * ((bx - ax) / nullif("by" - ay, 0)) AS crossed,
  (bx - ax) * (y0 - ay) - ("by" - ay) * (x0 - ax) = 0 AND x0 BETWEEN least(ax, bx) AND greatest(ax, bx) AND y0 BETWEEN least(ay, "by") AND greatest(ay, "by") AS on_edge FROM edges, s WHERE is_field)
SELECT region AS region_id, star_id FROM met GROUP BY region, star_id HAVING count(*) FILTER (crossed) % 2 = 1 OR bool_or(on_edge)""",
    "region_overlays": f"""WITH {ARROWS},
pairs AS (SELECT a.star_id AS a, b.star_id AS b, a.xs AS axs, a.ys AS ays, b.xs AS bxs, b.ys AS bys FROM rings a JOIN rings b ON a.c AND b.f AND a.lx <= b.hx AND b.lx <= a.hx AND a.ly <= b.hy AND b.ly <= a.hy),
{SWEEP}
SELECT a AS star_id, b AS field_id, {r6('coalesce(shared_area, 0)')} AS "both", {r6('m.area - coalesce(shared_area, 0)')} AS only_a, {r6('n.area - coalesce(shared_area, 0)')} AS only_b, {r6('m.area + n.area - coalesce(shared_area, 0)')} AS either FROM pairs LEFT JOIN shared USING (a, b) JOIN size m ON m.star_id = a JOIN size n ON n.star_id = b""",
    "smeared_counts": f"""WITH {ARROWS}, cells AS (SELECT DISTINCT floor((band1 - band2) / {CELL}::DOUBLE)::BIGINT AS i, floor(band1 / {CELL}::DOUBLE)::BIGINT AS j FROM stars),
grid AS (SELECT i * 1000000 + j AS cell, i * {CELL}::DOUBLE AS lx, (i + 1) * {CELL}::DOUBLE AS hx, j * {CELL}::DOUBLE AS ly, (j + 1) * {CELL}::DOUBLE AS hy FROM cells),
pairs AS (SELECT r.star_id AS a, g.cell AS b, r.xs AS axs, r.ys AS ays, [g.lx, g.hx, g.hx, g.lx] AS bxs, [g.ly, g.ly, g.hy, g.hy] AS bys FROM rings r JOIN grid g ON r.lx <= g.hx AND g.lx <= r.hx AND r.ly <= g.hy AND g.ly <= r.hy),
{SWEEP}
SELECT b AS cell, {r6('sum(coalesce(shared_area, 0) / area)')} AS n, {r6('sum(coalesce(shared_area, 0))')} AS area FROM pairs LEFT JOIN shared USING (a, b) JOIN size ON star_id = a GROUP BY b""",
    "grid_outlines": f"""WITH {PHOT}, cm AS (SELECT band1 - band2 AS x, band1 AS y FROM phot), ends AS (SELECT min(x) AS x0, (max(x) - min(x)) / 50 AS wx, min(y) AS y0, (max(y) - min(y)) / 50 AS wy FROM cm),
cells AS (SELECT least(floor((x - x0) / wx), 49)::BIGINT AS ix, least(floor((y - y0) / wy), 49)::BIGINT AS iy, count(*) AS n FROM cm, ends GROUP BY ALL),
named AS (SELECT ix, iy, (n >= {OFTEN})::BIGINT AS region FROM cells),
beside AS (SELECT a.region, a.ix, a.iy, count(b.ix) AS k FROM named a LEFT JOIN named b ON a.region = b.region AND abs(a.ix - b.ix) + abs(a.iy - b.iy) = 1 GROUP BY ALL)
SELECT region AS region_id, count(*)::DOUBLE AS area, sum(4 - k)::BIGINT AS border FROM beside GROUP BY region""",
    "chain_percentiles": f"WITH {SLICED} {_percentiles('sliced', 'theta0')}",
    "chain_argmax": f"WITH {CHAIN} SELECT walker, step, {r6('theta0')} AS theta0 FROM chain ORDER BY log_prob DESC, step, walker LIMIT 1",
    "trace_long": f"WITH {CHAIN} " + " UNION ALL ".join(f"SELECT walker, step, '{p}' AS param, {r6(p)} AS value, CASE WHEN step < {DISCARD} THEN 'burn_in' ELSE 'kept' END AS part FROM chain" for p in ("theta0", "log_prob")),
    "corner_hist": f"WITH {SLICED}, params AS (SELECT theta0, log_prob, step::DOUBLE AS step FROM sliced) " + " UNION ALL ".join(_corner()),
    "scan_whitespace": f"WITH {PHOT} SELECT star_id, {r6('x')} AS x, {r6('band1')} AS band1, {r6('membership')} AS membership FROM phot",
    "scan_csv": f"WITH {PHOT} SELECT star_id, {r6('x')} AS x, {r6('band1')} AS band1, {r6('membership')} AS membership FROM phot",
}


#: Vertices of the hull: directions to all other points leave a gap of over half a turn. In order from the least vertex.
ORACLE_SQL["convex_hull"] = f"""WITH {STARS}, p AS (SELECT DISTINCT ra AS x, "dec" AS y FROM stars),
  ways AS (SELECT a.x, a.y, atan2(b.y - a.y, b.x - a.x) AS t FROM p a JOIN p b ON a.x <> b.x OR a.y <> b.y),
  gaps AS (SELECT x, y, coalesce(lead(t) OVER (PARTITION BY x, y ORDER BY t), min(t) OVER (PARTITION BY x, y) + 2 * pi()) - t AS gap FROM ways),
  v AS (SELECT x, y FROM gaps GROUP BY x, y HAVING max(gap) > pi() + 1e-12), mid AS (SELECT avg(x) AS mx, avg(y) AS my FROM v),
  turned AS (SELECT x, y, atan2(y - my, x - mx) AS t FROM v, mid), first AS (SELECT t AS t0 FROM turned ORDER BY x, y LIMIT 1)
SELECT row_number() OVER (ORDER BY CASE WHEN t < t0 THEN t + 2 * pi() ELSE t END) - 1 AS k, x, y FROM turned, first"""

#: Each pair's bisector, run along by s, cut by the bisectors with all others and by the box: what is left is the border of both cells.
#: A cell is made of the triangles between its star and its borders.
CELLS = f"""{STARS}, p AS (SELECT star_id AS id, band1 - band2 AS x, band1 AS y FROM stars),
  box AS (SELECT min(x) - {PAD} AS x0, max(x) + {PAD} AS x1, min(y) - {PAD} AS y0, max(y) + {PAD} AS y1 FROM p),
  pairs AS (SELECT a.id AS i, b.id AS j, a.x AS ax, a.y AS ay, b.x - a.x AS wx, b.y - a.y AS wy FROM p a JOIN p b ON a.id < b.id),
  cuts AS (SELECT i, j, 2 * (wx * (c.y - ay) - wy * (c.x - ax)) AS a, (c.x - ax) ** 2 + (c.y - ay) ** 2 - wx * (c.x - ax) - wy * (c.y - ay) AS b FROM pairs, p c WHERE c.id <> i AND c.id <> j
    UNION ALL SELECT i, j, -wy, x1 - ax - wx / 2 FROM pairs, box UNION ALL SELECT i, j, wy, ax + wx / 2 - x0 FROM pairs, box
    UNION ALL SELECT i, j, wx, y1 - ay - wy / 2 FROM pairs, box UNION ALL SELECT i, j, -wx, ay + wy / 2 - y0 FROM pairs, box),
  spans AS (SELECT i, j, max(CASE WHEN a < 0 THEN b / a END) AS low, min(CASE WHEN a > 0 THEN b / a END) AS high FROM cuts GROUP BY i, j),
  borders AS (SELECT * FROM spans WHERE low <= high)"""
ORACLE_SQL["cell_adjacency"] = f"WITH {CELLS} SELECT i, j FROM borders"
ORACLE_SQL["cell_areas"] = f"""WITH {CELLS},
  inner_parts AS (SELECT i, j, (high - low) * (wx * wx + wy * wy) / 4 AS part FROM borders JOIN pairs USING (i, j)),
  sides AS (SELECT id, x, y, x1 - x AS fx, 0.0::DOUBLE AS fy, y0 - y AS low, y1 - y AS high, true AS upright FROM p, box UNION ALL SELECT id, x, y, x0 - x, 0.0, y0 - y, y1 - y, true FROM p, box
    UNION ALL SELECT id, x, y, 0.0, y1 - y, x0 - x, x1 - x, false FROM p, box UNION ALL SELECT id, x, y, 0.0, y0 - y, x0 - x, x1 - x, false FROM p, box),
  side_cuts AS (SELECT s.id, s.fx, s.fy, s.low, s.high, 2 * CASE WHEN upright THEN c.y - s.y ELSE c.x - s.x END AS a, (c.x - s.x) ** 2 + (c.y - s.y) ** 2 - 2 * (s.fx * (c.x - s.x) + s.fy * (c.y - s.y)) AS b FROM sides s JOIN p c ON c.id <> s.id),
  outer_parts AS (SELECT id, abs(fx + fy) / 2 * greatest(0, least(max(high), min(CASE WHEN a > 0 THEN b / a END)) - greatest(max(low), max(CASE WHEN a < 0 THEN b / a END))) AS part FROM side_cuts GROUP BY id, fx, fy),
  parts AS (SELECT i AS id, part, 1 AS n FROM inner_parts UNION ALL SELECT j, part, 1 FROM inner_parts UNION ALL SELECT id, part, 0 FROM outer_parts)
SELECT id AS star_id, {r6("sum(part)")} AS area, sum(n)::BIGINT AS n_neighbours FROM parts GROUP BY id"""
