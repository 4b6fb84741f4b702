"""The reference-style queries over the stand-in catalogues, by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expressions as X
from ..operators import chains, decontamination, mixture, neighbours, overlays, regions, splines, statistics, tessellation
from ..shared import new_path, tidy
from ..sources.catalogues import chain, photometry, read_chain, stars, write_chain
from ..sources.catalogues import scan_csv as scan_comma
from ..sources.catalogues import scan_whitespace as scan_text
from . import membership, sampler

DR = X.Reddening()
MEMBER = 0.5
#: Vertices of the region of interest in the rotated diagram.
ROI = [(-6.0, -1.5), (3.0, -1.5), (3.0, 0.9), (-6.0, 0.9)]
STEP = 0.2
ERROR_CUT = 0.2
MIN_STARS = 200
NEIGHBOURS = 5
FOV_RATIO = 0.8
PAD = 0.1
#: Radii (degrees) between the annuli.
RADII = (0.01, 0.02, 0.03, 0.05)
#: A ridge of one cubic: coefficients of 1, y, y squared, y cubed.
RIDGE = (0.1, 0.2, -0.05, 0.01)
LOW = [-5.0, -8.0, 0.05, 0.05, -0.9] * 2 + [0.0]
HIGH = [0.0, -4.0, 3.0, 3.0, 0.9] * 2 + [1.0]
THETAS = [
    [-3.0, -6.0, 0.3, 0.3, 0.0, -2.5, -5.5, 1.0, 1.2, 0.2, 0.6],
    [-2.9, -6.1, 0.4, 0.2, 0.1, -3.2, -6.3, 0.8, 0.9, -0.3, 0.3],
    [-3.1, -5.9, 0.5, 0.6, -0.2, -2.0, -5.0, 1.5, 1.4, 0.4, 1.0],
    [-9.0, -5.9, 0.5, 0.6, -0.2, -2.0, -5.0, 1.5, 1.4, 0.4, 0.5],
]
FIXED: list[float | None] = [None] * 4 + [0.0] + [None] * 6
LINKS = [(2, 3)]
DISCARD, THIN = 10, 5
#: How far draws scatter, and places of a grid along an axis.
SCATTER, GRID = 0.05, 100
#: Stars of a well-filled cell of a histogram, and how near corners of cells are the same.
OFTEN, SNAP = 2, 1e-9
#: Side of a cell (magnitudes) over which outlines of stars are spread.
CELL = 0.25
#: Field stars that a computed annulus should hold.
GROUP_STARS = 100


def r6(c: Column) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(F.col(c)) for c in cols})


def _xy(df: DataFrame, x, y) -> DataFrame:
    return df.select(F.col("star_id").alias("id"), x.alias("x"), y.alias("y"))


def _color() -> Column:
    return F.col("band1") - F.col("band2")


def cmd_project(spark, d):
    return photometry(spark, d).select("star_id", F.round(_color(), 9).alias("color"), F.round("band1", 9).alias("mag"))


def filter_members(spark, d):
    return photometry(spark, d).filter(F.col("membership") > MEMBER).select("star_id", r6(F.col("membership")).alias("membership"))


def split_members(spark, d):
    side = F.when(F.col("membership") > MEMBER, "member").when(F.col("membership") < MEMBER, "rejected")
    return photometry(spark, d).select("star_id", side.alias("side"))


def filter_error_cut(spark, d):
    return stars(spark, d).filter((F.abs("epm_ra") < ERROR_CUT) & (F.abs("epm_dec") < ERROR_CUT) & (F.col("oktot") == 1)).select("star_id")


def filter_quality(spark, d):
    return stars(spark, d).filter("oktot = 1").select("star_id")


def split_catalogs(spark, d):
    kinds = F.array(F.when(F.col("is_cluster"), "cluster"), F.when(F.col("is_field"), "field"))
    return stars(spark, d).select("star_id", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("catalog"))


def _rotated(df: DataFrame) -> DataFrame:
    x, y = DR.rotate(F.col("band1"), F.col("band2"))
    return df.select("*", x.alias("rx"), y.alias("ry"))


def rotate_cmd(spark, d):
    return _rounded(_rotated(photometry(spark, d)), "rx", "ry").select("star_id", "rx", "ry")


def _roi(spark, d) -> DataFrame:
    rotated = _rotated(photometry(spark, d).filter(F.col("membership") > MEMBER))
    return rotated.filter(X.inside_polygon(F.col("rx"), F.col("ry"), ROI))


def roi_filter(spark, d):
    return _roi(spark, d).select("star_id")


def fiducial_bins(spark, d):
    return _rounded(statistics.binned_medians(_roi(spark, d).select("rx", "ry"), "ry", "rx", STEP), "ordinate", "abscissa")


def hist_density(spark, d):
    return _rounded(statistics.histogram(photometry(spark, d).select("membership"), "membership", 30), "density")


def hist2d_density(spark, d):
    df = photometry(spark, d).select(_color().alias("color"), F.col("band1").alias("mag"))
    return _rounded(statistics.histogram2d(df, "color", "mag", 200), "density")


def density_weights(spark, d):
    df = photometry(spark, d).select("star_id", _color().alias("color"), F.col("band1").alias("mag"))
    return _rounded(statistics.density_weights(df, "star_id", "color", "mag", 200), "weight")


def membership_percentiles(spark, d):
    return _rounded(statistics.percentiles(photometry(spark, d), "membership"), "value")


def hexbin_median(spark, d):
    df = photometry(spark, d).select("x", "y", _color().alias("color"))
    return _rounded(statistics.hexagon_medians(df, "x", "y", "color", 100), "median")


def describe_column(spark, d):
    return _rounded(statistics.describe(photometry(spark, d), "band1"), "mean", "std", "min", "p25", "p50", "p75", "max")


def _center(df: DataFrame) -> DataFrame:
    mid = lambda c: F.min(c) + (F.max(c) - F.min(c)) / 2
    return df.agg(mid("ra").alias("ra_mid"), mid("dec").alias("dec_mid"))


def bbox_center(spark, d):
    return _rounded(_center(stars(spark, d)), "ra_mid", "dec_mid")


def _separations(spark, d) -> DataFrame:
    df = stars(spark, d)
    ra, dec = _center(df).first() or (None, None)
    return df.select("*", X.sky_separation(F.lit(ra), F.lit(dec), F.col("ra"), F.col("dec")).alias("sep"))


def sky_separation(spark, d):
    return _separations(spark, d).select("star_id", r6(F.col("sep")).alias("sep"))


def field_density(spark, d):
    row = _separations(spark, d).agg(F.count("*").alias("n"), F.max("sep").alias("max_sep"))
    density = F.col("n") / (F.pi() * F.col("max_sep") * F.col("max_sep"))
    return _rounded(row.select("n", "max_sep", density.alias("density"), (MIN_STARS / density).alias("min_area")), "max_sep", "density", "min_area")


def annulus_assign(spark, d):
    df = stars(spark, d)
    ra, dec = _center(df).first() or (None, None)
    dist = F.sqrt((F.col("ra") - F.lit(ra)) ** 2 + (F.col("dec") - F.lit(dec)) ** 2)
    group, low = F.lit(None).cast("long"), 0.0
    for i, high in enumerate(RADII):
        group = F.when((F.col("d") > low) & (F.col("d") < high), F.lit(i).cast("long")).otherwise(group)
        low = high
    return df.select("star_id", dist.alias("d")).select("star_id", group.alias("group_id")).filter("group_id is not null")


def _neighbours(spark, d) -> DataFrame:
    """Second to sixth nearest members of every star; the nearest is left out, for members it is the star itself."""
    df = _rotated(stars(spark, d))
    refs = df.filter(F.col("membership") > MEMBER)
    near = neighbours.nearest(_xy(df, F.col("x"), F.col("y")), _xy(refs, F.col("x"), F.col("y")), NEIGHBOURS + 1)
    ridge = sum((c * F.col("ry") ** i for i, c in enumerate(RIDGE)), F.lit(0.0))
    values = refs.select(F.col("star_id").alias("ref"), "rx", (F.col("rx") - ridge).alias("residual"))
    return near.filter("rank > 1").join(values, "ref")


def knn_join(spark, d):
    return _neighbours(spark, d).select(F.col("id").alias("star_id"), F.col("ref").alias("ref_id"), (F.col("rank") - 1).cast("long").alias("rank"), r6(F.sqrt("d2")).alias("dist"))


def sigma_clip_median(spark, d):
    return _rounded(neighbours.clipped_medians(_neighbours(spark, d), "id", "rx"), "median").withColumnRenamed("id", "star_id")


def _medians(spark, d) -> DataFrame:
    return neighbours.clipped_medians(_neighbours(spark, d), "id", "residual").select(F.col("id").alias("star_id"), F.col("median").alias("shift"))


def dr_median(spark, d):
    return _rounded(_medians(spark, d), "shift")


def _corrected(spark, d) -> DataFrame:
    b1, b2, de = DR.corrected(F.col("band1"), F.col("band2"), F.col("shift"))
    return stars(spark, d).join(_medians(spark, d), "star_id").select("star_id", "band1", "band2", b1.alias("new1"), b2.alias("new2"), de.alias("delta_e"))


def dr_apply(spark, d):
    return _rounded(_corrected(spark, d).select("star_id", "new1", "new2", "delta_e"), "new1", "new2", "delta_e")


def dr_threshold(spark, d):
    df = _corrected(spark, d)
    limit = 2 * df.agg(F.stddev_pop("delta_e")).first()[0]
    moved = (F.abs("delta_e") > limit) & (F.col("delta_e") != 0)
    return _rounded(df.select("star_id", moved.alias("moved"), F.when(moved, F.col("new1")).otherwise(F.col("band1")).alias("band1"), F.when(moved, F.col("new2")).otherwise(F.col("band2")).alias("band2")), "band1", "band2")


def spline_eval(spark, d):
    df = _rotated(photometry(spark, d))
    ridge = sum((c * F.col("ry") ** i for i, c in enumerate(RIDGE)), F.lit(0.0))
    return df.select("star_id", r6(ridge).alias("ridge"), r6(F.col("rx") - ridge).alias("residual"))


def ridge_residuals(spark, d):
    """Stars' distances from a spline through the medians of the fiducial bins."""
    knots = sorted((r["ordinate"], r["abscissa"]) for r in statistics.binned_medians(_roi(spark, d).select("rx", "ry"), "ry", "rx", STEP).collect())
    ridge = splines.evaluate(F.col("ry"), *splines.fit([k[0] for k in knots], [k[1] for k in knots]))
    return _rotated(photometry(spark, d)).select("star_id", r6(ridge).alias("ridge"), r6(F.col("rx") - ridge).alias("residual"))


SCANNED = T.StructType([T.StructField("star_id", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("x", "band1", "membership"))])


def scan_whitespace(spark, d):
    """The photometry written as text between runs of blanks, scanned for some of its columns."""
    path, df = new_path(spark), photometry(spark, d)
    df.select(F.concat_ws("  ", F.lit(""), *(F.col(c).cast("string") for c in df.columns), F.lit("")).alias("value")).write.text(path)
    return _rounded(scan_text(spark, path, SCANNED, df.columns), "x", "band1", "membership")


def scan_csv(spark, d):
    """The photometry written as comma-separated files with headers, scanned for some of its columns."""
    path = new_path(spark)
    photometry(spark, d).write.csv(path, header=True)
    return _rounded(scan_comma(spark, path, SCANNED), "x", "band1", "membership")


def ring_centroid(spark, d):
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y, w, h = F.col("x"), F.col("y"), F.col("epm_ra"), F.col("epm_dec")
    ring = F.array(p(x, y), p(x + w, y), p(x + 2 * w, y + h), p(x, y + 2 * h))
    df = stars(spark, d).select("star_id", X.ring_area_centroid(ring).alias("r")).select("star_id", "r.*")
    return _rounded(df, "area", "cx", "cy")


def _regions(spark, d) -> tuple[DataFrame, DataFrame]:
    """Field and cluster stars by cell: cells around the surest members, in the colour-magnitude plane."""
    df = stars(spark, d)
    generators = _xy(df.filter("is_cluster and membership = 1"), _color(), F.col("band1"))
    at = lambda who: neighbours.assign_regions(_xy(df.filter(who), _color(), F.col("band1")), generators, PAD)
    return at("is_field"), at("is_cluster")


def _arrows(df: DataFrame) -> DataFrame:
    """A concave outline around every star, as large as its errors, in the colour-magnitude plane."""
    x, y, w, h = _color(), F.col("band1"), F.col("epm_ra") / 4, F.col("epm_dec") / 4
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return df.select(F.col("star_id").alias("region"), F.array(p(x - w, y - h), p(x + w, y - h), p(x, y), p(x + w, y + h), p(x - w, y + h)).alias("ring"))


def regions_join(spark, d):
    """Field stars in each of many outlines: an arrow around every star, as large as its errors, and one outline around all."""
    df = stars(spark, d)
    x, y = _color(), F.col("band1")
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ends = df.agg(F.min(x).alias("a"), F.max(x).alias("b"), F.min(y).alias("c"), F.max(y).alias("d"))
    whole = ends.select(F.lit(-1).cast("long").alias("region"), F.array(*(p(F.col(u), F.col(v)) for u, v in ("ac", "bc", "bd", "ad"))).alias("ring"))
    found = regions.points_in_polygons(_xy(df.filter("is_field"), x, y), _arrows(df).union(whole))
    return found.select(F.col("region").alias("region_id"), F.col("id").alias("star_id"))


def region_overlays(spark, d):
    """What the arrows around cluster stars share with those around the stars of the field alone, and keep for themselves."""
    df = stars(spark, d)
    found = overlays.overlay_areas(_arrows(df.filter("is_cluster")), _arrows(df.filter("is_field and not is_cluster")))
    return _rounded(found.select(F.col("a").alias("star_id"), F.col("b").alias("field_id"), "both", "only_a", "only_b", "either"), "both", "only_a", "only_b", "either")


def smeared_counts(spark, d):
    """Stars in each filled cell of the colour-magnitude plane, each spread evenly over the arrow of its errors."""
    df = stars(spark, d)
    i, j = F.floor(_color() / CELL), F.floor(F.col("band1") / CELL)
    p = lambda u, v: F.struct(((F.col("i") + u) * CELL).alias("x"), ((F.col("j") + v) * CELL).alias("y"))
    cells = df.select(i.alias("i"), j.alias("j")).distinct().select((F.col("i") * 1_000_000 + F.col("j")).alias("region"), F.array(p(0, 0), p(1, 0), p(1, 1), p(0, 1)).alias("ring"))
    found = overlays.overlay_areas(_arrows(df), cells)
    spread = found.groupBy(F.col("b").alias("cell")).agg(F.sum(F.col("both") / (F.col("both") + F.col("only_a"))).alias("n"), F.sum("both").alias("area"))
    return _rounded(spread, "n", "area")


def grid_outlines(spark, d):
    """Rings, area and border of what the cells of a 2-D histogram with many and with few stars cover."""
    df = photometry(spark, d).select(_color().alias("color"), F.col("band1").alias("mag"))
    cells = statistics.histogram2d(df, "color", "mag", 50)
    p = lambda i, j: F.struct((F.col("ix") + i).cast("double").alias("x"), (F.col("iy") + j).cast("double").alias("y"))
    named = cells.select((F.col("ix") * 50 + F.col("iy")).alias("id"), F.array(p(0, 0), p(1, 0), p(1, 1), p(0, 1)).alias("ring"), (F.col("n") >= OFTEN).cast("long").alias("region"))
    found = regions.dissolve(named.select("id", "ring"), named.select(F.col("id").alias("cell"), "region"))
    return found.groupBy(F.col("region").alias("region_id")).agg(r6(F.sum("area")).alias("area"), F.sum(F.size("ring")).cast("long").alias("border"))


def region_outlines(spark, d):
    """Outlines of the regions that greedy merging makes of the stars' cells."""
    cells = tessellation.voronoi_cells(_points(spark, d), PAD)
    merged = tessellation.merge_regions(cells, tessellation.adjacency(cells))
    return regions.dissolve(cells, merged.select(F.col("id").alias("cell"), F.col("parent").alias("region")), SNAP).select(F.col("region").alias("region_id"), "part", r6(F.col("area")).alias("area"), F.size("ring").cast("long").alias("corners"))


def region_counts(spark, d):
    return decontamination.region_counts(_regions(spark, d)[0]).select(F.col("region").alias("region_id"), "n")


def points_in_regions(spark, d):
    return _regions(spark, d)[0].select(F.col("region").alias("region_id"), F.col("id").alias("star_id"))


def median_region_count(spark, d):
    return region_counts(spark, d).agg(F.percentile("n", 0.5).alias("median_n"))


def cell_count_norm(spark, d):
    counts = region_counts(spark, d)
    top = counts.agg(F.max("n")).first()[0]
    return counts.select("region_id", r6(F.col("n") / F.lit(top)).alias("share"))


def common_regions(spark, d):
    field, cluster = _regions(spark, d)
    a, b = decontamination.region_counts(field).withColumnRenamed("n", "n_field"), decontamination.region_counts(cluster).withColumnRenamed("n", "n_cluster")
    return a.join(b, "region").withColumnRenamed("region", "region_id")


def cell_counts_points(spark, d):
    field, cluster = _regions(spark, d)
    return decontamination.region_counts(field).join(cluster, "region").select(F.col("region").alias("region_id"), F.col("n").alias("n_field"), F.col("id").alias("star_id"))


def _rates(field: DataFrame) -> DataFrame:
    return decontamination.region_counts(field).select("region", decontamination.expected_rate(F.col("n"), FOV_RATIO).alias("rate"))


def mc_rate(spark, d):
    rates = _rates(_regions(spark, d)[0])
    return _rounded(rates.select(F.col("region").alias("region_id"), "rate", F.floor("rate").cast("long").alias("whole"), (F.col("rate") - F.floor("rate")).alias("part")), "rate", "part")


def _expected(spark, d) -> DataFrame:
    field, cluster = _regions(spark, d)
    return decontamination.expected_membership(_rates(field), cluster)


def expected_membership(spark, d):
    return _rounded(_expected(spark, d), "membership").withColumnRenamed("id", "star_id")


def membership_update(spark, d):
    old = stars(spark, d).select(F.col("star_id").alias("id"), "membership")
    return _rounded(decontamination.update_membership(old, _expected(spark, d)), "membership").withColumnRenamed("id", "star_id")


def mc_membership(spark, d):
    field, cluster = _regions(spark, d)
    return decontamination.sampled_membership(_rates(field), cluster, 1000).withColumnRenamed("id", "star_id")


def bivar_pdf(spark, d):
    t = THETAS[0]
    p = X.bivariate_normal(F.col("pm_ra"), F.col("pm_dec"), *X.observed(*t[5:10], F.col("epm_ra"), F.col("epm_dec")))
    return stars(spark, d).select("star_id", r6(p).alias("pdf"))


def mvar_pdf(spark, d):
    mu1, mu2, s1, s2, rho = THETAS[0][5:10]
    p = X.covariance_normal(F.col("pm_ra"), F.col("pm_dec"), mu1, mu2, s1 * s1 + F.col("epm_ra") ** 2, F.lit(rho * s1 * s2), s2 * s2 + F.col("epm_dec") ** 2)
    return stars(spark, d).select("star_id", r6(p).alias("pdf"))


def univar_pdf(spark, d):
    return stars(spark, d).select("star_id", r6(X.univariate_normal(F.col("pm_ra"), -3.0, 0.5, 0.7)).alias("pdf"))


def mix_loglik(spark, d):
    return _rounded(mixture.log_likelihoods(stars(spark, d), THETAS[:3]), "log_likelihood")


def mix_log_prior(spark, d):
    theta = [F.col(c) for c in ("pm_ra", "pm_dec", "epm_ra", "epm_dec", "rho", "membership")]
    df = stars(spark, d).withColumn("rho", F.col("epm_ra") - F.col("epm_dec"))
    return df.select("star_id", mixture.log_prior(theta, [-4.0, -7.0, 0.1, 0.1, -0.5, 0.6], [-2.0, -5.0, 1.0, 1.0, 0.5, 1.0]).alias("log_prior"))


def mix_fix_link(spark, d):
    theta = mixture.fix_and_link(F.array("pm_ra", "pm_dec", "epm_ra", "epm_dec", "membership"), FIXED[:5], LINKS)
    return stars(spark, d).select("star_id", theta.alias("t")).select("star_id", *(r6(F.get("t", F.lit(i))).alias(f"t{i}") for i in range(5)))


def mix_posterior(spark, d):
    return _rounded(mixture.log_posteriors(stars(spark, d), THETAS, LOW, HIGH, FIXED, LINKS), "log_posterior")


def _draws(spark, d) -> DataFrame:
    """A parameter vector for every kept step of every walker, scattered about the first of THETAS by what the walker has seen."""
    part = lambda i: F.abs("theta0") * (i + 1) % 1
    theta = F.array(*(F.lit(t) + SCATTER * part(i) for i, t in enumerate(THETAS[0])))
    return chains.slice_chain(chain(spark, d), DISCARD, THIN).select("walker", "step", theta.alias("theta"), "log_prob")


def mix_membership(spark, d):
    """Mean membership over all kept draws."""
    return _rounded(mixture.mean_membership(stars(spark, d), "star_id", _draws(spark, d), len(THETAS[0])), "p")


def gauss_bands(spark, d):
    """Bands over GRID places along either axis of the proper motions, widened by the median errors."""
    df = stars(spark, d)
    errors = tuple(statistics.exact_quantiles(df, c, (0.5,))[0] or 0.0 for c in ("epm_ra", "epm_dec"))
    ends = df.agg(*(f(c) for c in ("pm_ra", "pm_dec") for f in (F.min, F.max))).first()
    place = lambda low, high: F.lit(low) + F.col("i") * F.lit((high - low) / (GRID - 1))
    axes = F.array(*(F.struct(F.lit(a).cast("long").alias("axis"), place(*ends[2 * a : 2 * a + 2]).alias("x")) for a in (0, 1)))
    grid = spark.range(GRID if ends[0] is not None else 0).withColumnRenamed("id", "i").select("i", F.explode(axes).alias("e")).select("i", "e.*")
    return _rounded(mixture.density_bands(grid, _draws(spark, d), len(THETAS[0]), errors), "low", "high")


def chain_slice(spark, d):
    return _rounded(chains.slice_chain(chain(spark, d), DISCARD, THIN).select("walker", F.col("step").cast("long").alias("step"), "theta0"), "theta0")


def theta_percentiles(spark, d):
    """Percentiles of every parameter of the kept steps."""
    return _rounded(chains.parameter_quantiles(_draws(spark, d)), "value")


def theta_argmax(spark, d):
    """The most probable kept step's value of every parameter."""
    best = chains.best_step(_draws(spark, d))
    return _rounded(best.select("walker", F.col("step").cast("long").alias("step"), F.posexplode("theta").alias("param", "value")).withColumn("param", F.col("param").cast("long")), "value")


def chain_percentiles(spark, d):
    return _rounded(statistics.percentiles(chains.slice_chain(chain(spark, d), DISCARD, THIN), "theta0"), "value")


def chain_argmax(spark, d):
    return _rounded(chains.best_step(chain(spark, d)).select("walker", F.col("step").cast("long").alias("step"), "theta0"), "theta0")


def trace_long(spark, d):
    return _rounded(chains.trace(chain(spark, d), ["theta0", "log_prob"], DISCARD).withColumn("step", F.col("step").cast("long")), "value")


def corner_hist(spark, d):
    return _rounded(statistics.corner(chains.slice_chain(chain(spark, d), DISCARD, THIN), ["theta0", "log_prob", "step"], 20), "value")


def chain_write_read(spark, d):
    """Burn-in and kept steps stored as two runs, read back and summed by run."""
    path = new_path(spark)
    sliced = chains.slice_chain(chain(spark, d), DISCARD, THIN)
    write_chain(sliced, path, "kept")
    write_chain(chain(spark, d).filter(F.col("step") < DISCARD), path, "burn_in")
    return read_chain(spark, path).groupBy("run_id").agg(F.count("*").alias("n"), r6(F.sum("theta0")).alias("total"))


def _points(spark, d, where: str = "true") -> DataFrame:
    return stars(spark, d).filter(where).select(F.col("star_id").alias("id"), F.lit(0).cast("long").alias("g"), _color().alias("x"), F.col("band1").alias("y"))


def convex_hull(spark, d):
    return tessellation.convex_hull(stars(spark, d), "ra", "dec")


def _groups(spark, d) -> tuple[DataFrame, list[tuple]]:
    df = stars(spark, d)
    return membership.spatial_groups(df.filter("is_cluster"), df.filter("is_field"), GROUP_STARS)


def annulus_groups(spark, d):
    """Cluster stars by computed annulus."""
    return _groups(spark, d)[0].select("star_id", F.col("g").alias("group_id"))


def annuli(spark, d):
    groups, rings = _groups(spark, d)
    table = spark.createDataFrame(rings or [(0, 0.0, 0.0, 0.0, 0.0)], "group_id long, r_low double, r_high double, area double, fov_ratio double").limit(len(rings))
    return table.join(groups.groupBy(F.col("g").alias("group_id")).agg(F.count("*").alias("n")), "group_id", "left")


def voronoi_cells(spark, d):
    return tessellation.voronoi_cells(_points(spark, d), PAD).drop("g")


def cell_adjacency(spark, d):
    return tessellation.adjacency(tessellation.voronoi_cells(_points(spark, d), PAD))


def cell_areas(spark, d):
    """Area and number of neighbours of each star's cell."""
    cells = tessellation.voronoi_cells(_points(spark, d), PAD)
    return cells.select(F.col("id").alias("star_id"), r6(F.col("area")).alias("area"), F.size("touches").cast("long").alias("n_neighbours"))


def cvt(spark, d):
    return tessellation.centroidal(_points(spark, d), 3, PAD).select("id", "x", "y", "area")


def merge_regions(spark, d):
    cells = tessellation.voronoi_cells(_points(spark, d), PAD)
    return tessellation.merge_regions(cells, tessellation.adjacency(cells))


def dilate_grid(spark, d):
    return tessellation.region_grid(_points(spark, d), "dilation", 1, PAD, 20.0)[1]


def kmeans_centroids(spark, d):
    return tessellation.kmeans_centroids(_weighted(spark, d), 20)


def _weighted(spark, d) -> DataFrame:
    points = _points(spark, d)
    return points.join(statistics.density_weights(points, "id", "x", "y", 20), "id")


def cvt_grid(spark, d):
    return tessellation.region_grid(_weighted(spark, d), "wkmeans", 2, PAD, 30.0, 20)[1]


def statistical_membership(spark, d):
    df = stars(spark, d)
    roi = [(-8.0, -8.0), (8.0, -8.0), (8.0, 8.0), (-8.0, 8.0)]
    return membership.statistical_membership(df.filter("is_cluster"), df.filter("is_field"), DR, roi, nref=10, step=0.5, threshold=0.3, iterations=3, min_stars=GROUP_STARS, target_median=3.0)


def membership_metrics(spark, d):
    """What two iterations of the membership loop report while they write their states."""
    df, metrics = stars(spark, d), []
    roi = [(-8.0, -8.0), (8.0, -8.0), (8.0, 8.0), (-8.0, 8.0)]
    membership.statistical_membership(df.filter("is_cluster"), df.filter("is_field"), DR, roi, nref=10, step=0.5, threshold=0.3, iterations=2, min_stars=GROUP_STARS, metrics=metrics)
    return _rounded(spark.createDataFrame(metrics, membership.METRICS), "membership", "delta_ebv")


def _box(spark, d) -> tuple[list[float], list[float]]:
    """A box around the middle of the proper motions."""
    ra, dec = (statistics.exact_quantiles(stars(spark, d), c, (0.5,))[0] for c in ("pm_ra", "pm_dec"))
    low, high = [ra - 1, dec - 1, 0.01, 0.01, -0.8] * 2 + [0.0], [ra + 1, dec + 1, 2.0, 2.0, 0.8] * 2 + [1.0]
    return low, high


def sampler_init(spark, d):
    return sampler.start_table(spark, 2, 32, *_box(spark, d))


def sampler_run(spark, d):
    return sampler.sample(stars(spark, d), 2, 32, 60, *_box(spark, d))


def sampler_resume(spark, d):
    """A stored chain of 4 steps, continued by 4 more: steps, walkers and the mean log probability of each step."""
    path, box = new_path(spark), _box(spark, d)
    for _ in range(2):
        run = sampler.sample(stars(spark, d), 1, 24, 4, *box, path=path)
    return run.groupBy("chain_id", F.col("step").cast("long").alias("step")).agg(F.count_distinct("walker").alias("walkers"), F.avg("log_prob").alias("log_prob"))


QUERIES = {f.__name__: tidy(f) for f in (
    cmd_project, filter_members, split_members, filter_error_cut, filter_quality, split_catalogs, rotate_cmd, roi_filter, fiducial_bins,
    hist_density, hist2d_density, density_weights, membership_percentiles, hexbin_median, describe_column, bbox_center, sky_separation,
    field_density, annulus_assign, knn_join, sigma_clip_median, dr_median, dr_apply, dr_threshold, spline_eval, ring_centroid,
    ridge_residuals, regions_join, region_overlays, smeared_counts, grid_outlines, region_outlines, theta_percentiles, theta_argmax, scan_whitespace, scan_csv, annulus_groups, region_counts, points_in_regions, median_region_count, cell_count_norm, common_regions, cell_counts_points, mc_rate,
    expected_membership, membership_update, mc_membership, bivar_pdf, mvar_pdf, univar_pdf, mix_loglik, mix_log_prior, mix_fix_link,
    mix_posterior, mix_membership, gauss_bands, chain_write_read, convex_hull, annuli, voronoi_cells, cell_adjacency, cell_areas, cvt, merge_regions,
    dilate_grid, kmeans_centroids, cvt_grid, statistical_membership, membership_metrics, sampler_init, sampler_run, sampler_resume, chain_slice, chain_percentiles, chain_argmax, trace_long, corner_hist,
)}
