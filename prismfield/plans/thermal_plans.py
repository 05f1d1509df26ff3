"""Thermal voxels, votes, radiometry, U-values and sol-air chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismfield.functions import radiometry as R
from prismfield.operators import space as S
from prismfield.operators.quantiles import spread_quantiles
from prismfield.sources import adapters as A

from .registry import query

SIZE = 5.0
SOLAR, MAYBE = ["ECONOMY", "STANDARD"], ["PROMO"]
_VOX = "floor(x / 5.0)::BIGINT AS i, floor(y / 5.0)::BIGINT AS j, floor(z / 5.0)::BIGINT AS k"


def thermal_voxels(spark, sf_dir):
    """Mean, population deviation, count and modal material of each voxel, with the material's dimension columns."""
    obs = S.voxelize(A.thermal_obs(spark, sf_dir), SIZE)
    stats = obs.groupBy("i", "j", "k").agg(F.avg("t_c").alias("t_mean_c"), F.stddev_pop("t_c").alias("t_std_c"), F.count("*").alias("n_obs"))
    mode = S.majority(obs, ["i", "j", "k"], "material").select("i", "j", "k", "material")
    # The material table has a fixed handful of rows.
    return stats.join(mode, ["i", "j", "k"]).join(F.broadcast(A.materials(spark)), "material", "left")


VOXEL_CTE = f"""{A.THERMAL_SQL}, {A.MATERIALS_SQL},
obs AS (SELECT *, {_VOX} FROM thermal_obs),
stats AS (SELECT i, j, k, avg(t_c) AS t_mean_c, stddev_pop(t_c) AS t_std_c, count(*) AS n_obs FROM obs GROUP BY i, j, k),
votes AS (SELECT i, j, k, material, count(*) AS w FROM obs GROUP BY i, j, k, material),
mode AS (SELECT i, j, k, arg_min(material, (-w, material)) AS material FROM votes GROUP BY i, j, k),
voxels AS (SELECT s.*, m.material, d.emissivity, d.solar_absorptance, d.zone FROM stats s JOIN mode m USING (i, j, k) LEFT JOIN material_dim d ON d.material = m.material)"""


@query(f"""WITH {VOXEL_CTE}
SELECT i, j, k, material, n_obs, round(t_mean_c, 4) AS t_mean_c, round(t_std_c, 4) AS t_std_c,
  round(8.0 * (29 - t_mean_c) / (29 - 36.9), 4) + 0.0 AS u_value_w_m2k,
  CASE WHEN t_mean_c < 29 OR t_mean_c > 36.9 THEN '0' ELSE '1' END AS plausible,
  CASE WHEN (t_mean_c < 29 OR t_mean_c > 36.9) AND material IN ('ECONOMY', 'STANDARD') THEN 'solar_suspected'
       WHEN (t_mean_c < 29 OR t_mean_c > 36.9) AND material IN ('PROMO') THEN 'solar_possible'
       WHEN t_mean_c < 29 OR t_mean_c > 36.9 THEN 'implausible' ELSE '' END AS flag_reason
FROM voxels""")
def thermal_voxel_u_value(spark, sf_dir):
    v = thermal_voxels(spark, sf_dir)
    t = F.col("t_mean_c")
    return v.select(
        "i", "j", "k", "material", "n_obs", F.round(t, 4).alias("t_mean_c"), F.round("t_std_c", 4).alias("t_std_c"), (F.round(R.u_value(t, 29.0, 36.9, 8.0), 4) + 0.0).alias("u_value_w_m2k"),
        F.when((t < 29) | (t > 36.9), "0").otherwise("1").alias("plausible"), R.quality_flag(t, F.col("material"), 29.0, 36.9, SOLAR, MAYBE).alias("flag_reason"),
    )


@query(f"""WITH {VOXEL_CTE}, c AS (SELECT *, 36.9 + (solar_absorptance * 0.9 * 400.0 - emissivity * 20.0) / 25.0 AS t_sa FROM voxels)
SELECT i, j, k, round(t_sa, 4) AS t_sol_air_c,
  round(CASE WHEN abs(29 - t_sa) < 1e-6 THEN NULL ELSE 8.0 * (29 - t_mean_c) / (29 - t_sa) END, 4) + 0.0 AS u_value_corrected_w_m2k,
  CASE WHEN zone = 'vertical' THEN 'wall' WHEN zone = 'ceiling' THEN 'ceiling' WHEN zone = 'floor' THEN 'floor' ELSE 'other' END AS correction_note
FROM c""")
def sol_air_u_value(spark, sf_dir):
    v = thermal_voxels(spark, sf_dir)
    t_sa = R.sol_air(36.9, F.col("solar_absorptance"), 400.0, 25.0, F.col("emissivity"), 20.0, 0.9)
    note = F.when(F.col("zone") == "vertical", "wall").when(F.col("zone") == "ceiling", "ceiling").when(F.col("zone") == "floor", "floor").otherwise("other")
    return v.select("i", "j", "k", F.round(t_sa, 4).alias("t_sol_air_c"), (F.round(R.u_sol_air(F.col("t_mean_c"), 29.0, t_sa, 8.0), 4) + 0.0).alias("u_value_corrected_w_m2k"), note.alias("correction_note"))


_TAU = """CASE WHEN depth > 0 THEN greatest(least(1.9 * exp(-sqrt(depth) * (0.006569 - 0.002276 * sqrt(om))) + (1 - 1.9) * exp(-sqrt(depth) * (0.01262 - 0.00667 * sqrt(om))), 1.0), 0.0) END"""
_OM = "(0.5 * exp(1.5587 + 6.939e-2 * 20.0 - 2.7816e-4 * 400.0 + 6.8455e-7 * 8000.0))"


@query(f"""WITH {A.THERMAL_SQL}, {A.MATERIALS_SQL},
t AS (SELECT o.*, emissivity, {_TAU.replace('om', _OM)} AS tau FROM thermal_obs o JOIN material_dim USING (material)),
w AS (SELECT *, (pow(t_c + 273.15, 4) - (1 - emissivity) * tau * pow(293.15, 4) - (1 - tau) * pow(293.15, 4)) / nullif(emissivity * tau, 0) AS w_obj FROM t),
c AS (SELECT material, tau, CASE WHEN w_obj > 0 THEN sqrt(sqrt(w_obj)) - 273.15 END AS t_obj FROM w)
SELECT material, count(*) AS n, count(t_obj) AS valid, round(avg(tau), 6) AS mean_tau, round(min(t_obj), 3) AS min_t, round(max(t_obj), 3) AS max_t, round(avg(t_obj), 3) AS mean_t
FROM c GROUP BY material""")
def radiometric_correction(spark, sf_dir):
    o = A.thermal_obs(spark, sf_dir).join(F.broadcast(A.materials(spark)), "material")
    tau = R.transmittance(F.col("depth"), 50.0, 20.0)
    c = o.withColumn("tau", tau).withColumn("t_obj", R.corrected(F.col("t_c"), F.col("emissivity"), F.col("tau"), 20.0, 20.0))
    return c.groupBy("material").agg(
        F.count("*").alias("n"), F.count("t_obj").alias("valid"), F.round(F.avg("tau"), 6).alias("mean_tau"),
        F.round(F.min("t_obj"), 3).alias("min_t"), F.round(F.max("t_obj"), 3).alias("max_t"), F.round(F.avg("t_obj"), 3).alias("mean_t"),
    )


@query(f"""WITH {A.THERMAL_SQL}, obs AS (SELECT *, {_VOX} FROM thermal_obs),
v AS (SELECT i, j, k, material, sum(confidence / greatest(1.0, depth)) AS w FROM obs WHERE confidence >= 0.95 GROUP BY i, j, k, material)
SELECT i, j, k, arg_min(material, (-round(w, 9), material)) AS material, round(max(w) + 1e-10, 5) AS weight, round(max(w) / sum(w) + 1e-10, 5) AS agreement, count(*) AS candidates
FROM v GROUP BY i, j, k""")
def weighted_vote_consensus(spark, sf_dir):
    obs = S.voxelize(A.thermal_obs(spark, sf_dir), SIZE).where(F.col("confidence") >= 0.95)
    m = S.majority(obs, ["i", "j", "k"], "material", F.col("confidence") / F.greatest(F.lit(1.0), F.col("depth")))
    return m.select("i", "j", "k", "material", F.round(F.col("weight") + 1e-10, 5).alias("weight"), F.round(F.col("weight") / F.col("total") + 1e-10, 5).alias("agreement"), F.col("labels").alias("candidates"))


@query(f"""WITH {A.THERMAL_SQL}, obs AS (SELECT *, {_VOX} FROM thermal_obs),
w AS (SELECT i, j, k, material, sum(confidence) AS w FROM obs GROUP BY i, j, k, material),
s AS (SELECT i, j, k, sum(w) AS total FROM w GROUP BY i, j, k),
n AS (SELECT frame, i, j, k, count(*) AS c FROM obs GROUP BY frame, i, j, k),
p AS (SELECT frame, material, sum(c * w / total) AS mass FROM n JOIN w USING (i, j, k) JOIN s USING (i, j, k) GROUP BY frame, material),
b AS (SELECT frame, arg_min(material, (-round(mass, 6), material)) AS material, round(max(mass) / sum(mass), 5) AS agreement FROM p GROUP BY frame)
SELECT frame, material, agreement, CASE WHEN agreement < 0.18 THEN 'below_min_agreement' ELSE 'ok' END AS status FROM b""")
def vote_mass_pooling(spark, sf_dir):
    """Per frame: each voxel shares out its points by its vote shares; the argmax, its share and a status."""
    obs = S.voxelize(A.thermal_obs(spark, sf_dir), SIZE)
    w = obs.groupBy("i", "j", "k", "material").agg(F.sum("confidence").alias("w"))
    s = w.groupBy("i", "j", "k").agg(F.sum("w").alias("total"))
    n = obs.groupBy("frame", "i", "j", "k").agg(F.count("*").alias("c"))
    p = n.join(w, ["i", "j", "k"]).join(s, ["i", "j", "k"]).groupBy("frame", "material").agg(F.sum(F.col("c") * F.col("w") / F.col("total")).alias("mass"))
    b = p.groupBy("frame").agg(F.min(F.struct((-F.round("mass", 6)).alias("n"), "material")).alias("b"), F.round(F.max("mass") / F.sum("mass"), 5).alias("agreement"))
    return b.select("frame", "b.material", "agreement", F.when(F.col("agreement") < 0.18, "below_min_agreement").otherwise("ok").alias("status"))


@query(f"""WITH {VOXEL_CTE}, b AS (SELECT i, j, k, 8.0 * (29 - t_mean_c) / (29 - 36.9) AS u FROM voxels),
q AS (SELECT *, round_even(u / 0.25, 0) * 0.25 + 0.0 AS u_bin FROM b),
r AS (SELECT *, 1 / nullif(u_bin, 0) - 1 / 7.7 - 1 / 25.0 AS raw FROM q)
SELECT i, j, k, u_bin, round(CASE WHEN raw IS NULL OR raw <= 0.001 THEN 0.001 ELSE raw END, 6) AS r_layer, raw IS NULL OR raw <= 0.001 AS unphysical,
  u_bin > 1 / (1 / 7.7 + 1 / 25.0) AS over_ceiling FROM r""")
def construction_binning(spark, sf_dir):
    v = thermal_voxels(spark, sf_dir)
    key, r, bad = R.construction(R.u_value(F.col("t_mean_c"), 29.0, 36.9, 8.0), 0.25, 7.7, 25.0, 0.001)
    return v.select("i", "j", "k", (key + 0.0).alias("u_bin"), F.round(r, 6).alias("r_layer"), F.coalesce(bad, F.lit(True)).alias("unphysical"), (key > R.film_ceiling(7.7, 25.0)).alias("over_ceiling"))


@query(f"""WITH {A.THERMAL_SQL}, p AS (SELECT material, t_c FROM thermal_obs)
SELECT material, round(quantile_cont(t_c, 0.05), 4) AS p05, round(quantile_cont(t_c, 0.1), 4) AS p10, round(quantile_cont(t_c, 0.5), 4) AS p50,
  round(quantile_cont(t_c, 0.95), 4) AS p95, round(quantile_cont(t_c, 0.1) - 20.0, 4) AS offset_c FROM p GROUP BY material""")
def sensor_offset_percentiles(spark, sf_dir):
    """Percentiles of each material and its offset; no task holds a material's temperatures."""
    shares = {"p05": 0.05, "p10": 0.1, "p50": 0.5, "p95": 0.95}
    q = spread_quantiles(A.thermal_obs(spark, sf_dir), ["material"], "t_c", shares)
    return q.select("material", *(F.round(n, 4).alias(n) for n in shares), F.round(F.col("p10") - 20.0, 4).alias("offset_c"))


@query(f"""WITH {A.THERMAL_SQL}, {A.MATERIALS_SQL},
ranked AS (SELECT frame, material, sum(confidence) AS s FROM thermal_obs GROUP BY frame, material),
z AS (SELECT frame, CASE WHEN frame % 3 = 0 THEN 'vertical' WHEN frame % 3 = 1 THEN 'floor' ELSE 'nowhere' END AS zone FROM (SELECT DISTINCT frame FROM thermal_obs)),
k AS (SELECT r.frame, r.material, s, d.zone = z.zone AS ok FROM ranked r JOIN z USING (frame) JOIN material_dim d ON d.material = r.material),
e AS (SELECT *, bool_or(ok) OVER (PARTITION BY frame) AS has FROM k),
f AS (SELECT frame, material, s FROM e WHERE ok OR NOT has)
SELECT frame, material, round(s / sum(s) OVER (PARTITION BY frame), 6) AS prob FROM f""")
def zone_restricted_ranking(spark, sf_dir):
    """Candidates that the frame's zone allows, renormalised; all of them where the zone allows none."""
    from pyspark.sql import Window

    r = A.thermal_obs(spark, sf_dir).groupBy("frame", "material").agg(F.sum("confidence").alias("s"))
    zone = F.when(F.col("frame") % 3 == 0, "vertical").when(F.col("frame") % 3 == 1, "floor").otherwise("nowhere")
    w = Window.partitionBy("frame")
    k = r.join(F.broadcast(A.materials(spark)), "material").withColumn("ok", F.col("zone") == zone)
    k = k.withColumn("has", F.max(F.col("ok").cast("int")).over(w) == 1).where(F.col("ok") | ~F.col("has"))
    return k.select("frame", "material", F.round(F.col("s") / F.sum("s").over(w), 6).alias("prob"))


@query(f"""WITH {A.THERMAL_SQL}, {A.MATERIALS_SQL},
r AS (SELECT frame, material, sum(confidence) AS s FROM thermal_obs GROUP BY frame, material),
p AS (SELECT frame, material, s / sum(s) OVER (PARTITION BY frame) AS conf FROM r),
q AS (SELECT p.*, emissivity, row_number() OVER (PARTITION BY frame ORDER BY round(conf, 9) DESC, material) AS rk, lead(conf, 1, 0) OVER (PARTITION BY frame ORDER BY round(conf, 9) DESC, material) AS nxt FROM p JOIN material_dim USING (material)),
t AS (SELECT frame, material AS top, conf, conf - nxt AS margin, emissivity AS eps FROM q WHERE rk = 1),
alt AS (SELECT frame, arg_min(material, rk) AS other FROM q WHERE rk > 1 AND emissivity >= 0.5 GROUP BY frame)
SELECT t.frame, CASE WHEN eps >= 0.5 OR (conf >= 0.25 AND margin >= 0.15) THEN top ELSE coalesce(other, top) END AS material,
  CASE WHEN eps >= 0.5 OR (conf >= 0.25 AND margin >= 0.15) OR other IS NULL THEN NULL ELSE top END AS overrode
FROM t LEFT JOIN alt USING (frame)""")
def low_emissivity_gate(spark, sf_dir):
    """A weak call of a low-emissivity material gives way to the best candidate above the threshold; audited."""
    r = A.thermal_obs(spark, sf_dir).groupBy("frame", "material").agg(F.sum("confidence").alias("s")).join(F.broadcast(A.materials(spark)), "material")
    per = r.groupBy("frame").agg(F.sum("s").alias("total"), F.collect_list(F.struct("s", "material", "emissivity")).alias("c"))
    ranked = F.array_sort(F.transform("c", lambda x: F.struct((-F.round(x["s"] / F.col("total"), 9)).alias("n"), x["material"].alias("material"), (x["s"] / F.col("total")).alias("conf"), x["emissivity"].alias("eps"))))
    p = per.select("frame", ranked.alias("r"))
    top, rest = F.col("r")[0], F.slice("r", F.lit(2), F.size("r"))
    margin = top["conf"] - F.coalesce(F.get("r", F.lit(1))["conf"], F.lit(0.0))
    strong = (top["eps"] >= 0.5) | ((top["conf"] >= 0.25) & (margin >= 0.15))
    other = F.get(F.filter(rest, lambda x: x["eps"] >= 0.5), F.lit(0))["material"]
    return p.select("frame", F.when(strong, top["material"]).otherwise(F.coalesce(other, top["material"])).alias("material"), F.when(~strong & other.isNotNull(), top["material"]).alias("overrode"))


@query(f"""WITH {A.THERMAL_SQL}, {A.MATERIALS_SQL},
c AS (SELECT o.frame, d.material, avg(CASE WHEN 20 + (t_c - 20) / d.emissivity BETWEEN 0 AND 40 THEN 1.0 ELSE 0.0 END) AS share, any_value(d.emissivity) AS eps FROM thermal_obs o CROSS JOIN material_dim d GROUP BY o.frame, d.material),
g AS (SELECT frame, arg_min(material, (CASE WHEN eps >= 0.5 THEN 0 ELSE 1 END, material)) AS accepted, count(*) AS passing FROM c WHERE share >= 0.99 GROUP BY frame)
SELECT f.frame, accepted, coalesce(passing, 0) AS passing FROM (SELECT DISTINCT frame FROM thermal_obs) f LEFT JOIN g USING (frame)""")
def candidate_retry(spark, sf_dir):
    """First candidate material that leaves at least 99 % of a frame's pixels in range; null if none does."""
    o = A.thermal_obs(spark, sf_dir)
    # Pixels meet the fixed list of candidates through a pivoted aggregation: no row is copied.
    aggs = [F.avg(F.when((20 + (F.col("t_c") - 20) / e).between(0, 40), 1.0).otherwise(0.0)).alias(m) for m, e, _, _ in A.MATERIALS]
    shares = o.groupBy("frame").agg(*aggs)
    order = sorted(A.MATERIALS, key=lambda m: (m[1] < 0.5, m[0]))
    return shares.select("frame", F.coalesce(*(F.when(F.col(m[0]) >= 0.99, m[0]) for m in order)).alias("accepted"), sum((F.when(F.col(m[0]) >= 0.99, 1).otherwise(0) for m in order), F.lit(0)).cast("long").alias("passing"))
