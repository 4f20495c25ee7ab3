"""Queries of the dataset statistics and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.functions.scalars import flag, number
from blockloom.operators import stats
from blockloom.session import table

NODES, BLOCKS, EDGES, BRANCHES = "nodes_fixed", "blocks", "edges", "branches"


def _t(*names: str):
    return lambda spark, d: [table(spark, d, n) for n in names]


def row_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.row_counts(dict(zip(("blocks", "branches", "nodes", "edges"), _t(BLOCKS, BRANCHES, NODES, EDGES)(spark, d))))


def occupancy_by_block(spark: SparkSession, d: str) -> DataFrame:
    return stats.occupancy(table(spark, d, NODES))


def occupancy_profile(spark: SparkSession, d: str) -> DataFrame:
    return stats.distribution(stats.occupancy(table(spark, d, NODES)), "occupancy")


def edges_per_block(spark: SparkSession, d: str) -> DataFrame:
    return stats.edges_per_block(*_t(BLOCKS, EDGES)(spark, d))


def scale_profile(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, BLOCKS).agg(F.avg(number(F.col("scale_l"), 0)).alias("mean"), F.stddev_pop(number(F.col("scale_l"), 0)).alias("std"))


def zone_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, BLOCKS).groupBy(F.coalesce("zone", F.lit("nan")).alias("zone")).agg(F.count(F.lit(1)).alias("n"))


def zone_rollup(spark: SparkSession, d: str) -> DataFrame:
    return stats.zone_rollup(*_t(NODES, BLOCKS)(spark, d))


def shape_histogram(spark: SparkSession, d: str) -> DataFrame:
    return stats.shape_histogram(table(spark, d, NODES))


def geometry_moments(spark: SparkSession, d: str) -> DataFrame:
    return stats.moments(table(spark, d, NODES))


def floors_top(spark: SparkSession, d: str) -> DataFrame:
    return stats.top_values(table(spark, d, NODES).filter(stats.valid_floors()), "floors_num")


def floors_share(spark: SparkSession, d: str) -> DataFrame:
    e = stats.active()
    return table(spark, d, NODES).agg(
        (F.count_if(stats.valid_floors()) / F.greatest(F.count_if(e), F.lit(1))).alias("share"), F.avg(F.when(stats.valid_floors(), F.col("floors_num"))).alias("mean")
    )


def services_long(spark: SparkSession, d: str) -> DataFrame:
    return stats.services_long(table(spark, d, NODES), ["block_id", "slot_id"]).filter("has").select("block_id", "slot_id", "service", "capacity")


def service_totals(spark: SparkSession, d: str) -> DataFrame:
    return stats.service_totals(table(spark, d, NODES))


def service_summary(spark: SparkSession, d: str) -> DataFrame:
    return stats.service_totals(table(spark, d, NODES), only_active=False)


def service_blocks(spark: SparkSession, d: str) -> DataFrame:
    return stats.blocks_with_services(table(spark, d, NODES))


def train_val_split(spark: SparkSession, d: str) -> DataFrame:
    return stats.split_ids(table(spark, d, BLOCKS), 0.8)


def split_rows(spark: SparkSession, d: str) -> DataFrame:
    ids = stats.split_ids(table(spark, d, BLOCKS), 0.8).filter("split = 'train'")
    return table(spark, d, NODES).join(ids, "block_id", "left_semi").agg(F.count(F.lit(1)).alias("n"), F.count_if(stats.active()).alias("n_active"))


def unused_blocks(spark: SparkSession, d: str) -> DataFrame:
    blocks, nodes = _t(BLOCKS, NODES)(spark, d)
    return blocks.select("block_id").filter("block_id is not null").distinct().join(nodes, "block_id", "left_anti")


def block_profile(spark: SparkSession, d: str) -> DataFrame:
    return stats.block_profile(*_t(BLOCKS, NODES)(spark, d))


def label_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return stats.label_frequencies(table(spark, d, NODES))


def label_weights(spark: SparkSession, d: str) -> DataFrame:
    return stats.label_weights(table(spark, d, NODES))


def block_totals(spark: SparkSession, d: str) -> DataFrame:
    return stats.block_totals(table(spark, d, NODES))


def zone_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return stats.vocabulary(table(spark, d, BLOCKS), "zone")


def area_quantiles(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, NODES).filter(stats.active() & flag(F.col("is_living"))).select(number(F.col("living_area"), 0).alias("v"))
    return rows.agg(F.percentile("v", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q")).select(*[F.col("q")[k].alias(n) for k, n in enumerate(("p10", "p50", "p90"))])


def quantile_bins(spark: SparkSession, d: str) -> DataFrame:
    return stats.quantile_bins(table(spark, d, "orders"), "o_orderkey", "o_totalprice", 4)


def zone_temperature(spark: SparkSession, d: str) -> DataFrame:
    return stats.temperature_weights(table(spark, d, BLOCKS), 0.5)


def stats_report(spark: SparkSession, d: str) -> DataFrame:
    return stats.report(*_t(BLOCKS, NODES, EDGES, BRANCHES)(spark, d))


QUERIES = {f.__name__: f for f in (
    row_counts, occupancy_by_block, occupancy_profile, edges_per_block, scale_profile, zone_counts, zone_rollup, shape_histogram, geometry_moments,
    floors_top, floors_share, services_long, service_totals, service_summary, service_blocks, train_val_split, split_rows, unused_blocks, block_profile,
    label_frequencies, label_weights, block_totals, zone_vocabulary, area_quantiles, quantile_bins, zone_temperature, stats_report,
)}

_N = """n AS (
  SELECT *, coalesce(e_i, 0) > 0.5 AS a, coalesce(is_living, false) AS il, coalesce(has_floors, false) AS hf,
         CASE WHEN living_area IS NULL OR isnan(living_area) THEN 0.0 ELSE living_area END AS la,
         coalesce(e_i, 0) > 0.5 AND coalesce(has_floors, false) AND coalesce(floors_num, -1) >= 0 AS vf
  FROM nodes_fixed
)"""
_Z = "z AS (SELECT block_id, coalesce(arg_max({'z': zone}, (loaded_at, zone)).z, 'nan') AS zone FROM blocks WHERE block_id IS NOT NULL GROUP BY block_id)"
_M = ("posx", "posy", "size_x", "size_y", "phi_resid")
_S = ("kindergarten", "polyclinic", "school")
_LONG = "s AS (" + " UNION ALL ".join(
    f"SELECT block_id, slot_id, '{s}' AS service, a, coalesce(has_service__{s}, false) AS has, "
    f"CASE WHEN service_capacity__{s} IS NULL OR isnan(service_capacity__{s}) THEN 0.0 ELSE service_capacity__{s} END AS capacity FROM n" for s in _S
) + ")"
_OCC = "o AS (SELECT block_id, count(*) AS n_slots, count(*) FILTER (a) AS n_active, count(*) FILTER (a) / count(*) AS occupancy FROM n GROUP BY block_id)"
_ROLL = """r AS (
  SELECT coalesce(zone, 'nan') AS zone, count(*) FILTER (a) AS active_nodes, count(*) FILTER (a AND il) / (count(*) FILTER (a) + 1e-6) AS living_share,
         avg(floors_num) FILTER (vf) AS floors_mean, coalesce(sum(la) FILTER (a AND il), 0.0) AS living_area_sum
  FROM n LEFT JOIN z USING (block_id) GROUP BY ALL
)"""
_SHAPE = "SELECT CASE s_i WHEN 0 THEN 'Rect' WHEN 1 THEN 'L' WHEN 2 THEN 'U' WHEN 3 THEN 'X' ELSE 'unknown' END AS shape, count(*) AS n FROM n WHERE a GROUP BY ALL"
_MOM = " UNION ALL ".join(
    f"SELECT '{c}' AS name, avg({c}) AS mean, stddev_pop({c}) AS std, min({c}) AS min, max({c}) AS max FROM n WHERE a AND NOT coalesce(isnan({c}), false)" for c in _M
)
_TOP = "SELECT floors_num, count(*) AS n FROM n WHERE vf GROUP BY ALL ORDER BY n DESC, floors_num LIMIT 20"
_SCALE = "SELECT avg(v) AS mean, stddev_pop(v) AS std FROM (SELECT CASE WHEN scale_l IS NULL OR isnan(scale_l) THEN 0.0 ELSE scale_l END AS v FROM blocks)"
_EDGES = "SELECT avg(coalesce(c, 0)) AS mean_edges, count(*) AS n_blocks FROM (SELECT DISTINCT block_id FROM blocks) LEFT JOIN (SELECT block_id, count(*) AS c FROM edges GROUP BY ALL) USING (block_id)"
_COUNTS = " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {t}" for n, t in (("blocks", BLOCKS), ("branches", BRANCHES), ("nodes", NODES), ("edges", EDGES)))
_SPLIT = """SELECT block_id, CASE WHEN k <= round_even(n * 0.8, 0) THEN 'train' ELSE 'val' END AS split
FROM (SELECT block_id, row_number() OVER (ORDER BY block_id) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT block_id FROM blocks WHERE block_id IS NOT NULL))"""
_FREQ = """SELECT avg(CASE WHEN a THEN 1.0::DOUBLE ELSE 0.0 END) AS p_e, avg(CASE WHEN il THEN 1.0::DOUBLE ELSE 0.0 END) FILTER (a) AS p_living,
avg(CASE WHEN hf THEN 1.0::DOUBLE ELSE 0.0 END) FILTER (a) AS p_floors, """ + ", ".join(
    f"greatest(count(*) FILTER (a AND s_i = {k}), 1) AS n_shape_{k}" for k in range(4)
) + " FROM n"
_PROFILE = (
    "SELECT b.block_id, floors_mean, coalesce(occupancy, 0) AS occupancy, coalesce(living_share, 0) AS living_share, "
    + ", ".join(f"coalesce({c}_mean, 0) AS {c}_mean, coalesce({c}_std, 0) AS {c}_std" for c in _M)
    + " FROM (SELECT DISTINCT block_id FROM blocks WHERE block_id IS NOT NULL) b LEFT JOIN (SELECT block_id, count(*) FILTER (a) / count(*) AS occupancy, "
    + "count(*) FILTER (a AND il) / greatest(count(*) FILTER (a), 1) AS living_share, avg(floors_num) FILTER (vf) AS floors_mean, "
    + ", ".join(f"avg({c}) FILTER (a AND NOT coalesce(isnan({c}), false)) AS {c}_mean, stddev_pop({c}) FILTER (a AND NOT coalesce(isnan({c}), false)) AS {c}_std" for c in _M)
    + " FROM n GROUP BY block_id) p USING (block_id)"
)
_TOTALS = (
    "SELECT block_id, coalesce(sum(la) FILTER (a), 0.0) AS living_area, avg(floors_num) FILTER (vf) AS floors_mean, "
    + ", ".join(
        f"sum(CASE WHEN a AND coalesce(has_service__{s}, false) AND NOT coalesce(isnan(service_capacity__{s}), false) THEN coalesce(service_capacity__{s}, 0.0) ELSE 0.0::DOUBLE END) AS capacity_{s}, "
        f"max(CASE WHEN a AND coalesce(has_service__{s}, false) THEN 1.0::DOUBLE ELSE 0.0 END) AS present_{s}" for s in _S
    )
    + " FROM n GROUP BY block_id"
)


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


def _unpivot(section: str, name: str, metrics: tuple[str, ...], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{section}' AS section, {name} AS name, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM ({source})" for m in metrics)


SQL = {
    "row_counts": _COUNTS,
    "occupancy_by_block": _with(_N, _OCC) + "SELECT * FROM o",
    "occupancy_profile": _with(_N, _OCC) + "SELECT avg(occupancy) AS mean, stddev_pop(occupancy) AS std, quantile_cont(occupancy, 0.25) AS p25, quantile_cont(occupancy, 0.5) AS p50, quantile_cont(occupancy, 0.75) AS p75 FROM o",
    "edges_per_block": _EDGES,
    "scale_profile": _SCALE,
    "zone_counts": "SELECT coalesce(zone, 'nan') AS zone, count(*) AS n FROM blocks GROUP BY ALL",
    "zone_rollup": _with(_N, _Z, _ROLL) + "SELECT * FROM r",
    "shape_histogram": _with(_N) + _SHAPE,
    "geometry_moments": _with(_N) + _MOM,
    "floors_top": _with(_N) + _TOP,
    "floors_share": _with(_N) + "SELECT count(*) FILTER (vf) / greatest(count(*) FILTER (a), 1) AS share, avg(floors_num) FILTER (vf) AS mean FROM n",
    "services_long": _with(_N, _LONG) + "SELECT block_id, slot_id, service, capacity FROM s WHERE has",
    "service_totals": _with(_N, _LONG) + "SELECT service, count(*) AS n, sum(capacity) AS capacity FROM s WHERE has AND a GROUP BY ALL",
    "service_summary": _with(_N, _LONG) + "SELECT service, count(*) AS n, sum(capacity) AS capacity FROM s WHERE has GROUP BY ALL",
    "service_blocks": _with(_N, _LONG) + "SELECT block_id, bool_or(has OR capacity > 0) AS any_service FROM s GROUP BY ALL",
    "train_val_split": _SPLIT,
    "split_rows": _with(_N) + f"SELECT count(*) AS n, count(*) FILTER (a) AS n_active FROM n WHERE block_id IN (SELECT block_id FROM ({_SPLIT}) WHERE split = 'train')",
    "unused_blocks": "SELECT DISTINCT block_id FROM blocks WHERE block_id IS NOT NULL AND block_id NOT IN (SELECT block_id FROM nodes_fixed WHERE block_id IS NOT NULL)",
    "block_profile": _with(_N) + _PROFILE,
    "label_frequencies": _with(_N) + _FREQ,
    "label_weights": _with(_N, f"f AS ({_FREQ})") + "SELECT " + ", ".join(
        f"(1 - greatest(1e-6, least(0.999999, p_{c}))) / greatest(1e-6, least(0.999999, p_{c})) AS w_{c}" for c in ("e", "living", "floors")
    ) + ", " + ", ".join(f"(1.0::DOUBLE / n_shape_{k}) / ((1.0::DOUBLE / n_shape_0 + 1.0::DOUBLE / n_shape_1 + 1.0::DOUBLE / n_shape_2 + 1.0::DOUBLE / n_shape_3) / 4) AS w_shape_{k}" for k in range(4)) + " FROM f",
    "block_totals": _with(_N) + _TOTALS,
    "zone_vocabulary": "SELECT zone AS value, row_number() OVER (ORDER BY zone) - 1 AS id FROM (SELECT DISTINCT zone FROM blocks WHERE zone IS NOT NULL)",
    "area_quantiles": _with(_N) + "SELECT quantile_cont(la, 0.1) AS p10, quantile_cont(la, 0.5) AS p50, quantile_cont(la, 0.9) AS p90 FROM n WHERE a AND il",
    "quantile_bins": "WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b, quantile_cont(o_totalprice, 0.75) AS c FROM orders) "
                     "SELECT o_orderkey, o_totalprice AS value, (a < o_totalprice)::INTEGER + (b < o_totalprice)::INTEGER + (c < o_totalprice)::INTEGER AS bin FROM orders, q",
    "zone_temperature": _with(_Z, "c AS (SELECT zone, count(*) AS n FROM z GROUP BY ALL)", "w AS (SELECT zone, n, pow(n / (SELECT sum(n) FROM c), 0.5) AS w FROM c)")
                        + "SELECT block_id, zone, w / (SELECT sum(n * w) FROM w) AS weight FROM z JOIN w USING (zone)",
}
SQL["stats_report"] = _with(_N, _Z, _LONG, _OCC, _ROLL) + " UNION ALL ".join([
    _unpivot("global", "name", ("n",), _COUNTS),
    _unpivot("global", "'occupancy'", ("mean", "std", "p25", "p50", "p75"), SQL["occupancy_profile"].split("SELECT avg(occupancy)")[1].join(["SELECT avg(occupancy)", ""])),
    _unpivot("global", "'edges_per_block'", ("mean_edges",), _EDGES),
    _unpivot("global", "'scale_l'", ("mean", "std"), _SCALE),
    _unpivot("zones", "zone", ("blocks",), "SELECT coalesce(zone, 'nan') AS zone, count(*) AS blocks FROM blocks GROUP BY ALL"),
    _unpivot("zones", "zone", ("active_nodes", "living_share", "floors_mean", "living_area_sum"), "SELECT * FROM r"),
    _unpivot("shapes", "shape", ("n",), _SHAPE),
    _unpivot("geom", "name", ("mean", "std", "min", "max"), _MOM),
    _unpivot("floors", "CAST(floors_num AS VARCHAR)", ("n",), _TOP),
    _unpivot("services", "service", ("n", "capacity"), "SELECT service, count(*) AS n, sum(capacity) AS capacity FROM s WHERE has AND a GROUP BY ALL"),
])


DOUBLES = {
    "occupancy_by_block": "occupancy", "occupancy_profile": "mean std p25 p50 p75", "edges_per_block": "mean_edges", "scale_profile": "mean std",
    "zone_rollup": "living_share floors_mean living_area_sum", "geometry_moments": "mean std min max", "floors_share": "share mean",
    "services_long": "capacity", "service_totals": "capacity", "service_summary": "capacity",
    "block_profile": "floors_mean occupancy living_share " + " ".join(f"{c}_mean {c}_std" for c in _M), "label_frequencies": "p_e p_living p_floors",
    "label_weights": "w_e w_living w_floors w_shape_0 w_shape_1 w_shape_2 w_shape_3", "area_quantiles": "p10 p50 p90", "quantile_bins": "value",
    "block_totals": "living_area floors_mean " + " ".join(f"capacity_{s} present_{s}" for s in _S), "zone_temperature": "weight", "stats_report": "value",
}
