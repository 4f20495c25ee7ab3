"""Queries of the scalar, ordered and graph operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.functions import scalars as S
from blockloom.operators import graph, ordered, stats
from blockloom.session import table

SLOTS, K = 24, 6
# parameter documents of the examples
SYNONYMS = (("school", "school"), ("kindergarten", "kindergarten"), ("polyclinic", "polyclinic"), ("clinic", "polyclinic"), ("больниц", "hospital"), ("школ", "school"), ("сад", "kindergarten"), ("поликлиник", "polyclinic"))
TARGETS = '{"residential": {"la": "20000", "floors": "9"}, "business": {"living_area": 0, "floors_avg": 15}, "industrial": {"la_target": "x", "floors": 5}}'
WANTED = '[{"name": "school", "value": 1100}, {"name": "kindergarten", "value": 0}, {"name": "pool", "value": 30}, {"name": "polyclinic", "value": "250"}]'


def slots(spark: SparkSession, d: str) -> DataFrame:
    """The latest row of each active slot on a branch."""
    nodes = table(spark, d, "nodes_fixed").filter("block_id is not null and slot_id is not null")
    cells = ["branch_local_id", "posx", "posy", "size_x", "size_y", "phi_resid", "s_i", "a_i", "floors_num", "living_area", "is_living", "has_floors", "building_id", "e_i"]
    latest = nodes.groupBy("block_id", "slot_id").agg(F.max_by(F.struct(*cells), "loaded_at").alias("r")).select("block_id", "slot_id", "r.*")
    return latest.filter(stats.active() & (F.col("branch_local_id") >= 0))


def links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "edges").filter("block_id is not null and src_slot is not null and dst_slot is not null").select("block_id", "src_slot", "dst_slot").distinct()


def chain_edges(spark, d):
    return ordered.chain_edges(slots(spark, d))


def rank_edges(spark, d):
    return ordered.rank_edges(slots(spark, d))


def even_subsample(spark, d):
    return ordered.even_subsample(slots(spark, d), ["block_id"], ["posx", "slot_id"], 5).select("block_id", "slot_id", "posx")


def slot_numbers(spark, d):
    rows = slots(spark, d).select("block_id", F.col("slot_id").alias("old_slot"), "branch_local_id", "posx")
    return ordered.number_slots(rows, ["branch_local_id", "posx", "old_slot"], 12).select("block_id", "old_slot", "slot_id")


def padded_slots(spark, d):
    nodes = slots(spark, d).select("block_id", "slot_id", "e_i", "branch_local_id", "posx", "is_living", "building_id")
    empty = {"e_i": F.lit(0), "branch_local_id": F.lit(-1), "posx": F.lit(0.0), "is_living": F.lit(False), "building_id": F.lit(None)}
    return ordered.pad_slots(nodes, table(spark, d, "blocks").filter("block_id is not null"), SLOTS, empty)


def branch_cuts(spark, d):
    rows = table(spark, d, "branches").filter("block_id is not null").groupBy("block_id", F.col("branch_local_id").alias("segment")).agg(F.max_by("length", "loaded_at").alias("length"))
    rows = rows.withColumn("length", F.greatest(S.number(F.col("length"), 0), F.lit(0.0)))
    return ordered.relative_cuts(rows, ["block_id"], "segment", "length")


def segment_lookup(spark, d):
    cuts = branch_cuts(spark, d)
    points = cuts.select("block_id").distinct().withColumn("s", F.explode(F.array(*[F.lit(v) for v in (0.0, 0.3, 0.7, 1.0)])))
    return ordered.segment_at(cuts, points, ["block_id"], "s").groupBy("block_id", "s").agg(F.min("segment").alias("segment"))


def max_run_rows(spark, d):
    cells = table(spark, d, "events").filter("event_type <> 'error'").select("event_id", F.expr("event_id div 40").alias("row_i"), (F.col("event_id") % 40).alias("col_j"))
    return ordered.run_mask(cells, ["row_i"], "col_j")


def repeats_dropped(spark, d):
    rows = ordered.drop_repeats(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", ["event_type"])
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def latest_blocks(spark, d):
    return ordered.keep_first(table(spark, d, "blocks").filter("block_id is not null"), ["block_id"], [F.desc("loaded_at"), F.desc("load_id")]).select("block_id", "load_id", "n_buildings")


def knn_slots(spark, d):
    return graph.knn_near(slots(spark, d), ["block_id"], "slot_id", "posx", "posy", K).select("block_id", "src", "dst", "rank", "d2")


def knn_points(spark, d):
    points = table(spark, d, "part").select("p_brand", "p_partkey", (F.col("p_partkey") % 97).cast("double").alias("x"), F.col("p_size").cast("double").alias("y"))
    return graph.knn_near(points, ["p_brand"], "p_partkey", "x", "y", 4).select("p_brand", "src", "dst", "rank", "d2")


def knn_embeddings(spark, d):
    """The three nearest vectors of the same label for every 50th vector, against all rows."""
    rows = table(spark, d, "embeddings").select("label", "vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    ask = rows.filter("vec_id % 50 = 0").select("label", F.col("vec_id").alias("src"), F.col("v").alias("q"))
    d2 = F.aggregate(F.zip_with("q", "v", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    near = rows.join(F.broadcast(ask), "label").filter("src <> vec_id").withColumn("d2", d2)
    best = near.groupBy("src").agg(F.slice(F.array_sort(F.collect_list(F.struct("d2", F.col("vec_id").alias("dst")))), 1, 3).alias("b"))
    return best.select("src", F.posexplode("b").alias("k", "b")).select("src", "b.dst", (F.col("k") + 1).alias("rank"), "b.d2")


def knn_enrich(spark, d):
    near = knn_slots(spark, d)
    return graph.enrich_edges(links(spark, d), near)


def slot_components(spark, d):
    name = lambda c: F.concat_ws(":", "block_id", F.lpad(F.col(c).cast("string"), 6, "0"))
    return graph.connected_components(links(spark, d).select(name("src_slot").alias("a"), name("dst_slot").alias("b")))


def neighbour_means(spark, d):
    return graph.neighbour_mean(slots(spark, d), links(spark, d), ["posx", "size_x"])


def axial_means(spark, d):
    """Circular mean of period pi of the active angles of a block."""
    a = F.col("phi_resid")
    return slots(spark, d).groupBy("block_id").agg(F.avg(F.sin(2 * a)).alias("s"), F.avg(F.cos(2 * a)).alias("c")).select("block_id", (0.5 * F.atan2("s", "c")).alias("angle"))


def top_areas(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("s_i").orderBy(F.desc("a"), "block_id", "slot_id")
    rows = slots(spark, d).withColumn("a", S.number(F.col("a_i"), 0)).withColumn("k", F.row_number().over(order)).filter("k <= 5")
    return rows.select("s_i", "k", "block_id", "slot_id", "a")


def service_slugs(spark, d):
    return table(spark, d, "services").filter("service_type_name is not null").groupBy(S.slug(F.col("service_type_name")).alias("slug")).agg(F.count(F.lit(1)).alias("n"))


def service_capacities(spark, d):
    c = S.capacity(F.col("capacity"), F.col("capacity_modeled"), F.col("weight_value"))
    return table(spark, d, "services").select("service_id", c.alias("capacity")).distinct()


def lenient_numbers(spark, d):
    return table(spark, d, "buildings").groupBy(S.lenient_number(F.col("floors_num")).alias("v")).agg(F.count(F.lit(1)).alias("n"))


def synonym_match(spark, d):
    """Each service type name with the service it means: the first synonym it contains, equal before contained."""
    rows = table(spark, d, "services").filter("service_type_name is not null").select("service_type_name").distinct()
    low = F.lower(F.trim("service_type_name"))
    exact = [F.when(low == s, t) for s, t in SYNONYMS]
    part = [F.when(low.contains(s), t) for s, t in SYNONYMS]
    return rows.select("service_type_name", F.coalesce(*exact, *part).alias("service"))


def zone_targets(spark, d):
    doc = spark.range(1).select(F.explode(F.from_json(F.lit(TARGETS), "map<string,map<string,string>>")).alias("zone", "m"))
    pick = lambda *names: F.coalesce(*[S.number(F.col("m")[n]) for n in names])
    return doc.select("zone", pick("la", "living_area", "la_target").alias("living_area"), pick("floors_avg", "floors").alias("floors"))


def service_targets(spark, d):
    doc = spark.range(1).select(F.explode(F.from_json(F.lit(WANTED), "array<struct<name:string,value:string>>")).alias("t"))
    return doc.select("t.name", S.number(F.col("t.value")).alias("value")).filter(F.col("name").isin("school", "kindergarten", "polyclinic") & (F.col("value") > 0))


def target_codes(spark, d):
    area, scale = S.number(F.col("living_area"), 0), F.lit(100.0)
    code = S.encode_area(F.greatest(area, F.lit(0.0)), scale)
    return slots(spark, d).select("block_id", "slot_id", code.alias("code"), S.decode_area(code, scale).alias("area"))


def position_codes(spark, d):
    rows = slots(spark, d).select("block_id", "slot_id", F.posexplode(S.position_code(F.col("posx"), F.col("posy"))).alias("k", "v"))
    return rows.groupBy("k").agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("n"))


def class_scores(spark, d):
    x = F.col("posx")
    return slots(spark, d).select(
        "block_id", "slot_id", S.sigmoid(x).alias("p"), S.softplus(x).alias("soft"), S.wrapped(F.col("phi_resid") * 400).alias("turn"), F.array_join(S.one_hot(F.col("s_i"), 4), "").alias("hot")
    )


def rectangle_shapes(spark, d):
    n = spark.range(1, 41).select(F.col("id").alias("n"))
    return n.select("n", F.posexplode(S.rectangles(F.col("n"))).alias("k", "s")).select("n", "k", "s.r", "s.c", "s.waste")


def padded_names(spark, d):
    return table(spark, d, "nation").select(S.padded("C", F.col("n_nationkey"), 6).alias("name"), S.epsg(F.lit(" 3857")).alias("crs"), S.property_key(F.concat(F.lit("-"), "n_name", F.lit(" x/"))).alias("key"))


QUERIES = {f.__name__: f for f in (
    chain_edges, rank_edges, even_subsample, slot_numbers, padded_slots, branch_cuts, segment_lookup, max_run_rows, repeats_dropped, latest_blocks,
    knn_slots, knn_points, knn_embeddings, knn_enrich, slot_components, neighbour_means, axial_means, top_areas, service_slugs, service_capacities,
    lenient_numbers, synonym_match, zone_targets, service_targets, target_codes, position_codes, class_scores, rectangle_shapes, padded_names,
)}
DOUBLES = {
    "branch_cuts": "length start stop", "knn_slots": "d2", "knn_points": "d2", "knn_embeddings": "d2", "neighbour_means": "mean_posx mean_size_x", "axial_means": "angle",
    "top_areas": "a", "service_capacities": "capacity", "target_codes": "code area", "position_codes": "total", "class_scores": "p soft turn", "padded_slots": "posx",
}

_C = """c AS (
  SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY block_id, slot_id ORDER BY loaded_at DESC) AS rn FROM nodes_fixed WHERE block_id IS NOT NULL AND slot_id IS NOT NULL)
  WHERE rn = 1 AND coalesce(e_i, 0) > 0.5 AND branch_local_id >= 0
)"""
_L = "l AS (SELECT DISTINCT block_id, src_slot, dst_slot FROM edges WHERE block_id IS NOT NULL AND src_slot IS NOT NULL AND dst_slot IS NOT NULL)"
_BOTH = "SELECT block_id, a AS src_slot, b AS dst_slot FROM p UNION ALL SELECT block_id, b, a FROM p"
_KNN = """k AS (
  SELECT a.block_id, a.slot_id AS src, b.slot_id AS dst, (a.posx - b.posx) * (a.posx - b.posx) + (a.posy - b.posy) * (a.posy - b.posy) AS d2
  FROM c a JOIN c b ON a.block_id = b.block_id AND a.slot_id <> b.slot_id
), kn AS (SELECT block_id, src, dst, rank, d2 FROM (SELECT *, row_number() OVER (PARTITION BY block_id, src ORDER BY d2, dst) AS rank FROM k) WHERE rank <= 6)"""
_CUTS = """b AS (
  SELECT block_id, segment, CASE WHEN length IS NULL OR isnan(length) OR length < 0 THEN 0.0 ELSE length END AS length
  FROM (SELECT block_id, branch_local_id AS segment, arg_max(length, loaded_at) AS length FROM branches WHERE block_id IS NOT NULL GROUP BY ALL)
), u AS (SELECT *, sum(length) OVER (PARTITION BY block_id) AS total, sum(length) OVER (PARTITION BY block_id ORDER BY segment) AS upto FROM b),
cuts AS (SELECT block_id, segment, length, CASE WHEN total > 0 THEN (upto - length) / total ELSE 0 END AS start, CASE WHEN total > 0 THEN upto / total ELSE 1 END AS stop FROM u)"""
_SLUG = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(replace(replace(replace(replace(replace(trim(service_type_name), 'й', 'и_'), 'ё', 'е_'), 'Й', 'и_'), 'Ё', 'е_'), chr(160), ' ')), '[\s/\\]+', '_', 'g'), '[^0-9a-zа-яё_]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g')"""
_SYN = " ".join(f"WHEN lower(trim(service_type_name)) = '{s}' THEN '{t}'" for s, t in SYNONYMS) + " " + " ".join(f"WHEN contains(lower(trim(service_type_name)), '{s}') THEN '{t}'" for s, t in SYNONYMS)

SQL = {
    "chain_edges": f"WITH {_C}, p AS (SELECT * FROM (SELECT block_id, slot_id AS a, lead(slot_id) OVER (PARTITION BY block_id, branch_local_id ORDER BY posx, slot_id) AS b FROM c) WHERE b IS NOT NULL) {_BOTH}",
    "rank_edges": f"""WITH {_C}, r AS (SELECT block_id, branch_local_id AS br, slot_id, row_number() OVER w - 1 AS r, count(*) OVER (PARTITION BY block_id, branch_local_id) AS n FROM c WINDOW w AS (PARTITION BY block_id, branch_local_id ORDER BY posx, slot_id)),
s AS (SELECT block_id, br, n, lead(br) OVER w AS br2, lead(n) OVER w AS n2 FROM (SELECT DISTINCT block_id, br, n FROM r) WINDOW w AS (PARTITION BY block_id ORDER BY br)),
t AS (SELECT *, least(n, n2) AS m, unnest(range(least(n, n2))) AS k FROM s WHERE br2 IS NOT NULL),
x AS (SELECT *, CAST(round_even((n - 1) * k / greatest(m - 1, 1), 0) AS BIGINT) AS r1, CAST(round_even((n2 - 1) * k / greatest(m - 1, 1), 0) AS BIGINT) AS r2 FROM t),
p AS (SELECT x.block_id, a.slot_id AS a, b.slot_id AS b FROM x JOIN r a ON a.block_id = x.block_id AND a.br = x.br AND a.r = x.r1 JOIN r b ON b.block_id = x.block_id AND b.br = x.br2 AND b.r = x.r2) {_BOTH}""",
    "even_subsample": f"""WITH {_C}, r AS (SELECT block_id, slot_id, posx, row_number() OVER (PARTITION BY block_id ORDER BY posx, slot_id) - 1 AS r, count(*) OVER (PARTITION BY block_id) AS n FROM c)
SELECT block_id, slot_id, posx FROM r WHERE n <= 5 OR r IN (0, CAST(round_even((n - 1) / 4, 0) AS BIGINT), CAST(round_even(2 * (n - 1) / 4, 0) AS BIGINT), CAST(round_even(3 * (n - 1) / 4, 0) AS BIGINT), n - 1)""",
    "slot_numbers": f"WITH {_C} SELECT * FROM (SELECT block_id, slot_id AS old_slot, row_number() OVER (PARTITION BY block_id ORDER BY branch_local_id, posx, slot_id) - 1 AS slot_id FROM c) WHERE slot_id < 12",
    "padded_slots": f"""WITH {_C}, f AS (SELECT DISTINCT block_id, unnest(range({SLOTS})) AS slot_id FROM blocks WHERE block_id IS NOT NULL)
SELECT block_id, slot_id, coalesce(e_i, 0) AS e_i, coalesce(branch_local_id, -1) AS branch_local_id, CASE WHEN c.block_id IS NULL THEN 0.0 ELSE posx END AS posx,
CASE WHEN c.block_id IS NULL THEN false ELSE is_living END AS is_living, building_id FROM f LEFT JOIN c USING (block_id, slot_id)""",
    "branch_cuts": f"WITH {_CUTS} SELECT * FROM cuts",
    "segment_lookup": f"""WITH {_CUTS}, p AS (SELECT DISTINCT block_id, unnest([0.0, 0.3, 0.7, 1.0])::DOUBLE AS s FROM cuts)
SELECT block_id, s, min(segment) AS segment FROM p JOIN cuts USING (block_id) WHERE (start < s AND s <= stop) OR (s <= 0 AND start = 0 AND stop > 0) GROUP BY ALL""",
    "max_run_rows": """WITH e AS (SELECT event_id, event_id // 40 AS row_i, event_id % 40 AS col_j FROM events WHERE event_type <> 'error'),
i AS (SELECT *, col_j - dense_rank() OVER (PARTITION BY row_i ORDER BY col_j) AS g FROM e)
SELECT event_id, row_i, col_j, (dense_rank() OVER (PARTITION BY row_i, g ORDER BY col_j) - 1) % 9 <> 8 AS keep FROM i""",
    "repeats_dropped": "SELECT event_type, count(*) AS n FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k = 1 OR p IS DISTINCT FROM event_type GROUP BY ALL",
    "latest_blocks": "SELECT block_id, load_id, n_buildings FROM (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY loaded_at DESC, load_id DESC) AS k FROM blocks WHERE block_id IS NOT NULL) WHERE k = 1",
    "knn_slots": f"WITH {_C}, {_KNN} SELECT * FROM kn",
    "knn_points": """WITH p AS (SELECT p_brand, p_partkey AS id, CAST(p_partkey % 97 AS DOUBLE) AS x, CAST(p_size AS DOUBLE) AS y FROM part)
SELECT p_brand, src, dst, rank, d2 FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, src ORDER BY d2, dst) AS rank FROM (
  SELECT a.p_brand, a.id AS src, b.id AS dst, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.id <> b.id)) WHERE rank <= 4""",
    "knn_embeddings": """SELECT src, dst, rank, d2 FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS rank FROM (
  SELECT a.vec_id AS src, b.vec_id AS dst, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) ** 2)) AS d2
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)) WHERE rank <= 3""",
    "knn_enrich": f"""WITH {_C}, {_KNN}, {_L}, p AS (SELECT block_id, src AS a, dst AS b FROM kn), q AS (SELECT DISTINCT * FROM ({_BOTH}))
SELECT * FROM q ANTI JOIN l USING (block_id, src_slot, dst_slot)""",
    "slot_components": f"""WITH RECURSIVE {_L}, e AS (SELECT block_id || ':' || lpad(CAST(src_slot AS VARCHAR), 6, '0') AS a, block_id || ':' || lpad(CAST(dst_slot AS VARCHAR), 6, '0') AS b FROM l),
x AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach(a, b) AS (SELECT a, a FROM x UNION SELECT r.a, x.b FROM reach r JOIN x ON r.b = x.a)
SELECT a AS node, min(b) AS component FROM reach GROUP BY a""",
    "neighbour_means": f"""WITH {_C}, {_L}, m AS (SELECT l.block_id, dst_slot AS slot_id, avg(posx) AS mx, avg(size_x) AS ms FROM l JOIN c ON c.block_id = l.block_id AND c.slot_id = l.src_slot GROUP BY ALL)
SELECT block_id, slot_id, coalesce(mx, 0.0) AS mean_posx, coalesce(ms, 0.0) AS mean_size_x FROM c LEFT JOIN m USING (block_id, slot_id)""",
    "axial_means": f"WITH {_C} SELECT block_id, 0.5 * atan2(avg(sin(2 * phi_resid)), avg(cos(2 * phi_resid))) AS angle FROM c GROUP BY block_id",
    "top_areas": f"""WITH {_C} SELECT * FROM (SELECT s_i, row_number() OVER (PARTITION BY s_i ORDER BY a DESC, block_id, slot_id) AS k, block_id, slot_id, a
FROM (SELECT *, CASE WHEN a_i IS NULL OR isnan(a_i) THEN 0.0 ELSE a_i END AS a FROM c)) WHERE k <= 5""",
    "service_slugs": f"SELECT CASE WHEN s = '' THEN 'service' ELSE s END AS slug, count(*) AS n FROM (SELECT {_SLUG} AS s FROM services WHERE service_type_name IS NOT NULL) GROUP BY ALL",
    "service_capacities": "SELECT DISTINCT service_id, " + "CASE " + " ".join(f"WHEN {c} IS NOT NULL AND isfinite({c}) THEN {c}" for c in ("capacity", "capacity_modeled", "weight_value")) + " ELSE 1.0 END AS capacity FROM services",
    "lenient_numbers": """SELECT CASE WHEN isnan(v) THEN NULL ELSE v END AS v, count(*) AS n FROM (
  SELECT CASE WHEN t IN ('true', 'yes', 'y', 't', '1') THEN 1.0 WHEN t IN ('false', 'no', 'n', 'f', '0') THEN 0.0 ELSE try_cast(t AS DOUBLE) END AS v FROM (SELECT lower(trim(floors_num)) AS t FROM buildings)) GROUP BY ALL""",
    "synonym_match": f"SELECT DISTINCT service_type_name, CASE {_SYN} END AS service FROM services WHERE service_type_name IS NOT NULL",
    "zone_targets": "SELECT * FROM (VALUES ('residential', 20000.0::DOUBLE, 9.0::DOUBLE), ('business', 0.0, 15.0), ('industrial', NULL, 5.0)) AS t(zone, living_area, floors)",
    "service_targets": "SELECT * FROM (VALUES ('school', 1100.0::DOUBLE), ('polyclinic', 250.0)) AS t(name, value)",
    "target_codes": f"WITH {_C} SELECT block_id, slot_id, ln(1 + la / (100.0 * 100.0 + 1e-6)) AS code, la AS area FROM (SELECT *, CASE WHEN living_area IS NULL OR isnan(living_area) OR living_area < 0 THEN 0.0 ELSE living_area END AS la FROM c)",
    "position_codes": f"""WITH {_C}, v AS (SELECT unnest(range(18)) AS k, posx, posy FROM c)
SELECT CAST(k AS INTEGER) AS k, sum(CASE WHEN k = 0 THEN posx WHEN k = 1 THEN posy WHEN k < 6 THEN sin(posx * pow(2, k - 2) * pi()) WHEN k < 10 THEN cos(posx * pow(2, k - 6) * pi())
WHEN k < 14 THEN sin(posy * pow(2, k - 10) * pi()) ELSE cos(posy * pow(2, k - 14) * pi()) END) AS total, count(*) AS n FROM v GROUP BY k""",
    "class_scores": f"""WITH {_C} SELECT block_id, slot_id, 1 / (1 + exp(-posx)) AS p, ln(1 + exp(posx)) AS soft, phi_resid * 400 - 360 * floor((phi_resid * 400 + 180) / 360) AS turn,
CASE WHEN s_i = 0 THEN '1' ELSE '0' END || CASE WHEN s_i = 1 THEN '1' ELSE '0' END || CASE WHEN s_i = 2 THEN '1' ELSE '0' END || CASE WHEN s_i = 3 THEN '1' ELSE '0' END AS hot FROM c""",
    "rectangle_shapes": """WITH s AS (SELECT n, r, CAST(ceil(n / r) AS BIGINT) AS c FROM (SELECT n, unnest(range(1, CAST(floor(sqrt(n)) AS BIGINT) + 13)) AS r FROM range(1, 41) t(n)))
SELECT n, CAST(k - 1 AS INTEGER) AS k, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, CAST(r * c - n AS INTEGER) AS waste FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY r * c - n, abs(r - c), r, c) AS k FROM s WHERE greatest(r, c) <= 3 * least(r, c)) WHERE k <= 12""",
    "padded_names": "SELECT 'C' || lpad(CAST(n_nationkey AS VARCHAR), 6, '0') AS name, 'EPSG:3857' AS crs, regexp_replace(n_name, '[^A-Za-z0-9_]+', '_', 'g') || '_x' AS key FROM nation",
}
