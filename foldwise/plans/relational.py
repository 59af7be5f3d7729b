"""Registered queries: sources, cleaning, joins, aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.functions import plans_json
from foldwise.functions.calendar import hour_bucket
from foldwise.functions.hashing import hash_int
from foldwise.operators import aggregates as A, clean as P, joins as J
from foldwise.plans import fixtures as X
from foldwise.plans.registry import query, r6
from foldwise.session import settle, shared_folder
from foldwise.sources import parts as parts_store, predictions as prediction_store, tables

# --- sources and sinks ----------------------------------------------------------


@query("s1_csv_scan_roles", f"WITH {X.CLAIMS} SELECT id, split, cat1, cat2, cat3, cat4, cont1, cont2, cont3, loss FROM claims")
def csv_scan(spark, sf):
    rows = X.claims(spark, sf)
    folder = shared_folder(spark, "csv")
    tables.write_csv(rows, folder)
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    back = tables.read_csv(spark, folder, schema)
    return tables.select_roles(back, tables.roles(back), ["id", "split", "loss"])


@query(
    "s2_multi_table_scan",
    "SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem "
    "UNION ALL SELECT 'customer', count(*) FROM customer",
)
def multi_table_scan(spark, sf):
    # fixed values: the schemas read
    schemas = {
        "orders": "o_orderkey bigint",
        "lineitem": "l_orderkey bigint",
        "customer": "c_custkey bigint",
    }
    found = tables.read_tables(spark, sf, schemas, "parquet")
    counts = [d.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")) for n, d in found.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(
    "s3_part_store",
    f"WITH {X.CLAIMS} SELECT id, cont1, cont2, cat1, cat2 FROM claims WHERE split = 'train'",
)
def part_store(spark, sf):
    rows = X.claims(spark, sf)
    root = shared_folder(spark, "parts")
    parts_store.save_parts(
        {"numeric": rows.select("id", "split", "cont1", "cont2"), "categorical": rows.select("id", "split", "cat1", "cat2")}, root
    )
    return parts_store.load_parts(spark, root, ["numeric", "categorical"], "train")


@query(
    "s4_part_registry",
    f"WITH {X.CLAIMS} " + " UNION ALL ".join(
        f"SELECT 'numeric' AS part, {i} AS position, '{c}' AS feature, count({c}) AS n, min({c}) AS lowest, max({c}) AS highest FROM claims WHERE split = 'train'"
        for i, c in enumerate(X.CLAIM_NUMS)
    ),
)
def part_registry(spark, sf):
    rows = X.claims(spark, sf)
    root = shared_folder(spark, "parts")
    parts_store.save_part(rows.select("id", "split", *X.CLAIM_NUMS), root, "numeric")
    stored = parts_store.load_parts(spark, root, ["numeric"], "train")
    long = stored.unpivot(["id"], X.CLAIM_NUMS, "feature", "value")
    facts = long.groupBy("feature").agg(F.count("value").alias("n"), F.min("value").alias("lowest"), F.max("value").alias("highest"))
    manifest = spark.read.parquet(f"{root}/manifest").select("part", "position", "feature")
    return manifest.join(facts, "feature").select("part", "position", "feature", "n", "lowest", "highest")


@query(
    "s5_sparse_part",
    f"""WITH {X.CLAIMS} SELECT id, feature, value FROM (
    SELECT id, 'cont2' AS feature, cont2 AS value FROM claims UNION ALL SELECT id, 'cont3', cont3 FROM claims) WHERE value <> 0""",
)
def sparse_part(spark, sf):
    root = shared_folder(spark, "parts")
    long = parts_store.to_long(X.claims(spark, sf), "id", ["cont2", "cont3"], "split")
    parts_store.save_part(long, root, "edges")
    return parts_store.load_part(spark, root, "edges").drop("split")


_PREDICTIONS_MEAN = f"""WITH {X.PREDICTIONS}
SELECT id, round(pow((pred + (pred + 10)) / 2, 1.02), 4) AS value FROM predictions"""


@query("s6_s7_prediction_store", _PREDICTIONS_MEAN)
def prediction_roundtrip(spark, sf):
    rows = X.predictions(spark, sf)
    root = shared_folder(spark, "pred")
    first, second = rows.select("id", F.col("pred").alias("value")), rows.select("id", (F.col("pred") + 10).alias("value"))
    prediction_store.save_predictions(first, root, "a-1.0", "test-fulltrain")
    prediction_store.save_predictions(second, root, "b-2.0", "test")
    spec = (["a-1.0", "b-2.0"], {"power": 1.02})
    return prediction_store.load_prediction(spark, root, spec, "test").select("id", F.round("value", 4).alias("value"))


@query(
    "s7_class_predictions",
    f"""WITH {X.CLASS_SCORES} SELECT id, {', '.join(f'round(pow((c{i} + c{11 - i}) / 2, 1.02::DOUBLE), 6) AS c{i}' for i in range(12))} FROM class_scores""",
)
def class_prediction_roundtrip(spark, sf):
    """Tables with one column per class, saved under two runs and read back as the power of their mean."""
    rows, root = X.class_scores(spark, sf), shared_folder(spark, "pred")
    names = [f"c{i}" for i in range(12)]
    prediction_store.save_predictions(rows.select("id", *names), root, "a-0.5", "test-fulltrain")
    turned = [F.col(c).alias(n) for c, n in zip(reversed(names), names)]
    prediction_store.save_predictions(rows.select("id", *turned), root, "b-0.6", "test-fulltrain")
    return prediction_store.load_prediction(spark, root, (["a-0.5", "b-0.6"], {"power": 1.02}), "test").select("id", *r6(*names))


@query(
    "p19_preset_inputs",
    f"""WITH {X.PREDICTIONS}, i AS (SELECT id, score, pred AS a, pred * 2 AS b FROM predictions),
    t AS (SELECT id, score, ln(greatest(a, 0.1) + 200) AS a, ln(greatest((a + b) / 2, 0.1) + 200) AS pred_1, ln(greatest(pow(b, 1.5::DOUBLE), 0.1) + 200) AS b FROM i)
    SELECT id, score, round(a, 6) AS a, round(pred_1, 6) AS pred_1, round(b, 6) AS b_power, round(pow(score, 1.02::DOUBLE), 6) AS score_2,
      round(pow(a, 1.02::DOUBLE), 6) AS a_2, round(pow(pred_1, 1.02::DOUBLE), 6) AS pred_1_2, round(pow(b, 1.02::DOUBLE), 6) AS b_power_2 FROM t""",
)
def preset_inputs(spark, sf):
    """Inputs of a preset: a run by the preset's name, a list of runs, a power of a run, and powers of all of them."""
    from foldwise.plans import stacking

    rows, root = X.predictions(spark, sf), shared_folder(spark, "pred")
    for name, moment, factor in (("a", "20240101-0000", 5.0), ("a", "20240102-0000", 1.0), ("b", "20240101-0000", 2.0)):
        table = rows.select("id", (F.col("pred") * factor).alias("value"))
        for part in ("train", "test-fulltrain"):
            prediction_store.save_predictions(table, root, f"{moment}-{name}-1.00000", part)
    preset = stacking.Preset(
        "next", ("score",), None, predictions=("a", ["a", "b"], ("b", {"power": 1.5})), prediction_transform=("log_ofs", 200), powers=(1.02,)
    )
    base = rows.select("id", "score")
    _, made, names = stacking.level_inputs(base, base, preset, root)
    shown = ["score", "a", "pred_1", "b_power", "score_2", "a_2", "pred_1_2", "b_power_2"]
    return made.select("id", *[(F.col(n) if o == "score" else F.round(n, 6)).alias(o) for n, o in zip(names, shown)])


@query("s8_csv_sink", f"WITH {X.CLICKS} SELECT sid, click_mode FROM clicks")
def csv_sink(spark, sf):
    folder = shared_folder(spark, "submission")
    tables.write_csv(X.clicks(spark, sf), folder)
    return tables.read_csv(spark, folder, "sid bigint, click_mode int")


@query(
    "s9_libsvm_export",
    f"WITH {X.CLAIMS} SELECT loss AS label, count(*) AS n, round(sum(cont1 + cont2 + cont3), 6) AS total FROM claims GROUP BY loss",
)
def libsvm_export(spark, sf):
    from pyspark.ml.functions import vector_to_array

    from foldwise.encoders.projection import as_vector

    folder = shared_folder(spark, "libsvm")
    tables.write_libsvm(as_vector(X.claims(spark, sf), X.CLAIM_NUMS, "features"), folder, "loss", "features")
    back = spark.read.format("libsvm").option("numFeatures", "3").load(folder)
    total = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, x: a + x)
    return back.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(total), 6).alias("total"))


# --- projections, filters, cleaning ---------------------------------------------


@query("p1_prefix_projection", f"WITH {X.CLAIMS} SELECT id, cont1, cont2, cont3 FROM claims")
def prefix_projection(spark, sf):
    return P.select_prefix(X.claims(spark, sf), "cont", ["id"])


@query(
    "p2_rename_prefix_drop",
    "SELECT p_partkey, p_brand AS cat_p_brand, p_type AS cat_p_type, p_size AS cat_p_size FROM part",
)
def rename_prefix(spark, sf):
    part = X.table(spark, sf, "part").drop("p_name", "p_retailprice")
    return P.prefix_columns(part, "cat_", ["p_partkey"])


@query(
    "p3_constant_null_fill",
    f"""WITH {X.SESSIONS} SELECT sid, coalesce(pid, -1) AS pid,
    CASE WHEN pid IS NULL THEN (SELECT min(req_time) FROM sessions) ELSE req_time END AS last_time FROM sessions""",
)
def null_fill(spark, sf):
    rows = X.sessions(spark, sf).withColumn("last_time", F.when(F.col("pid").isNotNull(), F.col("req_time")))
    rows = P.fill_with_minimum(rows, "last_time", "req_time")
    return P.fill_constants(rows, {"pid": -1}).select("sid", "pid", "last_time")


@query(
    "p4_split_by_label",
    f"""WITH {X.HISTORY} SELECT 'train' AS split, mode, count(*) AS n FROM history WHERE mode <> -1 GROUP BY mode
    UNION ALL SELECT 'test', NULL, count(*) FROM history WHERE mode = -1""",
)
def split_by_label(spark, sf):
    known, unknown = P.split_by_label(X.history(spark, sf), "mode", -1, ["sid"])
    a = known.groupBy("mode").agg(F.count(F.lit(1)).alias("n")).select(F.lit("train").alias("split"), "mode", "n")
    b = unknown.agg(F.count(F.lit(1)).alias("n")).select(F.lit("test").alias("split"), F.lit(None).cast("int").alias("mode"), "n")
    return a.unionByName(b)


@query("p5_drop_sparse", f"WITH {X.BATCHES} SELECT id, num1, cat1, cat2, mv1 FROM batches")
def drop_sparse(spark, sf):
    rows = X.batches(spark, sf).withColumn("hollow", F.when(F.col("id") % 20 == 0, F.col("num1")))
    cols = ["num1", "hollow", "cat1", "cat2", "mv1"]
    return P.DropSparse(0.9).fit(rows.filter("batch_no = 0"), cols).transform(rows, ["id"])


@query(
    "p6_row_null_count",
    f"""WITH {X.BATCHES} SELECT id, (num1 IS NULL)::INTEGER + (cat1 IS NULL)::INTEGER + (mv1 IS NULL)::INTEGER AS missing FROM batches""",
)
def row_nulls(spark, sf):
    return P.row_null_count(X.batches(spark, sf), ["num1", "cat1", "mv1"]).select("id", "missing")


@query(
    "p7_clip",
    f"WITH {X.PREDICTIONS} SELECT id, round(greatest(least(pred, 300000.0), 100000.0), 6) AS pred FROM predictions",
)
def clip(spark, sf):
    return P.clip(X.predictions(spark, sf), ["pred"], 100000.0, 300000.0).select("id", *r6("pred"))


@query(
    "p8_narrow_types",
    """WITH v AS (SELECT l_linenumber, l_partkey, l_quantity, l_discount, CASE WHEN l_linenumber > 1 THEN l_quantity END AS gap FROM lineitem),
    long AS ("""
    + " UNION ALL ".join(
        f"SELECT '{c}' AS name, coalesce({c}, -999)::DOUBLE AS x, {c} IS NULL AS bad FROM v"
        for c in ("l_linenumber", "l_partkey", "l_quantity", "l_discount", "gap")
    )
    + """) SELECT name, CASE WHEN sum(abs(x - trunc(x))) >= 0.01 THEN 'float' WHEN max(abs(x)) <= 127 THEN 'tinyint'
    WHEN max(abs(x)) <= 32767 THEN 'smallint' WHEN max(abs(x)) <= 2147483647 THEN 'int' ELSE 'bigint' END AS kind, bool_or(bad) AS filled
    FROM long GROUP BY name""",
)
def narrow(spark, sf):
    rows = X.table(spark, sf, "lineitem").select("l_linenumber", "l_partkey", "l_quantity", "l_discount")
    rows = rows.withColumn("gap", F.when(F.col("l_linenumber") > 1, F.col("l_quantity")))
    done, filled = P.narrow_types(rows)
    # one row per column: the types are part of the schema, counted on the rows
    kinds = {c: (t, c in filled) for c, t in done.dtypes}
    return done.agg(F.count(F.lit(1)).alias("_n")).select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.lit(t).alias("kind"), F.lit(f).alias("filled")) for c, (t, f) in kinds.items()]))
    )


@query(
    "p9_sentinel_row",
    "SELECT CAST(vec_id AS BIGINT) AS pid, label FROM embeddings UNION ALL SELECT -1, 0",
)
def sentinel_row(spark, sf):
    rows = X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("pid"), "label")
    return P.with_sentinel_row(rows, "pid", -1)


@query(
    "p10_pair_differences",
    f"WITH {X.CLAIMS} SELECT id, round(cont1 - cont2, 6) AS diff_1_2, round(cont1 - cont3, 6) AS diff_1_3, round(cont2 - cont3, 6) AS diff_2_3 FROM claims",
)
def differences(spark, sf):
    pairs = [("cont1", "cont2"), ("cont1", "cont3"), ("cont2", "cont3")]
    names = ["diff_1_2", "diff_1_3", "diff_2_3"]
    return P.pair_differences(X.claims(spark, sf), pairs, names).select("id", *r6(*names))


@query(
    "p11_edge_flags",
    f"WITH {X.CLAIMS} SELECT id, (cont1 = 1)::INTEGER AS cont1_one, (cont2 = 0)::INTEGER AS cont2_zero, (cont3 = 0)::INTEGER AS cont3_zero FROM claims",
)
def edge_flags(spark, sf):
    rows = X.claims(spark, sf)
    flags = P.EdgeFlags(X.CLAIM_NUMS).fit(rows)
    return flags.transform(rows).select("id", *flags.feature_names())


@query(
    "p12_equality_flags",
    f"""WITH {X.CLAIMS} SELECT id, coalesce((cat1 = nullif(cat2, 'O'))::INTEGER, 0) AS same_ab, (cont2 = cont3)::INTEGER AS same_num FROM claims""",
)
def equality_flags(spark, sf):
    rows = X.claims(spark, sf).withColumn("cat2", F.nullif(F.col("cat2"), F.lit("O")))
    return P.equal_flags(rows, {"same_ab": ("cat1", "cat2"), "same_num": ("cont2", "cont3")}).select("id", "same_ab", "same_num")


@query(
    "p13_hour_bucket",
    """SELECT event_id, CASE WHEN hour(ts) <= 6 THEN 0 WHEN hour(ts) <= 12 THEN 1 WHEN hour(ts) <= 18 THEN 2 ELSE 3 END AS bucket FROM events""",
)
def buckets(spark, sf):
    return X.table(spark, sf, "events").select("event_id", hour_bucket(F.hour("ts")).alias("bucket"))


@query(
    "p14_class_groups",
    f"""WITH {X.PLAN_ITEMS} SELECT sid, line, l_partkey, l_suppkey,
    CASE WHEN mode IN (1,2,5,7,9,10,11) THEN 'transit' WHEN mode = 3 THEN 'car' WHEN mode IN (4,8) THEN 'taxi' ELSE 'other' END AS large_mode FROM items""",
)
def class_groups(spark, sf):
    large = P.group_classes(F.col("mode"), P.MODE_GROUPS, P.MODE_OTHER)
    return X.plan_items(spark, sf).select("sid", *X.ITEM_ORDER, large.alias("large_mode"))


@query(
    "p15_conditional_fill",
    f"""WITH {X.PLAN_ITEMS} SELECT sid, line, l_partkey, l_suppkey, CASE WHEN mode IN (3,5,6) THEN 0 ELSE price END AS price FROM items""",
)
def conditional_fill(spark, sf):
    return P.fill_by_class(X.plan_items(spark, sf), "price", "mode", (3, 5, 6), 0).select("sid", *X.ITEM_ORDER, "price")


@query(
    "p16_conditional_cap",
    f"""WITH {X.PLAN_ITEMS} SELECT sid, line, l_partkey, l_suppkey,
    round(CASE WHEN mode = 4 AND price * 100 / nullif(distance, 0) > 3 THEN 3.0::DOUBLE ELSE (price * 100)::DOUBLE / nullif(distance, 0) END, 6) AS unit_price,
    round(least(distance::DOUBLE / nullif(eta, 0), 1000.0), 6) AS speed FROM items""",
)
def conditional_cap(spark, sf):
    from foldwise.functions.numeric import rates

    rows = rates(X.plan_items(spark, sf))
    # fixed values: caps of the unit price of taxi plans and of the speed
    rows = P.cap_where(rows, "unit_price", (F.col("mode") == 4) & (F.col("unit_price") > 3), 3.0)
    rows = P.cap_where(rows, "speed", F.col("speed") > 1000, 1000.0)
    return rows.select("sid", *X.ITEM_ORDER, *r6("unit_price", "speed"))


@query("p17_slice_rows", f"WITH {X.CLAIMS} SELECT id, loss FROM claims WHERE split = 'test'")
def slice_rows(spark, sf):
    rows = X.claims(spark, sf)
    return P.slice_rows(rows, rows.filter("split = 'test'"), "id").select("id", "loss")


@query(
    "p18_power_expansion",
    f"""WITH {X.CLAIMS} SELECT id, round(pow(cont1, 2.0), 6) AS "cont1^2", round(pow(cont1, 0.25), 6) AS "cont1^0.25" FROM claims""",
)
def powers(spark, sf):
    return P.add_powers(X.claims(spark, sf), ["cont1"], [2, 0.25]).select("id", *r6("cont1^2", "cont1^0.25"))


@query(
    "p19_stacked_input",
    f"""WITH {X.PREDICTIONS} SELECT id, score, round(ln(greatest(pred - 200000, 0.1) + 200), 6) AS pred_1, round(ln(greatest(truth, 0.1) + 200), 6) AS pred_2 FROM predictions""",
)
def stacked_input(spark, sf):
    from foldwise.functions.numeric import prediction_transform
    from foldwise.plans.stacking import assemble_inputs

    rows = X.predictions(spark, sf)
    p1 = rows.select("id", (F.col("pred") - 200000).alias("value"))
    p2 = rows.select("id", F.col("truth").alias("value"))
    done = assemble_inputs([rows.select("id", "score")], {"pred_1": p1, "pred_2": p2}, "id", 0.1, prediction_transform("log_ofs", 200))
    return done.select("id", "score", *r6("pred_1", "pred_2"))


@query(
    "p20_date_threshold",
    """SELECT CASE WHEN ts <= TIMESTAMP '2024-01-15' THEN 'before' ELSE 'after' END AS side, count(*) AS n FROM events GROUP BY 1""",
)
def date_threshold(spark, sf):
    before, after = P.split_by_time(X.table(spark, sf, "events"), "ts", "2024-01-15")
    count = lambda d, s: d.agg(F.lit(s).alias("side"), F.count(F.lit(1)).alias("n"))
    return count(before, "before").unionByName(count(after, "after"))


# --- joins ------------------------------------------------------------------------

_PLAN_COUNTS = "plan_counts AS (SELECT l_orderkey AS sid, count(*) AS n_plans FROM lineitem GROUP BY 1)"


def _plan_counts(spark, sf):
    return X.plan_items(spark, sf).groupBy("sid").agg(F.count(F.lit(1)).alias("n_plans"))


@query(
    "j1_left_join_chain",
    f"""WITH {X.SESSIONS}, {X.CLICKS}, {_PLAN_COUNTS} SELECT s.sid, s.pid, coalesce(click_mode, 0) AS click_mode, n_plans
    FROM sessions s LEFT JOIN clicks c ON s.sid = c.sid LEFT JOIN plan_counts p ON s.sid = p.sid""",
)
def left_chain(spark, sf):
    q = X.sessions(spark, sf).select("sid", "pid")
    return J.join_sessions(q, X.clicks(spark, sf), _plan_counts(spark, sf), "sid", "left")


@query(
    "j2_inner_join_chain",
    f"""WITH {X.SESSIONS}, {X.CLICKS}, {_PLAN_COUNTS} SELECT s.sid, s.pid, click_mode, n_plans
    FROM sessions s JOIN clicks c ON s.sid = c.sid JOIN plan_counts p ON s.sid = p.sid""",
)
def inner_chain(spark, sf):
    q = X.sessions(spark, sf).select("sid", "pid")
    return J.join_sessions(q, X.clicks(spark, sf), _plan_counts(spark, sf), "sid", "inner")


@query(
    "j3_role_join",
    f"""WITH {X.SESSIONS}, {X.ADDRESSES} SELECT sid, a.district AS cat_source_district, a.adcode AS cat_source_adcode,
    b.district AS cat_des_district, b.adcode AS cat_des_adcode
    FROM sessions JOIN addresses a ON o = a.lntlat JOIN addresses b ON d = b.lntlat""",
)
def roles_of_address(spark, sf):
    dim = X.addresses(spark, sf).drop("street_number")
    done = J.role_join(X.sessions(spark, sf), dim, "lntlat", {"cat_source_": "o", "cat_des_": "d"})
    return done.select("sid", "cat_source_district", "cat_source_adcode", "cat_des_district", "cat_des_adcode")


@query(
    "j4_dimension_left_join",
    f"""WITH {X.SESSIONS}, dim AS (SELECT CAST(vec_id AS BIGINT) AS pid, label FROM embeddings UNION ALL SELECT -1, 0)
    SELECT sid, coalesce(s.pid, -1) AS pid, label FROM sessions s LEFT JOIN dim ON coalesce(s.pid, -1) = dim.pid""",
)
def dimension_left(spark, sf):
    dim = X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("pid"), "label")
    return J.left_dim(X.sessions(spark, sf).select("sid", "pid"), dim, "pid")


@query(
    "j5_value_lookup",
    f"""WITH {X.CLAIMS}, counts AS (SELECT cat3, count(*) AS n FROM claims WHERE split = 'train' AND cat3 <> 'Brand#7' GROUP BY 1)
    SELECT id, coalesce(n, 0) AS n FROM claims c LEFT JOIN counts USING (cat3) WHERE split = 'test'""",
)
def value_lookup(spark, sf):
    from foldwise.operators.skew import lookup

    rows = X.claims(spark, sf)
    counts = rows.filter("split = 'train' and cat3 <> 'Brand#7'").groupBy("cat3").agg(F.count(F.lit(1)).alias("n"))
    return lookup(rows.filter("split = 'test'"), counts, ["cat3"]).select("id", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "j6_aggregate_joined_back",
    f"""WITH {X.CLAIMS} SELECT id, round(avg(loss) OVER (PARTITION BY cat3), 4) AS mean_loss, max(cont1) OVER (PARTITION BY cat3) AS max_cont1 FROM claims""",
)
def aggregate_back(spark, sf):
    done = J.agg_back(X.claims(spark, sf), ["cat3"], {"mean_loss": F.avg("loss"), "max_cont1": F.max("cont1")})
    return done.select("id", F.round("mean_loss", 4).alias("mean_loss"), "max_cont1")


@query(
    "j7_semi_join",
    f"WITH {X.CLICKS} SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT sid FROM clicks WHERE click_mode > 6)",
)
def semi(spark, sf):
    keys = X.clicks(spark, sf).filter("click_mode > 6").withColumnRenamed("sid", "o_orderkey")
    return J.keep_keys(X.table(spark, sf, "orders"), keys, "o_orderkey").select("o_orderkey", "o_totalprice")


@query(
    "j8_anti_join",
    f"WITH {X.CLICKS} SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT sid FROM clicks)",
)
def anti(spark, sf):
    keys = X.clicks(spark, sf).withColumnRenamed("sid", "o_orderkey")
    return J.drop_keys(X.table(spark, sf, "orders"), keys, "o_orderkey").select("o_orderkey", "o_totalprice")


@query(
    "j9_column_concat",
    f"WITH {X.SESSIONS}, {X.CLICKS} SELECT s.sid, s.pid, click_mode, o_totalprice FROM sessions s JOIN clicks c ON s.sid = c.sid JOIN orders ON s.sid = o_orderkey",
)
def column_concat(spark, sf):
    prices = X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("sid"), "o_totalprice")
    return J.hstack([X.sessions(spark, sf).select("sid", "pid"), X.clicks(spark, sf), prices], "sid")


@query(
    "j10_formatted_key_join",
    f"""WITH {X.SESSIONS}, {X.ADDRESSES} SELECT sid, lntlat, district FROM sessions LEFT JOIN addresses ON o = lntlat""",
)
def formatted_key(spark, sf):
    from foldwise.functions.geo import split_pair

    lng, lat = split_pair(F.col("o"))
    rows = X.sessions(spark, sf).select("sid", lng.alias("lng"), lat.alias("lat"))
    dim = X.addresses(spark, sf).select("lntlat", "district")
    return J.format_join(rows, dim, ("lng", "lat"), "lntlat").select("sid", "lntlat", "district")


_DIST = "sqrt(list_sum(list_transform(list_zip(q.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))))"
# queries: every fifth vector, against all others
_NEAR = f"""WITH pairs AS (SELECT q.vec_id AS id, b.vec_id AS bid, {_DIST} AS dist FROM embeddings q JOIN embeddings b ON q.vec_id % 5 = 0 AND b.vec_id IS DISTINCT FROM q.vec_id),
best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, bid) AS place FROM pairs)"""
# a training and a test part
_SPLIT = f"""WITH pairs AS (SELECT q.vec_id AS id, b.vec_id AS bid, b.label, {_DIST} AS dist FROM embeddings q JOIN embeddings b ON q.vec_id % 5 = 0 AND b.vec_id % 5 <> 0),
best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, bid) AS place FROM pairs)"""


def _vectors(spark, sf):
    return X.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label"
    )


def _neighbours(found):
    return found.select("id", F.col("base_id").alias("bid"), F.col("place").cast("bigint").alias("place"), *r6("dist"))


@query("j11_knn_join", _NEAR + " SELECT id, bid, place, round(dist, 6) AS dist FROM best WHERE place <= 5")
def knn_rows(spark, sf):
    from foldwise.operators.knn import knn_join

    rows = _vectors(spark, sf)
    return _neighbours(knn_join(rows.filter("id % 5 = 0"), rows, "id", "vec", 5, others=True))


@query("j11_knn_lsh")
def knn_lsh_rows(spark, sf):
    """The approximate form, with every twentieth vector; its recall is tested against the exact one."""
    from foldwise.operators.knn_lsh import lsh_knn_join

    rows = _vectors(spark, sf)
    return _neighbours(lsh_knn_join(rows.filter("id % 20 = 0"), rows, "id", "vec", 5, others=True))


@query(
    "j11_knn_vote",
    _SPLIT + " SELECT id, round(avg(label), 6) AS uniform, round(sum(label / dist) / sum(1 / dist), 6) AS weighted FROM best WHERE place <= 20 GROUP BY id",
)
def knn_votes(spark, sf):
    from foldwise.operators.knn import knn_predict

    rows = _vectors(spark, sf)
    q, b = rows.filter("id % 5 = 0"), rows.filter("id % 5 <> 0")
    uniform = knn_predict(q, b, "id", "vec", "label", 20, "uniform").withColumnRenamed("value", "uniform")
    weighted = knn_predict(q, b, "id", "vec", "label", 20, "distance").withColumnRenamed("value", "weighted")
    return uniform.join(weighted, "id").select("id", *r6("uniform", "weighted"))


@query(
    "j11_knn_class_votes",
    _SPLIT
    + f""", v AS (SELECT *, label % 12 AS c FROM best WHERE place <= 20)
    SELECT id, {', '.join(f"round(count(*) FILTER (c = {i}) / 20.0::DOUBLE, 6) AS c{i}" for i in range(12))},
      {', '.join(f"round(coalesce(sum(1 / dist) FILTER (c = {i}), 0) / sum(1 / dist), 6) AS w{i}" for i in range(12))} FROM v GROUP BY id""",
)
def knn_class_vote_rows(spark, sf):
    """Shares of the twelve classes among the neighbours, each vote alike and weighted by 1 / distance."""
    from foldwise.operators.knn import class_votes, knn_join

    rows = _vectors(spark, sf).withColumn("c", F.col("label") % 12)
    q, b = rows.filter("id % 5 = 0"), rows.filter("id % 5 <> 0")
    near = settle(knn_join(q, b, "id", "vec", 20))
    uniform = class_votes(near, b, "id", "c", 12)
    weighted = class_votes(near, b, "id", "c", 12, "distance").withColumnsRenamed({f"c{i}": f"w{i}" for i in range(12)})
    return uniform.join(weighted, "id").select("id", *r6(*[f"c{i}" for i in range(12)], *[f"w{i}" for i in range(12)]))


@query(
    "j11_bagged_knn",
    f"""WITH {X.PREDICTIONS}, b AS (SELECT id, {X.md5_sql('id', 'split')} % 10 < 3 AS test, pred AS x, hit + 0.0::DOUBLE AS z, truth AS y FROM predictions),
    o AS (SELECT b.*, bag, CAST(42 + 17 * bag AS VARCHAR) AS seed, count(*) OVER (PARTITION BY bag) AS n FROM b, (SELECT unnest([0, 1]) AS bag) WHERE NOT test),
    r AS (SELECT *, row_number() OVER (PARTITION BY bag ORDER BY md5(CAST(id AS VARCHAR) || '|' || seed), id) AS place FROM o),
    s AS (SELECT * FROM r WHERE place <= floor(0.2::DOUBLE * n)),
    m AS (SELECT bag, avg(x) AS mx, stddev_samp(x) AS sx, avg(z) AS mz, stddev_samp(z) AS sz FROM s GROUP BY bag),
    f AS (SELECT s.bag, s.id, ln(y + 200) AS t, (x - mx) / sx AS x, (z - mz) / sz AS z FROM s JOIN m USING (bag)),
    q AS (SELECT bag, id, (x - mx) / sx AS x, (z - mz) / sz AS z FROM b CROSS JOIN m WHERE test AND id % 20 = 0),
    d AS (SELECT q.bag, q.id, t, row_number() OVER (PARTITION BY q.bag, q.id ORDER BY sqrt((q.x - f.x) ** 2 + (q.z - f.z) ** 2), f.id) AS place FROM q JOIN f USING (bag)),
    v AS (SELECT bag, id, greatest(exp(avg(t)) - 200, 1) AS v FROM d WHERE place <= 20 GROUP BY 1, 2)
    SELECT id, round(avg(v), 2) AS value FROM v GROUP BY id""",
)
def bagged_knn(spark, sf):
    """A neighbour preset: scaled inputs, a fifth of the rows in each bag, 20 neighbours, the mean of the bags."""
    from foldwise.operators.knn import KnnLearner
    from foldwise.plans import stacking

    split = F.when(hash_int(F.col("id"), "split") % 10 < 3, "test").otherwise("train")
    rows = settle(X.predictions(spark, sf).select("id", split.alias("split"), "pred", F.col("hit").cast("double").alias("z"), "truth"))
    preset = stacking.Preset(
        "knn2", ("pred", "z"), KnnLearner(20), target="truth", transform=("log_ofs", 200), sample=0.2, options={"keep": ("id",)}
    )
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test' and id % 20 = 0")
    found = []
    for number in range(2):
        made = stacking.bag(train, preset.features, "id", preset.sample, None, None, 42 + 17 * number)
        found.append(stacking.fit_predict(preset, made, {"test": test}, 42)["test"])
    _, back = preset.transforms()
    done = stacking.aggregate_predictions(found[0].unionByName(found[1]), "id", "mean", back, by=())
    return done.select("id", F.round("value", 2).alias("value"))


# --- aggregations ---------------------------------------------------------------


@query(
    "a1_value_frequency",
    f"""WITH {X.CLAIMS}, long AS (UNPIVOT (SELECT cat1, cat2, cat3, cat4 FROM claims) ON cat1, cat2, cat3, cat4 INTO NAME feature VALUE value)
    SELECT feature, value, count(*) AS cnt FROM long GROUP BY 1, 2""",
)
def value_frequency(spark, sf):
    return A.frequencies(X.claims(spark, sf), X.CLAIM_CATS)


@query("a2_value_counts", "SELECT event_type, count(*) AS cnt FROM events GROUP BY 1")
def value_counts(spark, sf):
    return A.value_counts(X.table(spark, sf, "events"), "event_type")


@query(
    "a3_distinct_count",
    """SELECT 'l_orderkey' AS feature, count(DISTINCT l_orderkey) AS n_distinct FROM lineitem UNION ALL SELECT 'l_partkey', count(DISTINCT l_partkey) FROM lineitem
    UNION ALL SELECT 'l_tax', count(DISTINCT l_tax) FROM lineitem UNION ALL SELECT 'l_shipdate', count(DISTINCT l_shipdate) FROM lineitem""",
)
def distinct_count(spark, sf):
    return A.nunique(X.table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey", "l_tax", "l_shipdate"])


def _describe_sql(table, cols):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS min,
        round(quantile_cont({c}::DOUBLE, 0.25), 6) AS q25, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS q50, round(quantile_cont({c}::DOUBLE, 0.75), 6) AS q75,
        max({c})::DOUBLE AS max FROM {table}"""
        for c in cols
    )


@query("a4_describe", _describe_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount"]))
def describe(spark, sf):
    done = A.describe(X.table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return done.select("feature", "count", *r6("mean", "std", "min", "q25", "q50", "q75", "max"))


@query(
    "a5_null_count",
    f"""WITH {X.BATCHES} SELECT 'num1' AS feature, count(*) - count(num1) AS n_null FROM batches UNION ALL SELECT 'cat1', count(*) - count(cat1) FROM batches
    UNION ALL SELECT 'mv1', count(*) - count(mv1) FROM batches""",
)
def null_count(spark, sf):
    return A.null_counts(X.batches(spark, sf), ["num1", "cat1", "mv1"])


_STATS = ", ".join(
    f"max({c}) AS max_{c}, min({c}) AS min_{c}, round(avg({c}), 6) AS mean_{c}, round(stddev_pop({c}), 6) AS std_{c}"
    for c in ("distance", "price", "eta")
)


@query("a6_group_stats", f"WITH {X.PLAN_ITEMS} SELECT sid, {_STATS} FROM items GROUP BY sid")
def group_stats(spark, sf):
    done = A.group_stats(X.plan_items(spark, sf), ["sid"], ["distance", "price", "eta"])
    floats = [f"{n}_{c}" for n in ("mean", "std") for c in ("distance", "price", "eta")]
    return done.select("sid", *[c for c in done.columns if c != "sid" and c not in floats], *r6(*floats))


def _extreme_sql(last: str):
    parts = []
    for c in ("distance", "eta"):
        parts.append(f"first(mode ORDER BY {c} DESC, line {last}, l_partkey {last}, l_suppkey {last}) AS max_{c}_mode")
        parts.append(f"first(mode ORDER BY {c}, line, l_partkey, l_suppkey) AS min_{c}_mode")
    return f"WITH {X.PLAN_ITEMS} SELECT sid, {', '.join(parts)} FROM items GROUP BY sid"


@query("a7_arg_extreme", _extreme_sql("DESC"))
def arg_extreme(spark, sf):
    return A.arg_extreme(X.plan_items(spark, sf), ["sid"], ["distance", "eta"], X.ITEM_ORDER, "mode")


@query("a7_arg_extreme_first", _extreme_sql(""))
def arg_extreme_first(spark, sf):
    return A.arg_extreme(X.plan_items(spark, sf), ["sid"], ["distance", "eta"], X.ITEM_ORDER, "mode", "first")


@query("a8_first_by_position", f"WITH {X.PLAN_ITEMS} SELECT sid, first(mode ORDER BY line, l_partkey, l_suppkey) AS first_mode FROM items GROUP BY sid")
def first_by(spark, sf):
    return A.first_by(X.plan_items(spark, sf), ["sid"], X.ITEM_ORDER, "mode", "first_mode")


@query(
    "a9_ordered_text",
    f"""WITH {X.PLAN_ROWS} SELECT l.sid, coalesce(string_agg('word_' || mode, ' ' ORDER BY pos), 'word_null') AS mode_text
    FROM plan_lists l LEFT JOIN plan_rows r ON l.sid = r.sid GROUP BY l.sid""",
)
def ordered_text(spark, sf):
    plans = plans_json.numeric_plans(plans_json.parse_plans(F.col("plans")))
    return X.plan_lists(spark, sf).select("sid", plans_json.list_text(F.transform(plans, lambda p: p["mode"])).alias("mode_text"))


@query(
    "a10_multi_hot",
    f"WITH {X.PLAN_ITEMS} SELECT sid, {', '.join(f'max((mode = {i})::INTEGER) AS mode_feas_{i}' for i in range(12))} FROM items GROUP BY sid",
)
def multi_hot(spark, sf):
    return A.multi_hot(X.plan_items(spark, sf), ["sid"], "mode", 12)


_SLOTS = f"""WITH {X.PLAN_ITEMS}, slots AS (SELECT *, CAST(floor((hour(req_time) * 60 + minute(req_time)) / 30) AS INTEGER) AS slot,
  price * 100 / nullif(distance, 0)::DOUBLE AS unit_price
  FROM items JOIN (SELECT o_orderkey, o_orderdate + to_seconds((o_orderkey * 7919) % 86400) AS req_time FROM orders) ON sid = o_orderkey)"""


def _slotted(spark, sf):
    times = X.sessions(spark, sf).select("sid", "req_time")
    rows = X.plan_items(spark, sf).join(times, "sid")
    slot = F.floor((F.hour("req_time") * 60 + F.minute("req_time")) / 30).cast("int")
    unit = F.col("price") * 100 / F.nullif(F.col("distance"), F.lit(0))
    return rows.withColumn("slot", slot).withColumn("unit_price", unit)


@query(
    "a11_grouped_median_impute",
    _SLOTS + """ SELECT sid, line, l_partkey, l_suppkey, round(coalesce(unit_price, median(unit_price) OVER (PARTITION BY mode, slot)), 6) AS unit_price FROM slots""",
)
def grouped_median(spark, sf):
    done = A.impute_group_median(_slotted(spark, sf), ["mode", "slot"], "unit_price")
    return done.select("sid", *X.ITEM_ORDER, *r6("unit_price"))


@query(
    "a12_ratio_of_means",
    f"WITH {X.PLAN_ITEMS} SELECT mode, round(avg(distance) / avg(eta), 6) AS ratio FROM items GROUP BY mode",
)
def ratio_of_means(spark, sf):
    return A.ratio_of_means(X.plan_items(spark, sf), ["mode"], "distance", "eta").select("mode", *r6("ratio"))


@query(
    "a13_pivot_mean",
    f"""WITH {X.HISTORY}, see AS (SELECT pid, mode, count(*) AS n FROM hist GROUP BY 1, 2)
    SELECT pid, {', '.join(f'round(avg(CASE WHEN mode = {i} THEN n END), 6) AS mode_{i}' for i in range(5))} FROM see GROUP BY pid""",
)
def pivot_mean(spark, sf):
    see = X.history_filled(spark, sf).groupBy("pid", "mode").agg(F.count(F.lit(1)).alias("n"))
    done = A.pivot_mean(see, "pid", "mode", "n", list(range(5)))
    return done.select("pid", *[F.round(F.col(str(i)), 6).alias(f"mode_{i}") for i in range(5)])


@query(
    "a14_share_of_total",
    f"""WITH {X.HISTORY}, see AS (SELECT pid, mode, count(*) AS cnt FROM hist GROUP BY 1, 2), tot AS (SELECT *, sum(cnt) OVER (PARTITION BY pid)::BIGINT AS total FROM see)
    SELECT pid, mode, cnt, total, round(cnt / total, 6) AS share FROM tot""",
)
def share_of_total(spark, sf):
    done = A.share_of_total(X.history_filled(spark, sf), ["pid"], "mode")
    return done.select("pid", "mode", "cnt", "total", *r6("share"))


@query(
    "a14_repeat_counts",
    f"""WITH {X.HISTORY}, see AS (SELECT pid, mode, count(*) AS cnt FROM hist GROUP BY 1, 2), tot AS (SELECT *, sum(cnt) OVER (PARTITION BY pid)::BIGINT AS total FROM see)
    SELECT {', '.join(f'count(*) FILTER (total > {t} AND cnt > 1) AS repeated_over_{t}, count(*) FILTER (total > {t} AND cnt <= 1) AS single_over_{t}' for t in (3, 4, 5))} FROM tot""",
)
def repeat_counts(spark, sf):
    return A.repeat_counts(A.share_of_total(X.history_filled(spark, sf), ["pid"], "mode"))


@query("a15_contains_flag", f"WITH {X.HISTORY} SELECT pid, max(CASE WHEN mode = 0 THEN 1 ELSE -1 END) AS contains FROM hist GROUP BY pid")
def contains_flag(spark, sf):
    return A.contains_flag(X.history_filled(spark, sf), ["pid"], "mode", 0)


@query("a16_group_size", f"WITH {X.HISTORY} SELECT pid, count(*) AS n_rows FROM hist GROUP BY pid")
def group_size(spark, sf):
    return A.group_size(X.history_filled(spark, sf), ["pid"])


_MIX = f"""WITH {X.CLAIMS}, flags AS (SELECT cont1 % 3 AS p0, round(cont2 * 100) % 2 AS p1, round(cont3 * 100) % 2 AS p2, cat1 AS label FROM claims),
long AS (SELECT 'p0' AS profile, p0 AS p_value, label FROM flags UNION ALL SELECT 'p1', p1, label FROM flags UNION ALL SELECT 'p2', p2, label FROM flags),
mix AS (SELECT profile, p_value, label, count(*) AS mode_counts FROM long GROUP BY 1, 2, 3)"""


def _mix(spark, sf):
    rows = X.claims(spark, sf).select(
        (F.col("cont1") % 3).alias("p0"),
        (F.round(F.col("cont2") * 100) % 2).alias("p1"),
        (F.round(F.col("cont3") * 100) % 2).alias("p2"),
        F.col("cat1").alias("label"),
    )
    return A.label_mix(rows, ["p0", "p1", "p2"], "label")


@query("a17_label_mix", _MIX + " SELECT * FROM mix")
def label_mix(spark, sf):
    return _mix(spark, sf)


@query(
    "a17_label_mix_ratio",
    _MIX + """ SELECT profile, round(sum(mode_counts) FILTER (p_value = 0) / sum(mode_counts) FILTER (p_value = 1), 6) AS ratio_all,
    round(sum(mode_counts) FILTER (p_value = 0 AND label = 'A') / sum(mode_counts) FILTER (p_value = 1 AND label = 'A'), 6) AS ratio_inside FROM mix GROUP BY profile""",
)
def label_mix_ratio(spark, sf):
    return A.label_mix_ratio(_mix(spark, sf), "label", "A").select("profile", *r6("ratio_all", "ratio_inside"))


@query(
    "a18_moments",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max FROM lineitem"
        for c in ("l_quantity", "l_discount", "l_tax")
    ),
)
def moments(spark, sf):
    done = A.moments(X.table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
    return done.select("feature", *r6("mean", "std", "min", "max"))


@query(
    "a19_skewness",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg(pow(({c} - m), 3)) / pow(avg(pow({c} - m, 2)), 1.5), 6) AS skewness FROM lineitem, (SELECT avg({c}) AS m FROM lineitem)"
        for c in ("l_quantity", "l_extendedprice", "l_tax")
    ),
)
def skewness(spark, sf):
    return A.skew(X.table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"]).select("feature", *r6("skewness"))


@query(
    "a20_quantile_edges",
    "SELECT " + ", ".join(f"round(quantile_cont(l_extendedprice, {q}), 6) AS q{i}" for i, q in enumerate((0.2, 0.4, 0.6, 0.8))) + " FROM lineitem",
)
def quantile_edges(spark, sf):
    done = A.quantile_edges(X.table(spark, sf, "lineitem"), "l_extendedprice", [0.2, 0.4, 0.6, 0.8])
    return done.select(*r6("q0", "q1", "q2", "q3"))


@query(
    "a21_dedupe_first",
    f"""WITH {X.PLAN_ITEMS}, r AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY line, l_partkey, l_suppkey) AS rn FROM items)
    SELECT sid, distance, price, eta, mode FROM r WHERE rn = 1""",
)
def dedupe_first(spark, sf):
    return A.dedupe(X.plan_items(spark, sf), ["sid"], X.ITEM_ORDER, "first").select("sid", "distance", "price", "eta", "mode")


@query(
    "a21_dedupe_last",
    f"""WITH {X.PLAN_ITEMS}, r AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY line DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM items)
    SELECT sid, distance, price, eta, mode FROM r WHERE rn = 1""",
)
def dedupe_last(spark, sf):
    return A.dedupe(X.plan_items(spark, sf), ["sid"], X.ITEM_ORDER, "last").select("sid", "distance", "price", "eta", "mode")


@query(
    "a22_target_stats",
    f"""WITH {X.CLAIMS}, long AS (SELECT 'cat1' AS feature, cat1 AS value, loss FROM claims UNION ALL SELECT 'cat3', cat3, loss FROM claims)
    SELECT feature, value, round(sum(loss), 2) AS target_sum, count(*) AS cnt FROM long GROUP BY 1, 2""",
)
def target_stats(spark, sf):
    done = A.target_stats(X.claims(spark, sf), ["cat1", "cat3"], "loss")
    return done.select("feature", "value", F.round("target_sum", 2).alias("target_sum"), "cnt")

