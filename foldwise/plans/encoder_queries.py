"""Registered queries: encoders and whole feature blocks."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from foldwise.encoders import blocks, categorical as C, numeric as N, projection as V
from foldwise.encoders.stages import EncoderStage
from foldwise.plans import fixtures as X
from foldwise.plans.history_queries import _BEST, _HAVERSINE, _SINCE, _STOPPED, erfinv_sql
from foldwise.plans.registry import query, r6
from foldwise.session import shared_folder
from foldwise.sources.tables import roles

CATS = X.CLAIM_CATS
_CLAIMS = f"WITH {X.CLAIMS}"


def _codes_sql(order: str) -> str:
    dictionaries = ", ".join(
        f"d_{c} AS (SELECT {c}, CAST(row_number() OVER (ORDER BY {order.format(c)}) - 1 AS INTEGER) AS {c}_code FROM (SELECT DISTINCT {c} FROM claims))"
        for c in CATS
    )
    joins = " ".join(f"JOIN d_{c} USING ({c})" for c in CATS)
    return f"{_CLAIMS}, {dictionaries} SELECT id, {', '.join(f'{c}_code' for c in CATS)} FROM claims {joins}"


@query("e1_ordinal_len_lexical", _codes_sql("length({0}), {0}"))
def ordinal(spark, sf):
    rows = X.claims(spark, sf)
    model = C.OrdinalEncode(CATS, key="id").fit(rows)
    return model.transform(rows).select("id", *model.feature_names())


@query("e2_label_lexical", _codes_sql("{0}"))
def label(spark, sf):
    rows = X.claims(spark, sf)
    model = C.label_encode(CATS, key="id").fit(rows)
    return model.transform(rows).select("id", *model.feature_names())


@query(
    "e3_frequency",
    f"{_CLAIMS} SELECT id, {', '.join(f'count(*) OVER (PARTITION BY {c}) AS {c}_count' for c in CATS)} FROM claims",
)
def frequency(spark, sf):
    rows = X.claims(spark, sf)
    model = C.FrequencyEncode(CATS, key="id").fit(rows)
    return model.transform(rows).select("id", *model.feature_names())


@query(
    "x3_encoder_pipeline",
    _codes_sql("length({0}), {0}").replace('SELECT id, ', 'SELECT id, ' + ''.join(f'count(*) OVER (PARTITION BY {c}) AS {c}_count, ' for c in CATS)),
)
def encoder_pipeline(spark, sf):
    rows = X.claims(spark, sf)
    stages = [EncoderStage(C.OrdinalEncode(CATS, key="id")), EncoderStage(C.FrequencyEncode(CATS, key="id"))]
    folder = shared_folder(spark, "pipeline")
    Pipeline(stages=stages).fit(rows).save(folder)
    loaded = PipelineModel.load(folder)
    names = [name for stage in loaded.stages for name in stage.feature_names()]
    return loaded.transform(rows).select("id", *names)


@query(
    "e4_frequency_null_level",
    f"WITH {X.BATCHES} SELECT id, count(*) OVER (PARTITION BY coalesce(cat1, '-1')) AS cat1_count, count(*) OVER (PARTITION BY cat2) AS cat2_count FROM batches",
)
def frequency_null(spark, sf):
    rows = X.batches(spark, sf)
    model = C.FrequencyEncode(["cat1", "cat2"], null="-1", key="id").fit(rows)
    return model.transform(rows).select("id", *model.feature_names())


_LEVELS = f"""{_CLAIMS}, wide AS (SELECT id, split, cat3, cat4 || '-' || CAST(CAST(cont1 AS INTEGER) AS VARCHAR) || '-' || cat1 || '-' || CAST(CAST(cont3 * 100 AS INTEGER) AS VARCHAR) AS catx FROM claims),
long AS (SELECT id, split, 'cat3' AS feature, cat3 AS value FROM wide UNION ALL SELECT id, split, 'catx', catx FROM wide),
levels AS (SELECT feature, value, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'test') AS b FROM long GROUP BY 1, 2),
rare AS (SELECT feature, sum(b) > 0 AS in_both FROM levels WHERE a > 0 AND a < 10 GROUP BY 1),
flags AS (SELECT l.feature, value, CASE WHEN a >= 10 THEN l.feature || '_' || value ELSE l.feature || '_rare' END AS flag
          FROM levels l LEFT JOIN rare r ON l.feature = r.feature WHERE a >= 10 OR (a > 0 AND in_both))"""


def _one_hot(spark, sf):
    rows = X.claims(spark, sf)
    wide = F.concat_ws("-", "cat4", F.col("cont1").cast("int").cast("string"), "cat1", F.round(F.col("cont3") * 100).cast("int").cast("string"))
    rows = rows.select("id", "split", "cat3", wide.alias("catx"))
    return rows, C.OneHotRare(["cat3", "catx"], 10, "id").fit(rows.filter("split = 'train'"), rows.filter("split = 'test'"))


@query("e5_one_hot_rare", _LEVELS + " SELECT id, flag, 1 AS value FROM long JOIN flags USING (feature, value)")
def one_hot(spark, sf):
    rows, model = _one_hot(spark, sf)
    return model.transform(rows)


@query("e5_one_hot_vector", _LEVELS + ", hits AS (SELECT id FROM long JOIN flags USING (feature, value)) SELECT w.id, count(h.id) AS n_flags FROM wide w LEFT JOIN hits h ON w.id = h.id GROUP BY w.id")
def one_hot_vector(spark, sf):
    from foldwise.encoders.sparse import total

    rows, model = _one_hot(spark, sf)
    done = model.assemble(rows)
    return done.select("id", total(F.col("flags")).cast("bigint").alias("n_flags"))


_COMBINED = ["cat1", "cat3", "cat1_cat2"]
_MEANS = f"""{_CLAIMS}, rows AS (SELECT id, split, cat1, cat3, cat1 || cat2 AS cat1_cat2, ln(loss + 100) AS t FROM claims),
facts AS (SELECT avg(t) AS m, stddev_samp(t) AS s FROM rows WHERE split = 'train'),
{', '.join(f"s_{c} AS (SELECT {c}, sum(t) AS {c}_s, count(*) AS {c}_n FROM rows WHERE split = 'train' GROUP BY 1)" for c in _COMBINED)},
mapped AS (SELECT * FROM rows CROSS JOIN facts {' '.join(f'LEFT JOIN s_{c} USING ({c})' for c in _COMBINED)})"""


def _target_mean(**kw):
    return C.TargetMean(["cat1", "cat3"], "loss", combinations=[["cat1", "cat2"]], **kw)


@query(
    "e6_target_mean",
    _MEANS + f""" SELECT id, {', '.join(f"round(exp((coalesce({c}_s, 0) + m * 100) / (coalesce({c}_n, 0) + 100)), 2) AS {c}_mean" for c in _COMBINED)} FROM mapped WHERE split = 'test'""",
)
def target_mean(spark, sf):
    rows = X.claims(spark, sf)
    model = _target_mean(noisy=False).fit(rows.filter("split = 'train'"))
    done = model.transform(rows.filter("split = 'test'"))
    return done.select("id", *[F.round(c, 2).alias(c) for c in model.feature_names()])


def _noise_sql(c: str) -> str:
    def unit(tag):
        return f"(({X.md5_sql('id', f'11{c}{tag}')} + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"

    return f"sqrt(-2 * ln({unit('a')})) * cos({2 * math.pi!r} * {unit('b')})"


@query(
    "e6_target_mean_noisy_loo",
    _MEANS + f""" SELECT id, {', '.join(f"round(exp(({c}_s + m * 100 + s * 10 * {_noise_sql(c)} - t) / ({c}_n + 100 - 1)), 2) AS {c}_mean" for c in _COMBINED)} FROM mapped WHERE split = 'train'""",
)
def target_mean_noisy(spark, sf):
    train = X.claims(spark, sf).filter("split = 'train'")
    model = _target_mean(noisy=True, loo=True).fit(train)
    done = model.transform_fitted(train)
    return done.select("id", *[F.round(c, 2).alias(c) for c in model.feature_names()])


def _alpha_sql(x: str) -> str:
    return f"list_reduce(list_prepend(0.0::DOUBLE, list_transform(string_split({x}, ''), lambda c: (ascii(c) - 64)::DOUBLE)), lambda a, d: a * 26 + d)"


@query(
    "e7_alpha",
    f"{_CLAIMS} SELECT id, {_alpha_sql('cat1')} AS cat1_alpha, {_alpha_sql('cat2')} AS cat2_alpha, {_alpha_sql('cat1 || cat2')} AS cat1_cat2_alpha FROM claims",
)
def alpha(spark, sf):
    encoder = C.AlphaEncode(["cat1", "cat2"], [["cat1", "cat2"]])
    return encoder.transform(X.claims(spark, sf)).select("id", *encoder.feature_names())


@query(
    "e8_multi_value",
    """WITH tok AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS token FROM part),
    ranks AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) - 1 AS r FROM tok GROUP BY token)
    SELECT p_partkey, CAST(min(least(r, 6)) AS INTEGER) AS p_name_mv FROM tok JOIN ranks USING (token) GROUP BY p_partkey""",
)
def multi_value(spark, sf):
    rows = X.table(spark, sf, "part").select("p_partkey", "p_name")
    model = C.MultiValueEncode("p_name", 6, " ").fit(rows)
    return model.transform(rows).drop("p_name")


NUMS = X.CLAIM_NUMS


@query(
    "e9_scale",
    f"{_CLAIMS} SELECT id, {', '.join(f'round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}_scaled' for c in NUMS)} FROM claims",
)
def scale(spark, sf):
    rows = X.claims(spark, sf)
    model = N.Scale(NUMS).fit(rows)
    return model.transform(rows).select("id", *r6(*model.feature_names()))


@query(
    "e10_unskew",
    f"""{_CLAIMS}, u AS (SELECT id, cont1, (cont1 - min(cont1) OVER ()) / (max(cont1) OVER () - min(cont1) OVER ()) AS u1, (cont2 - min(cont2) OVER ()) / (max(cont2) OVER () - min(cont2) OVER ()) AS u2, cont3 FROM claims)
    SELECT id, round(sqrt(u1), 6) AS cont1_unskew, round(ln(u2 + 0.1), 6) AS cont2_unskew, round(pow(greatest(cont3 - 0.0179, 0) / 0.0665, 0.25), 6) AS cont3_unskew FROM u""",
)
def unskew(spark, sf):
    rows = X.claims(spark, sf)
    model = N.Unskew({"cont1": "sqrt", "cont2": "log", "cont3": ("root4", 0.0179, 0.0665)}).fit(rows)
    return model.transform(rows).select("id", *r6(*model.feature_names()))


# skewed stand-ins: squares of the quantity and of the tax
_SKEWED = f"{_CLAIMS}, sk AS (SELECT id, cont1 * cont1 AS x1, pow(cont3 * 100, 2) AS x2, cont2 AS x3 FROM claims)"
_GRID = """grid AS (SELECT (i - 200) / 100.0::DOUBLE AS lam FROM range(0, 401) t(i)),
ll AS (SELECT '{c}' AS c, lam, (lam - 1) * sum(ln({c} + 1)) - count(*) / 2.0::DOUBLE * ln(var_pop(CASE WHEN lam = 0 THEN ln({c} + 1) ELSE pow({c} + 1, lam) / lam END)) AS v
  FROM sk CROSS JOIN grid GROUP BY lam)"""


def _lambda_sql(c):
    body = _GRID.replace("grid AS", f"grid_{c} AS").replace("ll AS", f"ll_{c} AS").replace("JOIN grid", f"JOIN grid_{c}").format(c=c)
    return f"{body}, best_{c} AS (SELECT lam AS l_{c} FROM ll_{c} ORDER BY v DESC LIMIT 1)"


def _box_sql(c):
    return f"round(CASE WHEN l_{c} = 0 THEN ln({c} + 1) ELSE (pow({c} + 1, l_{c}) - 1) / l_{c} END, 5) AS {c}_boxcox"


@query(
    "e11_box_cox",
    f"{_SKEWED}, {_lambda_sql('x1')}, {_lambda_sql('x2')} SELECT id, {_box_sql('x1')}, {_box_sql('x2')}, round(x3, 5) AS x3_boxcox FROM sk CROSS JOIN best_x1 CROSS JOIN best_x2",
)
def box_cox(spark, sf):
    rows = X.claims(spark, sf).select(
        "id", (F.col("cont1") * F.col("cont1")).alias("x1"), F.pow(F.col("cont3") * 100, F.lit(2.0)).alias("x2"), F.col("cont2").alias("x3")
    )
    model = N.BoxCoxSkewed(["x1", "x2", "x3"], resolution=0.01).fit(rows)
    return model.transform(rows).select("id", *[F.round(c, 5).alias(c) for c in model.feature_names()])


@query(
    "e12_rank_gauss",
    f"""{_CLAIMS}, ranked AS (SELECT id, {', '.join(f'rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS r_{c}' for c in ('cont1', 'loss'))} FROM claims),
    unit AS (SELECT id, {', '.join(f'(r_{c} - min(r_{c}) OVER ()) / (max(r_{c}) OVER () - min(r_{c}) OVER ()) * 1.998::DOUBLE - 0.999::DOUBLE AS u_{c}' for c in ('cont1', 'loss'))} FROM ranked),
    raw AS (SELECT id, {', '.join(f'{erfinv_sql(f"u_{c}")} AS g_{c}' for c in ('cont1', 'loss'))} FROM unit)
    SELECT id, {', '.join(f'round((g_{c} - avg(g_{c}) OVER ()) / stddev_pop(g_{c}) OVER (), 6) AS {c}_gauss' for c in ('cont1', 'loss'))} FROM raw""",
)
def rank_gauss(spark, sf):
    rows = X.claims(spark, sf).select("id", "cont1", "loss")
    model = N.RankGauss(["cont1", "loss"]).fit(rows)
    return model.transform(rows).select("id", *r6(*model.feature_names()))


@query("e13_truncated_svd")
def truncated_svd(spark, sf):
    rows = X.profiles(spark, sf)
    model = V.TruncatedSvd([f"p{i}" for i in range(X.N_PROFILE)], 10).fit(rows)
    return model.transform(rows).select("pid", *r6(*model.feature_names()))


@query("e13_svd_numeric_and_flags")
def svd_of_flags(spark, sf):
    from pyspark.ml.feature import VectorAssembler

    rows = X.claims(spark, sf)
    numbers = N.Scale(NUMS).fit(rows)
    rows = numbers.transform(rows)
    flags = C.OneHotRare(CATS, 10, "id").fit(rows.filter("split = 'train'"), rows.filter("split = 'test'"))
    wide = VectorAssembler(inputCols=[*numbers.feature_names(), "flags"], outputCol="wide").transform(flags.assemble(rows))
    model = V.TruncatedSvd("wide", 5).fit(wide)
    return model.transform(wide).select("id", *r6(*model.feature_names()))


_CELLS = """WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity AS a, l_discount * 100 AS b, l_tax * 100 AS c FROM lineitem),
g AS (SELECT sum(a * a) AS aa, sum(b * b) AS bb, sum(c * c) AS cc, sum(a * b) AS ab, sum(a * c) AS ac, sum(b * c) AS bc FROM x)"""


@query(
    "e13_svd_keeps_lengths",
    _CELLS
    + """ SELECT l_orderkey, l_linenumber, round(sqrt(a * a + b * b + c * c), 6) AS length,
    round(ln(aa + bb + cc), 6) AS log_energy, round(ln(aa * aa + bb * bb + cc * cc + 2 * (ab * ab + ac * ac + bc * bc)), 6) AS log_spread
    FROM x CROSS JOIN g""",
)
def svd_keeps_lengths(spark, sf):
    """All components: scores have the lengths of the rows, singular values the first two moments of the Gram matrix."""
    percent = [(F.col(c) * 100).alias(n) for c, n in (("l_discount", "b"), ("l_tax", "c"))]
    rows = X.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("a"), *percent)
    model = V.TruncatedSvd(["a", "b", "c"], 3).fit(rows)
    square = [s * s for s in model.params["singular"]]
    length = F.sqrt(sum((F.col(c) * F.col(c) for c in model.feature_names()), F.lit(0.0)))
    return model.transform(rows).select(
        "l_orderkey",
        "l_linenumber",
        F.round(length, 6).alias("length"),
        F.lit(round(math.log(sum(square)), 6)).alias("log_energy"),
        F.lit(round(math.log(sum(s * s for s in square)), 6)).alias("log_spread"),
    )


_PAIR = """WITH x AS (SELECT l_quantity AS a, l_discount * 100 AS b FROM lineitem),
g AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb FROM x),
e AS (SELECT *, (aa + bb) / 2 + sqrt(pow((aa - bb) / 2, 2) + ab * ab) AS l1 FROM g),
v AS (SELECT ab / sqrt(ab * ab + (l1 - aa) * (l1 - aa)) AS va, (l1 - aa) / sqrt(ab * ab + (l1 - aa) * (l1 - aa)) AS vb FROM e)"""


@query(
    "e14_explained_ratio",
    _PAIR + " SELECT round(var_pop(a * va + b * vb) / (var_pop(a) + var_pop(b)), 6) AS ratio FROM x CROSS JOIN v",
)
def explained_ratio(spark, sf):
    rows = X.table(spark, sf, "lineitem").select(F.col("l_quantity").alias("a"), (F.col("l_discount") * 100).alias("b"))
    ratio = V.TruncatedSvd(["a", "b"], 1).fit(rows).explained_ratio(rows)
    return rows.agg(F.lit(round(ratio, 6)).alias("ratio"))


_GRAMS = f"""WITH {X.PLAN_ROWS},
words AS (SELECT sid, pos, 'word_' || mode AS w FROM plan_rows UNION ALL SELECT sid, 1, 'word_null' FROM plan_lists WHERE NOT good),
grams AS (SELECT sid, w AS term FROM words UNION ALL
  SELECT a.sid, a.w || ' ' || b.w FROM words a JOIN words b ON a.sid = b.sid AND b.pos = a.pos + 1),
tf AS (SELECT sid, term, count(*) AS n FROM grams GROUP BY 1, 2),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM plan_lists)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM tf GROUP BY 1),
raw AS (SELECT sid, term, n * idf AS v FROM tf JOIN idf USING (term))"""


@query("e15_tfidf", _GRAMS + " SELECT sid, term, round(v / sqrt(sum(v * v) OVER (PARTITION BY sid)), 6) AS weight FROM raw")
def tfidf(spark, sf):
    from pyspark.ml.functions import vector_to_array

    texts = blocks.plan_features(X.plan_lists(spark, sf), "plans").select("sid", "mode_text")
    model = V.TfidfNgrams("mode_text", (1, 2)).fit(texts)
    done = model.transform(texts).select("sid", F.posexplode(vector_to_array("tfidf")).alias("place", "weight"))
    names = F.array(*[F.lit(t) for t in model.feature_names()])
    return done.filter("weight <> 0").select("sid", F.element_at(names, F.col("place") + 1).alias("term"), *r6("weight"))


@query("e16_cluster_rbf")
def cluster_rbf(spark, sf):
    rows = X.claims(spark, sf)
    numbers = N.Scale(NUMS).fit(rows)
    rows = numbers.transform(rows)
    model = V.ClusterRbf(numbers.feature_names(), (25, 50), max_iter=5).fit(rows)
    done = model.transform(rows)
    return done.select(
        "id", *[F.round(F.array_max(f"cluster_rbf_{k}"), 6).alias(f"best_{k}") for k in (25, 50)], F.size("cluster_rbf_50").alias("width")
    )


# --- whole blocks -------------------------------------------------------------------

def _block_extreme(c, last):
    return (
        f"first(mode ORDER BY {c} DESC, pos {last}) AS max_{c}_mode, first(mode ORDER BY {c}, pos) AS min_{c}_mode, "
        f"max({c}) AS max_{c}, min({c}) AS min_{c}, avg({c}) AS mean_{c}, stddev_pop({c}) AS std_{c}"
    )


_BLOCK = f"""WITH {X.PLAN_ROWS}, z AS (SELECT sid, pos, distance AS dist, coalesce(price, 0) AS price, eta, mode FROM plan_rows),
f AS (SELECT sid, first(mode ORDER BY pos) AS first_mode, string_agg('word_' || mode, ' ' ORDER BY pos) AS mode_text,
  {', '.join(f'max((mode = {i})::INTEGER) AS m{i}' for i in range(12))}, {', '.join(_block_extreme(c, 'DESC') for c in ('dist', 'price', 'eta'))} FROM z GROUP BY sid)
SELECT l.sid, {', '.join(f"coalesce(m{i}, {1 if i == 0 else 0}) AS cat_mode_feas_{i}" for i in range(12))},
  {', '.join(f"round(coalesce({w}_{c}, -1)::DOUBLE, 6) AS num_{w}_{c}" for c in ('dist', 'price', 'eta') for w in ('max', 'min', 'mean', 'std'))},
  {', '.join(f"coalesce({w}_{c}_mode, -1) AS num_{w}_{c}_mode" for c in ('dist', 'price', 'eta') for w in ('max', 'min'))},
  coalesce(first_mode, 0) AS cat_first_mode, coalesce(mode_text, 'word_null') AS mode_text
FROM plan_lists l LEFT JOIN f ON l.sid = f.sid"""


@query("e17_plan_features", _BLOCK)
def plan_features(spark, sf):
    done = blocks.plan_features(X.plan_lists(spark, sf).select("sid", "plans"), "plans").drop("plans")
    floats = [f"num_{w}_{c}" for c in ("dist", "price", "eta") for w in ("max", "min", "mean", "std")]
    return done.select(*[c for c in done.columns if c not in floats], *r6(*floats))


@query("e17_plan_text_components")
def plan_text_components(spark, sf):
    done = blocks.plan_features(X.plan_lists(spark, sf).select("sid", "plans"), "plans").select("sid", "mode_text")
    return blocks.plan_text_components(done, 10).select("sid", *r6(*[f"svd_plan_mode_{i}" for i in range(10)]))


@query(
    "e18_time_features",
    f"""WITH {X.SESSIONS} SELECT sid, CAST(epoch(plan_time) - epoch(req_time) AS BIGINT) AS num_time_diff, CAST(isodow(req_time) - 1 AS INTEGER) AS cat_weekday,
    CASE WHEN isodow(req_time) - 1 BETWEEN 1 AND 5 THEN 0 ELSE 1 END AS cat_is_weekday, CAST(month(req_time) AS INTEGER) AS cat_month, CAST(dayofyear(req_time) AS INTEGER) AS cat_dayofyear,
    CASE WHEN hour(req_time) <= 6 THEN 0 WHEN hour(req_time) <= 12 THEN 1 WHEN hour(req_time) <= 18 THEN 2 ELSE 3 END AS cat_timeofday, CAST(hour(req_time) AS INTEGER) AS cat_hour FROM sessions""",
)
def time_features(spark, sf):
    return blocks.time_features(X.sessions(spark, sf), "req_time", "plan_time").drop("pid", "req_time", "plan_time", "o", "d")


@query(
    "e19_history_features",
    f"""{_STOPPED}, {_SINCE}, last_modes AS (SELECT sid, coalesce(lag(mode) OVER (PARTITION BY pid ORDER BY req_time, sid), 0) AS cat_last_click_mode FROM hist)
    SELECT sid, cat_last_click_mode, CAST(floor(epoch_us(req_time) / 1000000) - floor(epoch_us(last_time) / 1000000) AS BIGINT) AS num_how_long_till_this_time,
    CAST(isodow(last_time) - 1 AS INTEGER) AS cat_last_request_weekday, CAST(hour(last_time) AS INTEGER) AS cat_last_request_hour,
    {', '.join(f"round(CASE WHEN total > 0 THEN n{i}::DOUBLE / total ELSE 0 END, 6) AS cat_mode_num_{i}" for i in range(12))}, CAST({_BEST} AS INTEGER) AS cat_pid_max_mode
    FROM shares JOIN lagged USING (sid) JOIN last_modes USING (sid)""",
)
def history_features(spark, sf):
    done = blocks.history_features(X.history(spark, sf), "pid", "req_time", "sid", "mode")
    shares = [f"cat_mode_num_{i}" for i in range(12)]
    return done.select(
        "sid",
        "cat_last_click_mode",
        "num_how_long_till_this_time",
        "cat_last_request_weekday",
        "cat_last_request_hour",
        "cat_pid_max_mode",
        *r6(*shares),
    )


@query(
    "e20_od_features",
    f"""WITH {X.SESSIONS}, {X.ADDRESSES},  dest AS (SELECT district, CAST(row_number() OVER (ORDER BY district) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT b.district FROM sessions JOIN addresses b ON d = b.lntlat)),
    src AS (SELECT district, CAST(row_number() OVER (ORDER BY district) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT a.district FROM sessions JOIN addresses a ON o = a.lntlat)),
    j AS (SELECT sid, o, d, split_part(o, ',', 1)::DOUBLE AS o1, split_part(o, ',', 2)::DOUBLE AS o2, split_part(d, ',', 1)::DOUBLE AS d1, split_part(d, ',', 2)::DOUBLE AS d2,
      a.adcode AS sa, b.adcode AS da, a.street_number AS sn, b.street_number AS dn, a.district AS sd, b.district AS dd
      FROM sessions JOIN addresses a ON o = a.lntlat JOIN addresses b ON d = b.lntlat)
    SELECT sid, o1 AS num_o1, o2 AS num_o2, d1 AS num_d1, d2 AS num_d2, sa AS cat_source_adcode, da AS cat_des_adcode, (sd = dd)::INTEGER AS cat_same_district,
    (sn = dn)::INTEGER AS cat_same_street_number, (sa = da)::INTEGER AS cat_same_adcode, (o = d)::INTEGER AS cat_same_address, round({_HAVERSINE}, 3) AS num_direct_distance,
    src.code AS cat_source_district, dest.code AS cat_des_district FROM j JOIN src ON sd = src.district JOIN dest ON dd = dest.district""",
)
def od_features(spark, sf):
    done = blocks.od_features(X.sessions(spark, sf), X.addresses(spark, sf), ellipsoid=False)
    return done.drop("pid", "req_time", "plan_time", "o", "d").withColumn("num_direct_distance", F.round("num_direct_distance", 3))


@query("e21_profile_features")
def profile_features(spark, sf):
    done = blocks.profile_features(X.sessions(spark, sf).select("sid", "pid"), X.profiles(spark, sf))
    return done.select("sid", "pid", *r6(*[c for c in done.columns if c not in ("sid", "pid")]))



@query(
    "e21_profile_raw_columns",
    f"""WITH {X.SESSIONS} SELECT sid, coalesce(pid, -1) AS pid, {', '.join(f"CASE WHEN pid IS NULL THEN 0 ELSE embedding[{int(c[1:]) + 1}]::DOUBLE END AS cat_{c}" for c in blocks.RAW_PROFILE)}
    FROM sessions LEFT JOIN embeddings ON pid = vec_id""",
)
def profile_raw_columns(spark, sf):
    done = blocks.profile_features(X.sessions(spark, sf).select("sid", "pid"), X.profiles(spark, sf))
    return done.select("sid", "pid", *[f"cat_{c}" for c in blocks.RAW_PROFILE])


@query("e17_e21_session_table")
def session_table(spark, sf):
    """All blocks together, split into roles by the column prefix."""
    sessions = X.sessions(spark, sf)
    # one plan list per session: the list of the line whose number is smallest
    # a line without an order has no session; the text of a list is made for the chosen lines only
    lines = X.table(spark, sf, "lineitem").filter("l_orderkey is not null").withColumn("line", X.line_key())
    first = lines.groupBy("l_orderkey").agg(F.min_by("line", F.struct("l_linenumber", "line")).alias("line"))
    chosen = X.plan_lists_of(lines.join(first, ["l_orderkey", "line"]), ["l_orderkey"])
    plans = chosen.select(F.col("l_orderkey").alias("sid"), "plans")
    done = blocks.session_features(sessions, plans, X.clicks(spark, sf), X.profiles(spark, sf), X.addresses(spark, sf), ellipsoid=False)
    found = roles(done)
    return done.select("sid", "click_mode", *found["cat"], *found["num"], *[F.round(c, 6).alias(c) for c in found["svd"]])
