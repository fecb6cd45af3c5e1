"""Registration of queries with their SQL, and the tables and SQL fragments they share."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causetrace.functions.shared import settled
from causetrace.operators import detect, prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
STEP = "6 hours"
#: Tables that several parts of the query being built use: each is computed once a query.
_SHARED: dict[tuple, DataFrame] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name."""

    def put(f):
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            _SHARED.clear()
            try:
                return f(spark, sf_dir)
            finally:
                _SHARED.clear()

        QUERIES[f.__name__] = run
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def once(f):
    """The result of ``f(spark, sf_dir)`` is written once for each query and read by all its parts."""

    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (f.__name__, sf_dir, spark.sparkContext.applicationId)
        if key not in _SHARED:
            _SHARED[key] = settled(f(spark, sf_dir), f.__name__)
        return _SHARED[key]

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entity():
    """Users in groups of 75 stand for services, so services grow with the data."""
    return F.concat(F.lit("e"), F.floor(F.col("user_id") / 75).cast("string"))


def samples(spark, d) -> DataFrame:
    return table(spark, d, "events").select(entity().alias("entity"), F.col("event_type").alias("metric"), F.col("ts").cast("timestamp_ntz").alias("ts"), "value", F.col("event_id").alias("seq"))


def binned(spark, d) -> DataFrame:
    return prepare.bin_mean(samples(spark, d), STEP)


def grid(spark, d) -> DataFrame:
    return prepare.reindex_grid(binned(spark, d), STEP)


def filled(spark, d) -> DataFrame:
    return prepare.fill_gaps(grid(spark, d))


@once
def settled_filled(spark, d) -> DataFrame:
    return filled(spark, d)


def parts(spark, d) -> tuple[DataFrame, DataFrame]:
    """(normal, incident): the first 70 % of every series, and the rest."""
    all_ = settled_filled(spark, d).withColumn("__n", prepare.split_normal(F.col("pos")))
    return all_.where("__n").drop("__n"), all_.where("not __n").drop("__n")


def scored(spark, d) -> DataFrame:
    """Statistical scores of the incident part against baselines of the normal part."""
    normal, incident = parts(spark, d)
    # sign-ups are new: they have no baseline in services whose number ends in 3
    known = detect.fit_baselines(normal).where(~((F.col("metric") == "signup") & F.col("entity").endswith("3")))
    return detect.statistical_scores(incident, known).withColumn("score", F.round("stat", 6))


@once
def incidents(spark, d) -> DataFrame:
    """An incident for each entity; a score over 0.4 is a flag."""
    return detect.summarise_incident(scored(spark, d).withColumn("is_anomaly", F.col("score") > 0.4))


def series(spark, d) -> DataFrame:
    return settled_filled(spark, d).select(F.col("entity").alias("incident_id"), "metric", "ts", "pos", "value")


@once
def lagged_edges(spark, d) -> DataFrame:
    """Edges by correlation with the cause's last bin; strength and p are simple stand-ins that SQL can follow."""
    s = series(spark, d)
    x = s.select("incident_id", F.col("metric").alias("cause"), (F.col("pos") + 1).alias("pos"), F.col("value").alias("x"))
    y = s.select("incident_id", F.col("metric").alias("effect"), "pos", F.col("value").alias("y"))
    r = x.join(y, ["incident_id", "pos"]).where("cause <> effect").groupBy("incident_id", "cause", "effect").agg(F.round(F.abs(F.corr("x", "y")), 6).alias("strength"))
    return r.where("strength > 0.05").select("incident_id", "cause", "effect", "strength", F.round(1 - F.col("strength"), 6).alias("p_value"), F.lit(1).alias("lag"))


def dag_edges(spark, d) -> DataFrame:
    """An acyclic graph for what needs one: of each pair of metrics the edge by name."""
    return lagged_edges(spark, d).where("cause < effect")


@once
def nodes(spark, d) -> DataFrame:
    return series(spark, d).groupBy("incident_id", "metric").agg(F.round(F.max("value") / 100, 6).alias("anomaly_score"))


@once
def first_seen(spark, d) -> DataFrame:
    """When each metric first exceeded its own mean by 20 %."""
    s = series(spark, d)
    m = s.groupBy("incident_id", "metric").agg(F.round(F.avg("value") * 1.2, 4).alias("lim"))
    return s.join(m, ["incident_id", "metric"]).where(F.round("value", 4) > F.col("lim")).groupBy("incident_id", "metric").agg(F.min("ts").alias("first_seen"))


def deployments(spark, d) -> DataFrame:
    """Every sign-up is a deployment."""
    return _deployments(table(spark, d, "events").where("event_type = 'signup'"))


def major_releases(spark, d) -> DataFrame:
    """Deployments of a value over 90 change what is normal."""
    return _deployments(table(spark, d, "events").where("event_type = 'signup' and value > 90"))


def _deployments(e: DataFrame) -> DataFrame:
    return e.select(entity().alias("entity"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.concat(F.lit("release "), F.col("event_id").cast("string")).alias("description"), F.lit("deployment").alias("type"))


def traces(spark, d) -> DataFrame:
    """An order is a trace: a root span in the customer's nation, a child span for each line in the supplier's."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    root = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", F.col("n_name").alias("home"))
    ref = "array<struct<refType:string,spanID:string>>"
    child = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    span = F.struct(
        F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("spanID"), F.concat(F.lit("p_"), F.col("n_name")).alias("processID"), F.floor("l_extendedprice").cast("long").alias("duration"),
        F.array(F.struct(F.lit("CHILD_OF").alias("refType"), F.lit("root").alias("spanID"))).cast(ref).alias("references"),
    )
    lines = child.groupBy("l_orderkey").agg(F.collect_list(span).alias("spans"), F.collect_set("n_name").alias("names"))
    got = root.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    first = F.struct(F.lit("root").alias("spanID"), F.lit("p0").alias("processID"), F.lit(0).cast("long").alias("duration"), F.array().cast(ref).alias("references"))
    service = lambda x: F.struct(x.alias("serviceName"))
    processes = F.map_concat(F.create_map(F.lit("p0"), service(F.col("home"))), F.map_from_arrays(F.transform("names", lambda x: F.concat(F.lit("p_"), x)), F.transform("names", service)))
    return got.select(F.col("o_orderkey").cast("string").alias("traceID"), F.concat(F.array(first), F.col("spans")).alias("spans"), processes.alias("processes"))


S = "s AS (SELECT 'e' || (user_id // 75) AS entity, event_type AS metric, ts, value, event_id AS seq FROM events)"
BINNED = S + ", binned AS (SELECT entity, metric, time_bucket(INTERVAL '6 hours', ts) AS ts, avg(value) AS value FROM s GROUP BY ALL)"
GRID = BINNED + """, span AS (SELECT entity, min(ts) AS lo, max(ts) AS hi FROM binned GROUP BY 1), names AS (SELECT DISTINCT entity, metric FROM binned),
times AS (SELECT n.entity, n.metric, unnest(generate_series(lo, hi, INTERVAL '6 hours')) AS ts FROM names n JOIN span USING (entity)),
grid AS (SELECT t.entity, t.metric, t.ts, b.value, row_number() OVER (PARTITION BY t.entity, t.metric ORDER BY t.ts) - 1 AS pos FROM times t LEFT JOIN binned b USING (entity, metric, ts))"""
MARKS = """marks AS (SELECT *, last_value(value IGNORE NULLS) OVER p AS vp, last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER p AS pp,
first_value(value IGNORE NULLS) OVER q AS vq, first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER q AS pq FROM grid
WINDOW p AS (PARTITION BY entity, metric ORDER BY ts ROWS UNBOUNDED PRECEDING), q AS (PARTITION BY entity, metric ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""
FILL = """filled AS (SELECT entity, metric, ts, pos, CASE WHEN value IS NOT NULL THEN value WHEN vp IS NULL AND vq IS NULL THEN 0 WHEN vq IS NULL THEN vp WHEN vp IS NULL THEN vq
ELSE vp + (vq - vp) * least(pos - pp, 6) / (pq - pp) END AS value FROM marks)"""
FILLED = f"{GRID}, {MARKS}, {FILL}"
PARTS = FILLED + """, halves AS (SELECT *, pos < 0.7 * count(*) OVER (PARTITION BY entity, metric) AS is_normal FROM filled),
normal AS (SELECT * FROM halves WHERE is_normal), incident AS (SELECT * FROM halves WHERE NOT is_normal)"""
BASE = PARTS + """, b1 AS (SELECT entity, metric, median(value) AS med, avg(value) AS mean, greatest(coalesce(stddev_samp(value), 0), 1e-8) AS std, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM normal GROUP BY 1, 2),
b2 AS (SELECT n.entity, n.metric, greatest(median(abs(value - med)), 1e-8) AS mad FROM normal n JOIN b1 USING (entity, metric) GROUP BY 1, 2), base AS (SELECT * FROM b1 JOIN b2 USING (entity, metric))"""
STAT = BASE + """, stat0 AS (SELECT i.entity, i.metric, i.ts, i.pos, i.value, CASE WHEN mean IS NULL THEN 0 ELSE least(abs(value - mean) / std / 3, 1) END AS zscore, CASE WHEN mean IS NULL THEN 0 ELSE least(abs(value - med) / (1.4826 * mad) / 3.5, 1) END AS mad_score,
CASE WHEN q1 IS NULL THEN 0 WHEN value < q1 - 1.5 * greatest(q3 - q1, 1e-8) THEN least((q1 - 1.5 * greatest(q3 - q1, 1e-8) - value) / greatest(q3 - q1, 1e-8), 1)
WHEN value > q3 + 1.5 * greatest(q3 - q1, 1e-8) THEN least((value - q3 - 1.5 * greatest(q3 - q1, 1e-8)) / greatest(q3 - q1, 1e-8), 1) ELSE 0 END AS iqr_score
FROM incident i LEFT JOIN (SELECT * FROM base WHERE NOT (metric = 'signup' AND right(entity, 1) = '3')) USING (entity, metric)), stat AS (SELECT *, greatest(zscore, mad_score, iqr_score) AS stat, round(greatest(zscore, mad_score, iqr_score), 6) AS score FROM stat0)"""
INCIDENTS = STAT + """, incidents AS (SELECT entity AS incident_id, metric, max(score) AS max_score, min(CASE WHEN score > 0.4 THEN ts END) AS first_seen FROM stat GROUP BY 1, 2 HAVING first_seen IS NOT NULL)"""
SERIES = FILLED + ", series AS (SELECT entity AS incident_id, metric, ts, pos, value FROM filled)"
EDGES = SERIES + """, edges0 AS (SELECT x.incident_id, x.metric AS cause, y.metric AS effect, round(abs(corr(x.value, y.value)), 6) AS strength FROM series x JOIN series y ON x.incident_id = y.incident_id AND x.pos + 1 = y.pos AND x.metric <> y.metric GROUP BY 1, 2, 3),
edges AS (SELECT *, round(1 - strength, 6) AS p_value, 1 AS lag FROM edges0 WHERE strength > 0.05)"""
NODES = ", nodes AS (SELECT incident_id, metric, round(max(value) / 100, 6) AS anomaly_score FROM series GROUP BY 1, 2)"
SEEN = """, lim AS (SELECT incident_id, metric, round(avg(value) * 1.2, 4) AS lim FROM series GROUP BY 1, 2),
seen AS (SELECT s.incident_id, s.metric, min(ts) AS first_seen FROM series s JOIN lim USING (incident_id, metric) WHERE round(value, 4) > lim GROUP BY 1, 2)"""
DAG = EDGES.replace("WHERE strength > 0.05)", "WHERE strength > 0.05 AND cause < effect)")
GRAPH = EDGES + NODES + SEEN
CLOSED = ", closure AS (SELECT incident_id, cause AS src, effect AS dst FROM edges UNION SELECT c.incident_id, c.src, e.effect FROM closure c JOIN edges e ON c.incident_id = e.incident_id AND c.dst = e.cause)"
DEPLOY = "deployments AS (SELECT 'e' || (user_id // 75) AS entity, ts, 'release ' || event_id AS description, 'deployment' AS type FROM events WHERE event_type = 'signup')"
MAJOR = DEPLOY.replace("'signup')", "'signup' AND value > 90)")
TOPOLOGY = """topology AS (SELECT h.n_name AS src, t.n_name AS dst, count(*) AS weight, avg(floor(l_extendedprice)) / 1000 AS avg_latency_ms FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation h ON c_nationkey = h.n_nationkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation t ON s_nationkey = t.n_nationkey WHERE h.n_name <> t.n_name GROUP BY 1, 2)"""
