"""Row-local work beyond the static features: coded keys, gates, coercion, weighted scaling, grids and source checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import states
from ..sources.io import table
from .base import FACTS, facts, rounded
from .effects import predictions, predictions_sql
from .history import RUNNING, running

LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"]


def state_keys(spark, d):
    """A joined state key, and mean, maximum and entropy over the shares a line has; a share of 0 counts as missing."""
    f = table(spark, d, "lineitem", [*LINE, "l_returnflag", "l_linestatus", "l_discount", "l_tax", "l_quantity"])
    shares = F.array(F.nullif("l_discount", F.lit(0.0)), F.nullif("l_tax", F.lit(0.0)), F.col("l_quantity") / 50)
    there = F.filter(shares, lambda s: s.isNotNull())
    out = f.withColumn("there", there).select(
        *LINE, F.concat_ws("_", "l_returnflag", "l_linestatus", "l_linenumber").alias("state_key"),
        (F.aggregate("there", F.lit(0.0), lambda a, s: a + s) / F.size("there")).alias("row_mean"), F.array_max("there").alias("row_max"), X.entropy(F.col("there")).alias("row_entropy"),
    )
    return rounded(out, "row_mean", "row_max", "row_entropy")


STATE_KEYS_SQL = """WITH s AS (SELECT *, list_filter([nullif(l_discount, 0), nullif(l_tax, 0), l_quantity / 50], lambda x: x IS NOT NULL) AS there FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, l_returnflag || '_' || l_linestatus || '_' || l_linenumber AS state_key, round(list_sum(there) / len(there), 6) AS row_mean,
  round(list_max(there), 6) AS row_max, round(-list_sum(list_transform(there, lambda x: x / list_sum(there) * ln(x / list_sum(there)))), 6) AS row_entropy FROM s"""


def category_text(spark, d):
    """Categories as text with a level of their own for missing ones, counted."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("__MISSING__"))
    f = table(spark, d, "lineitem", ["l_linenumber", "l_returnflag"])
    return f.groupBy(text(F.nullif("l_linenumber", F.lit(7))).alias("number"), text(F.nullif("l_returnflag", F.lit("N"))).alias("flag")).agg(F.count("*").alias("lines"))


CATEGORY_TEXT_SQL = "SELECT coalesce(nullif(l_linenumber, 7)::VARCHAR, '__MISSING__') AS number, coalesce(nullif(l_returnflag, 'N'), '__MISSING__') AS flag, count(*) AS lines FROM lineitem GROUP BY 1, 2"

#: Names under which the sources of the two sides write one thing.
ALIASES = {"MIDDLE EAST": "MEA", "AMERICA": "AMR", "EUROPE": "EUR"}
HANDS = {1: "Left", 2: "Right"}


def named(code: Column, names: dict, other: Column | None = None) -> Column:
    """The name of a code; codes without one keep `other`."""
    found = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[code]
    return found if other is None else F.coalesce(found, other)


def side_keys(spark, d):
    """The key that acts on either side of an open line, the region under its short name, the hand under its label: counts and key checksums."""
    region = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    short = region.select(F.col("s_suppkey").alias("l_suppkey"), named(F.col("r_name"), ALIASES, F.col("r_name")).alias("area"))
    f = table(spark, d, "lineitem", ["l_suppkey", "l_partkey", "l_linestatus", "l_linenumber"]).join(short, "l_suppkey")
    own = F.when(F.col("l_linestatus") == "O", F.col("l_suppkey")).otherwise(F.col("l_partkey"))
    return f.groupBy("area", named(F.col("l_linenumber") % 2 + 1, HANDS).alias("hand"), "l_linestatus").agg(F.count("*").alias("lines"), F.sum(own).alias("keys"))


SIDE_KEYS_SQL = f"""WITH a AS (SELECT s_suppkey AS l_suppkey, CASE r_name {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in ALIASES.items())} ELSE r_name END AS area
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT area, CASE l_linenumber % 2 + 1 WHEN 1 THEN 'Left' WHEN 2 THEN 'Right' END AS hand, l_linestatus, count(*) AS lines, sum(CASE WHEN l_linestatus = 'O' THEN l_suppkey ELSE l_partkey END)::BIGINT AS keys
FROM lineitem JOIN a USING (l_suppkey) GROUP BY 1, 2, 3"""


def gated(p: Column, base: Column, gate: Column) -> Column:
    """The corrected prediction where the gate holds, the base elsewhere and where the gate is null."""
    return F.when(gate, p).otherwise(base)


def uncertain(p: Column, radius: float) -> Column:
    return F.abs(p - 0.5) < radius


def regime_gates(spark, d):
    """Brier scores with the correction on open lines alone, on uncertain lines alone (base within .17 of a half), and on both."""
    p = predictions(spark, d)
    is_open, near = F.col("l_linestatus") == "O", uncertain(F.col("base"), 0.17)
    score = lambda gate: F.round(F.avg(F.pow(gated(F.col("p"), F.col("base"), gate) - F.col("target"), 2)), 9)
    return p.groupBy("season").agg(score(is_open).alias("open"), score(near).alias("uncertain"), score(is_open & near).alias("both"), F.count_if(near).alias("n_uncertain"))


GATES_SQL = f"WITH {predictions_sql()} SELECT season, " + ", ".join(
    f"round(avg((CASE WHEN {gate} THEN p ELSE base END - target) ** 2), 9) AS {name}"
    for gate, name in (("l_linestatus = 'O'", "open"), ("abs(base - 0.5) < 0.17", "uncertain"), ("l_linestatus = 'O' AND abs(base - 0.5) < 0.17", '"both"'))
) + ", count(*) FILTER (abs(base - 0.5) < 0.17) AS n_uncertain FROM predicted GROUP BY 1"


def coerced_numbers(spark, d):
    """Text read as numbers, what is none becoming null: of each event type the count, the good ones and their sum."""
    e = table(spark, d, "events", ["event_type", "props", "user_id"])
    raw = F.when(F.col("user_id") % 7 == 0, F.col("event_type")).otherwise(F.get_json_object("props", "$.k"))
    e = e.withColumn("number", raw.try_cast("double"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count("number").alias("good"), F.sum("number").alias("total"))


COERCED_SQL = """WITH e AS (SELECT event_type, try_cast(CASE WHEN user_id % 7 = 0 THEN event_type ELSE json_extract_string(props, '$.k') END AS DOUBLE) AS number FROM events)
SELECT event_type, count(*) AS n, count(number) AS good, sum(number) AS total FROM e GROUP BY 1"""


def weighted_scaled(spark, d):
    """Discount less its weighted mean over its weighted deviation, of the lines that have one (0 counts as missing, scaled to 0): mean and squares by year."""
    f = facts(spark, d, "l_discount", "l_quantity").withColumn("x", F.nullif("l_discount", F.lit(0.0)))
    w = F.when(F.col("x").isNotNull(), F.col("l_quantity"))
    sums = f.agg(F.sum(w).alias("w"), F.sum(w * F.col("x")).alias("wx"), F.sum(w * F.col("x") * F.col("x")).alias("wxx"))  # one row
    mean = F.col("wx") / F.col("w")
    scaled = F.coalesce((F.col("x") - mean) / F.sqrt(F.col("wxx") / F.col("w") - mean * mean), F.lit(0.0))
    out = f.crossJoin(F.broadcast(sums)).withColumn("z", scaled)
    return rounded(out.groupBy("season").agg(F.avg("z").alias("mean_z"), F.avg(F.col("z") * F.col("z")).alias("mean_zz"), F.count_if(F.col("x").isNull()).alias("missing")), "mean_z", "mean_zz")


WEIGHTED_SQL = f"""WITH {FACTS}, x AS (SELECT season, l_quantity AS w, nullif(l_discount, 0) AS x FROM f),
s AS (SELECT sum(w * x) / sum(w) FILTER (x IS NOT NULL) AS m, sum(w * x * x) / sum(w) FILTER (x IS NOT NULL) AS q FROM x),
z AS (SELECT season, x, coalesce((x - m) / sqrt(q - m * m), 0) AS z FROM x, s)
SELECT season, round(avg(z), 6) AS mean_z, round(avg(z * z), 6) AS mean_zz, count(*) FILTER (x IS NULL) AS missing FROM z GROUP BY 1"""


def profile_scaled(spark, d):
    """Profiles of supplier and year, missing parts set to the mean, standardised by the population's deviation."""
    f = facts(spark, d, "l_discount", "l_extendedprice", "l_quantity")
    late = F.when(F.col("l_linenumber") > 5, F.col("l_discount"))
    p = f.groupBy("l_suppkey", "season").agg(F.avg(late).alias("late_discount"), (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price"))
    names = ["late_discount", "price"]
    stats = p.agg(*[F.avg(c).alias(f"m_{c}") for c in names])  # one row
    filled = p.crossJoin(F.broadcast(stats)).withColumns({c: F.coalesce(c, f"m_{c}") for c in names})
    spread = filled.agg(*[F.stddev_pop(c).alias(f"s_{c}") for c in names])
    return rounded(filled.crossJoin(F.broadcast(spread)).select("l_suppkey", "season", *[((F.col(c) - F.col(f"m_{c}")) / F.nullif(f"s_{c}", F.lit(0.0))).alias(c) for c in names]), *names)


PROFILE_SCALED_SQL = f"""WITH {FACTS}, p AS (SELECT l_suppkey, season, avg(l_discount) FILTER (l_linenumber > 5) AS a, sum(l_extendedprice) / sum(l_quantity) AS b FROM f GROUP BY 1, 2),
m AS (SELECT avg(a) AS ma, avg(b) AS mb FROM p), q AS (SELECT l_suppkey, season, coalesce(a, ma) AS a, b, ma, mb FROM p, m), s AS (SELECT stddev_pop(a) AS sa, stddev_pop(b) AS sb FROM q)
SELECT l_suppkey, season, round((a - ma) / sa, 6) AS late_discount, round((b - mb) / sb, 6) AS price FROM q, s"""


def bounded_steps(spark, d):
    """Brier scores of the base moved by at most .03 * weight, through tanh of the scaled correction."""
    p = predictions(spark, d)
    raw = (F.col("p") - F.col("base")) / 0.03
    cols = [F.round(F.avg(F.pow(X.bounded_step(F.col("base"), raw, w, 0.03) - F.col("target"), 2)), 9).alias(f"w{i}") for i, w in enumerate((0.25, 0.5, 1.0))]
    return p.groupBy("season").agg(*cols)


STEPS_SQL = f"WITH {predictions_sql()} SELECT season, " + ", ".join(
    f"round(avg((least(greatest(base + {w} * 0.03 * tanh((p - base) / 0.03), 0), 1) - target) ** 2), 9) AS w{i}" for i, w in enumerate((0.25, 0.5, 1.0))) + " FROM predicted GROUP BY 1"


def class_representation(spark, d):
    """Class shares of each supplier as differences, a sum and their entropy."""
    f = facts(spark, d)
    share = lambda flag: F.avg((F.col("l_returnflag") == flag).cast("int"))
    s = f.groupBy("l_suppkey").agg(*[share(x).alias(x) for x in "ANR"])
    r, n, a = F.col("R"), F.col("N"), F.col("A")
    return rounded(s.select("l_suppkey", (r - a).alias("r_less_a"), (r - n).alias("r_less_n"), (r + a).alias("r_and_a"), X.entropy(F.array(a, n, r)).alias("entropy")), "r_less_a", "r_less_n", "r_and_a", "entropy")


CLASS_SQL = f"""WITH {FACTS}, s AS (SELECT l_suppkey, avg((l_returnflag = 'A')::INTEGER) AS a, avg((l_returnflag = 'N')::INTEGER) AS n, avg((l_returnflag = 'R')::INTEGER) AS r FROM f GROUP BY 1)
SELECT l_suppkey, round(r - a, 6) AS r_less_a, round(r - n, 6) AS r_less_n, round(r + a, 6) AS r_and_a,
  round(-(CASE WHEN a > 0 THEN a * ln(a) ELSE 0 END + CASE WHEN n > 0 THEN n * ln(n) ELSE 0 END + CASE WHEN r > 0 THEN r * ln(r) ELSE 0 END), 6) AS entropy FROM s"""


def entity_view(f: DataFrame, key: str) -> DataFrame:
    """The rows as seen from one kind of entity: its key under the common name."""
    return f.select(F.lit(key).alias("kind"), F.col(key).cast("long").alias("entity"), "season", "target")


def entity_views(spark, d):
    """One aggregate for suppliers and for parts, through views of the same columns."""
    f = facts(spark, d, "l_partkey")
    both = entity_view(f, "l_suppkey").unionByName(entity_view(f, "l_partkey"))
    cells = both.groupBy("kind", "season", "entity").agg(F.count("*").alias("n"), F.avg("target").alias("rate"))
    return rounded(cells.groupBy("kind", "season").agg(F.count("*").alias("entities"), F.max("n").alias("most"), F.avg("rate").alias("mean_rate")), "mean_rate")


VIEWS_SQL = f"""WITH {FACTS}, v AS (SELECT 'l_suppkey' AS kind, l_suppkey AS entity, season, target FROM f UNION ALL SELECT 'l_partkey', l_partkey, season, target FROM f),
c AS (SELECT kind, season, entity, count(*) AS n, avg(target) AS rate FROM v GROUP BY 1, 2, 3)
SELECT kind, season, count(*) AS entities, max(n) AS most, round(avg(rate), 6) AS mean_rate FROM c GROUP BY 1, 2"""


def allowed(df: DataFrame, wanted: list[str], forbidden: str) -> DataFrame:
    """Only the wanted columns; one that matches the forbidden pattern is an error, a missing one too."""
    import re

    bad = [c for c in wanted if re.search(forbidden, c)] + [c for c in wanted if c not in df.columns]
    if bad:
        raise ValueError(f"columns not allowed or not there: {bad}")
    return df.select(*wanted)


def allowed_columns(spark, d):
    """Customers by the columns a model may see."""
    return allowed(table(spark, d, "customer"), ["c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal"], r"target|label|_name$")


def state_deltas(spark, d):
    """A supplier's last year against all years before, times its reliability, in units of .05, within 3: of each year that has both."""
    f = facts(spark, d)
    last = states.prior_sums(f, ["l_suppkey"], F.col("target"), width=1).select("l_suppkey", "season", F.col("s").alias("s1"), F.col("n").alias("n1"))
    j = states.prior_sums(f, ["l_suppkey"], F.col("target")).join(last, ["l_suppkey", "season"]).where("n > 0 and n1 > 0")
    delta = (F.col("s1") / F.col("n1") - F.col("s") / F.col("n")) * F.col("n1") / (F.col("n1") + 50.0) / 0.05
    return rounded(j.select("l_suppkey", "season", X.clip(delta, -3.0, 3.0).alias("delta")), "delta")


DELTAS_SQL = f"""WITH {FACTS}, c AS (SELECT l_suppkey, season, sum(target) AS s, count(*) AS n FROM f GROUP BY 1, 2),
p AS (SELECT l_suppkey, season, sum(s) OVER w AS s, sum(n) OVER w AS n, sum(s) OVER v AS s1, sum(n) OVER v AS n1 FROM c
  WINDOW w AS (PARTITION BY l_suppkey ORDER BY season RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), v AS (PARTITION BY l_suppkey ORDER BY season RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING))
SELECT l_suppkey, season, round(least(greatest((s1 / n1 - s / n) * n1 / (n1 + 50.0) / 0.05, -3), 3), 6) AS delta FROM p WHERE n > 0 AND n1 > 0"""


def long_design(df: DataFrame, keep: list[str], linear: list[str], context: list[str]) -> DataFrame:
    """A sparse design as rows (keep, column, value): linear terms as they are, zeros left out, and a one for each context level."""
    terms = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in linear]
    terms += [F.struct(F.concat(F.lit(f"{c}="), F.col(c).cast("string")).alias("column"), F.lit(1.0).alias("value")) for c in context]
    return df.select(*keep, F.explode(F.array(*terms)).alias("t")).select(*keep, "t.*").where("value != 0")


def sparse_design(spark, d):
    """Column sums, squares and products with the target of the sparse design of all lines."""
    f = facts(spark, d, "l_discount", "l_tax")
    x = long_design(f, ["target"], ["l_discount", "l_tax"], ["l_linenumber", "l_linestatus"])
    return rounded(x.groupBy("column").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.sum(F.col("value") * F.col("value")).alias("squares"), F.sum(F.col("value") * F.col("target")).alias("product")), "total", "squares", "product")


DESIGN_SQL = f"""WITH {FACTS}, x AS (SELECT target, 'l_discount' AS "column", l_discount AS value FROM f UNION ALL SELECT target, 'l_tax', l_tax FROM f
  UNION ALL SELECT target, 'l_linenumber=' || l_linenumber, 1.0::DOUBLE FROM f UNION ALL SELECT target, 'l_linestatus=' || l_linestatus, 1.0::DOUBLE FROM f)
SELECT "column", count(*) AS n, round(sum(value), 6) AS total, round(sum(value * value), 6) AS squares, round(sum(value * target), 6) AS product FROM x WHERE value != 0 GROUP BY 1"""


def grid_lookup(spark, d):
    """Every supplier in each of the 14 contexts, with its shrunk effect, 0 where it was never seen."""
    f = states.demeaned(facts(spark, d), "target", "residual")
    cell = f.groupBy("l_suppkey", "l_linenumber", "l_linestatus").agg((F.sum("residual") / (F.count("*") + 20.0)).alias("effect"), F.count("*").alias("n"))
    grid = table(spark, d, "supplier", ["s_suppkey"]).select(
        F.col("s_suppkey").alias("l_suppkey"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("l_linenumber")
    ).select("*", F.explode(F.array(F.lit("F"), F.lit("O"))).alias("l_linestatus"))
    out = grid.join(cell, ["l_suppkey", "l_linenumber", "l_linestatus"], "left")
    return rounded(out.select("l_suppkey", "l_linenumber", "l_linestatus", F.coalesce("effect", F.lit(0.0)).alias("effect"), F.coalesce("n", F.lit(0)).alias("n")), "effect")


GRID_SQL = f"""WITH {FACTS}, c AS (SELECT l_suppkey, l_linenumber, l_linestatus, sum(residual) / (count(*) + 20.0) AS effect, count(*) AS n FROM (SELECT *, target - avg(target) OVER (PARTITION BY season) AS residual FROM f) GROUP BY 1, 2, 3),
g AS (SELECT s_suppkey AS l_suppkey, i::INTEGER AS l_linenumber, s AS l_linestatus FROM supplier, (SELECT unnest(range(1, 8)) AS i), (SELECT unnest(['F', 'O']) AS s))
SELECT l_suppkey, l_linenumber, l_linestatus, round(coalesce(effect, 0), 6) AS effect, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (l_suppkey, l_linenumber, l_linestatus)"""


def source_fixture(f: DataFrame, entity: dict[str, int], counts: list[str], target: str, period: str = "season") -> DataFrame:
    """Rows of a period to come with ids no history has: each entity moved by its offset, counts 0, the target dropped."""
    last = f.agg(F.max(period).alias("__last"))  # one row
    moved = f.crossJoin(F.broadcast(last)).withColumns({period: F.col("__last") + 1, **{k: F.col(k) + v for k, v in entity.items()}, **{c: F.lit(0) for c in counts}})
    return moved.drop("__last", target)


def fixture_rows(spark, d):
    """The suppliers' states as rows of an unseen year and unseen ids."""
    f = facts(spark, d).groupBy("l_suppkey", "season").agg(F.count("*").alias("n"), F.sum("target").alias("target"), F.avg("target").alias("rate"))
    return rounded(source_fixture(f, {"l_suppkey": 9_100_000}, ["n"], "target"), "rate")


FIXTURE_SQL = f"""WITH {FACTS} SELECT (l_suppkey + 9100000)::BIGINT AS l_suppkey, ((SELECT max(season) FROM f) + 1)::INTEGER AS season, 0::INTEGER AS n, round(avg(target), 6) AS rate FROM f GROUP BY l_suppkey, f.season"""


def loader_checks(spark, d):
    """What must hold of cumulative states, as counts of rows that break it: a rate only where n > 0, rates within 0 and 1, n never negative, years in order of n."""
    r = running(spark, d)
    rate, n = F.col("rate_before"), F.col("n_before")
    return r.agg(
        F.count("*").alias("n_rows"), F.count_if(rate.isNull() & (n > 0)).alias("missing_rates"), F.count_if(rate.isNotNull() & (n == 0)).alias("early_rates"),
        F.count_if((rate < 0) | (rate > 1)).alias("wild_rates"), F.count_if(n < 0).alias("negative_counts"), F.min("season").alias("first_season"), F.max("season").alias("last_season"),
        F.count_if(n == 0).alias("first_rows"),
    )


LOADER_SQL = f"""WITH {RUNNING} SELECT count(*) AS n_rows, count(*) FILTER (n_before > 0 AND s_before / n_before IS NULL) AS missing_rates, 0::BIGINT AS early_rates,
  count(*) FILTER (n_before > 0 AND (s_before / n_before < 0 OR s_before / n_before > 1)) AS wild_rates, count(*) FILTER (n_before < 0) AS negative_counts, min(season) AS first_season, max(season) AS last_season,
  count(*) FILTER (n_before = 0) AS first_rows FROM r"""


def feature_list(spark, d):
    """The feature columns, read from the schema alone: no row is scanned."""
    fields = table(spark, d, "lineitem").schema.fields
    names = [f.name for f in fields if f.name != "l_returnflag"]
    return spark.createDataFrame(list(enumerate(names)), "place int, name string")


FEATURE_LIST_SQL = "SELECT (row_number() OVER () - 1)::INTEGER AS place, column_name AS name FROM (DESCRIBE SELECT * FROM lineitem) WHERE column_name != 'l_returnflag'"

FEATURE_SETS = {"plain": ["l_discount"], "wide": ["l_discount", "l_tax", "l_quantity"]}


def training_scan(spark, d: str, feature_set: str, side: bool = False, encoded: bool = False, through: int | None = None) -> DataFrame:
    """The training rows with a switch for the features, the side join and the target encoding; only what is asked for is scanned."""
    steps = []
    if through is not None:
        steps.append(lambda f: f.where(F.col("season") <= through))
    if side:
        part = table(spark, d, "part", ["p_partkey", "p_size"])
        steps.append(lambda f: f.join(part, f["l_partkey"] == part["p_partkey"], "left").drop("p_partkey"))
    if encoded:
        steps.append(lambda f: f.join(states.target_encoding(f, ["l_suppkey"], "target"), ["l_suppkey", "season"], "left"))
    f = facts(spark, d, *(["l_partkey"] if side else []), *FEATURE_SETS[feature_set])
    return reduce(lambda f, step: f.transform(step), steps, f)


def training_scans(spark, d):
    """Sums over the widest scan: all features, the side join and the encoding, through 1997."""
    f = training_scan(spark, d, "wide", side=True, encoded=True, through=1997)
    return rounded(f.groupBy("season").agg(F.count("*").alias("n"), F.sum("l_tax").alias("tax"), F.sum("p_size").alias("size"), F.avg("history_rate").alias("history_rate")), "tax", "history_rate")


SCANS_SQL = f"""WITH {FACTS}, m AS (SELECT season, sum(target) AS s, count(*) AS n FROM f WHERE season <= 1997 GROUP BY 1),
b AS (SELECT season, sum(s) OVER w / sum(n) OVER w AS rate FROM m WINDOW w AS (ORDER BY season RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT l_suppkey, season, sum(target) AS s, count(*) AS n FROM f WHERE season <= 1997 GROUP BY 1, 2),
p AS (SELECT l_suppkey, season, n, coalesce(sum(s) OVER w, 0) AS ps, coalesce(sum(n) OVER w, 0) AS pn FROM c WINDOW w AS (PARTITION BY l_suppkey ORDER BY season RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT season, round(sum(n * ((ps + 100.0 * coalesce(rate, 0.5)) / (pn + 100.0))) / sum(n), 6) AS history_rate FROM p LEFT JOIN b USING (season) GROUP BY 1)
SELECT season, count(*) AS n, round(sum(l_tax), 6) AS tax, sum(p_size)::BIGINT AS size, any_value(history_rate) AS history_rate FROM f LEFT JOIN part ON l_partkey = p_partkey JOIN h USING (season) GROUP BY 1"""

QUERIES = {
    "state_keys": state_keys, "category_text": category_text, "side_keys": side_keys, "regime_gates": regime_gates, "coerced_numbers": coerced_numbers, "weighted_scaled": weighted_scaled,
    "profile_scaled": profile_scaled, "bounded_steps": bounded_steps, "class_representation": class_representation, "entity_views": entity_views, "allowed_columns": allowed_columns,
    "state_deltas": state_deltas, "sparse_design": sparse_design, "grid_lookup": grid_lookup, "fixture_rows": fixture_rows, "loader_checks": loader_checks, "feature_list": feature_list, "training_scans": training_scans,
}
ORACLES = {
    "state_keys": STATE_KEYS_SQL, "category_text": CATEGORY_TEXT_SQL, "side_keys": SIDE_KEYS_SQL, "regime_gates": GATES_SQL, "coerced_numbers": COERCED_SQL, "weighted_scaled": WEIGHTED_SQL,
    "profile_scaled": PROFILE_SCALED_SQL, "bounded_steps": STEPS_SQL, "class_representation": CLASS_SQL, "entity_views": VIEWS_SQL, "allowed_columns": "SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal FROM customer",
    "state_deltas": DELTAS_SQL, "sparse_design": DESIGN_SQL, "grid_lookup": GRID_SQL, "fixture_rows": FIXTURE_SQL, "loader_checks": LOADER_SQL, "feature_list": FEATURE_LIST_SQL, "training_scans": SCANS_SQL,
}
