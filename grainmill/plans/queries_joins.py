"""Queries over the star schema and conversations: ledgers, effective dates, intervals, calendars, transforms, edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainmill.functions import dates as DT
from grainmill.functions import probability as P
from grainmill.operators import splits as S
from grainmill.plans.registry import register
from grainmill.plans.tables import table
from grainmill.sources import transforms as TR


@register(
    "ledger_tiers",
    """WITH fx AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, 65 + datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) % 95 AS rate FROM orders),
l AS (SELECT c_nationkey, o_custkey, ((200 * CAST(round(o_totalprice * 100) AS BIGINT) + rate) // (2 * rate)) / 100.0 AS eur FROM orders JOIN customer ON o_custkey = c_custkey JOIN fx ON CAST(o_orderdate AS DATE) = day),
t AS (SELECT o_custkey, max(c_nationkey) % 3 = 0 AS elevated, sum(eur) AS total FROM l GROUP BY o_custkey)
SELECT elevated, CAST((total > CASE WHEN elevated THEN 500000 ELSE 1000000 END) AS INTEGER) + CAST((total > CASE WHEN elevated THEN 1500000 ELSE 3000000 END) AS INTEGER) AS tier, count(*) AS n, round(CAST(sum(total) AS DOUBLE), 2) AS eur FROM t GROUP BY 1, 2""",
)
def ledger_tiers(spark, sf_dir):
    """Alias to country override, rate of the day, cents for each line before the sum, threshold tier."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"))
    fx = orders.select("day").distinct().withColumn("rate", (F.lit(0.65) + (F.datediff("day", F.lit("1970-01-01")) % 95) / 100.0).cast("decimal(10,2)"))
    rows = orders.join(fx, "day").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    totals = rows.groupBy("o_custkey").agg((F.max("c_nationkey") % 3 == 0).alias("elevated"), F.sum(F.round(F.col("amount") / F.col("rate"), 2)).alias("total"))
    above = lambda high, low: (F.col("total") > F.when(F.col("elevated"), high).otherwise(low)).cast("int")
    return totals.groupBy("elevated", (above(500000, 1000000) + above(1500000, 3000000)).alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("total").cast("double"), 2).alias("eur"))


@register(
    "window_prior_orders",
    """SELECT a.o_orderkey, count(b.o_orderkey) AS n_prior, round(coalesce(sum(b.o_totalprice), 0), 2) AS prior FROM orders a
LEFT JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey AND datediff('day', CAST(b.o_orderdate AS DATE), CAST(a.o_orderdate AS DATE)) BETWEEN 0 AND 30 GROUP BY a.o_orderkey""",
)
def window_prior_orders(spark, sf_dir):
    """Orders of the same customer up to 30 days before, as a range frame: one sort, no self join."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01")).alias("d"))
    w = Window.partitionBy("o_custkey").orderBy("d").rangeBetween(-30, 0)
    return o.select("o_orderkey", (F.count(F.lit(1)).over(w) - 1).alias("n_prior"), F.round(F.sum("o_totalprice").over(w) - F.col("o_totalprice"), 2).alias("prior"))


@register("effective_rules", "SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) >= DATE '1996-01-01' THEN 0.21 ELSE 0.19 END AS tax, CAST(o_totalprice AS DECIMAL(18,2)) > CASE WHEN CAST(o_orderdate AS DATE) >= DATE '1997-07-01' THEN 150000 ELSE 100000 END AS over_limit FROM orders")
def effective_rules(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    since = lambda d: F.lit(d).cast("date")
    return o.select("o_orderkey", DT.effective("day", since("1996-01-01"), F.lit(0.21), F.lit(0.19)).alias("tax"), (F.col("o_totalprice").cast("decimal(18,2)") > DT.effective("day", since("1997-07-01"), F.lit(150000), F.lit(100000))).alias("over_limit"))


@register(
    "calendar",
    """WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INTEGER) AS b FROM orders)
SELECT o_orderkey, strftime(a, '%B ') || day(a) || strftime(a, ', %Y') AS long_date, CAST(CAST(a + INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS month_later, (SELECT count(*) FROM range(0, 40) t(i) WHERE a + CAST(i + 1 AS INTEGER) <= b AND dayofweek(a + CAST(i + 1 AS INTEGER)) NOT IN (0, 6)) AS business_days,
  (year(a) % 4 = 0 AND year(a) % 100 <> 0) OR year(a) % 400 = 0 AS leap FROM d""",
)
def calendar(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("a"), F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 40).cast("int")).alias("b"))
    return d.select("o_orderkey", F.date_format("a", "MMMM d, yyyy").alias("long_date"), DT.add_months("a", 1).cast("string").alias("month_later"), DT.business_days("a", "b").cast("long").alias("business_days"), DT.is_leap(F.year("a")).alias("leap"))


@register("date_formats", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders")
def date_formats(spark, sf_dir):
    """Dates written in four ways and read back."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    text = F.element_at(F.array(*[F.date_format("d", f) for f in ("yyyy-MM-dd", "MMMM d, yyyy", "d MMMM yyyy", "MMM d, yyyy")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return o.select("o_orderkey", DT.parse_date(text).cast("string").alias("day"))


@register(
    "invoice_totals",
    """SELECT l_orderkey, CAST(sum(round(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))), 2)) AS DOUBLE) AS net, CAST(sum(round(round(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))), 2) * (1 + CAST(l_tax AS DECIMAL(4,2))), 2)) AS DOUBLE) AS gross FROM lineitem GROUP BY l_orderkey""",
)
def invoice_totals(spark, sf_dir):
    """Discount, then tax, each line to the cent, half up."""
    net = F.round(F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(4,2)")), 2)
    gross = F.round(net * (1 + F.col("l_tax").cast("decimal(4,2)")), 2)
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(net).cast("double").alias("net"), F.sum(gross).cast("double").alias("gross"))


@register(
    "reserved_units",
    """WITH r AS (SELECT o_custkey FROM orders WHERE o_orderkey % 11 = 0), s AS (SELECT DISTINCT c_nationkey FROM customer WHERE c_custkey % 97 = 0)
SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM r) AND c_nationkey NOT IN (SELECT c_nationkey FROM s)""",
)
def reserved_units(spark, sf_dir):
    """Units whose lineage and state are both outside what is reserved."""
    c = table(spark, sf_dir, "customer")
    lineages = table(spark, sf_dir, "orders").where("o_orderkey % 11 = 0").select(F.col("o_custkey").alias("c_custkey"))
    states = c.where("c_custkey % 97 = 0").select("c_nationkey").distinct()
    return c.join(lineages, "c_custkey", "left_anti").join(states, "c_nationkey", "left_anti").select("c_custkey")


@register("complete_pairs", "SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) = 2")
def complete_pairs(spark, sf_dir):
    """Ids that have both variants."""
    return table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("A", "R")).groupBy("l_orderkey").agg(F.count_distinct("l_returnflag").alias("n")).where("n = 2").select("l_orderkey")


@register("pivot_variants", "SELECT l_orderkey, round(avg(l_quantity) FILTER (WHERE l_linestatus = 'F'), 6) AS f, round(avg(l_quantity) FILTER (WHERE l_linestatus = 'O'), 6) AS o FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_linestatus) = 2")
def pivot_variants(spark, sf_dir):
    wide = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").pivot("l_linestatus", ["F", "O"]).agg(F.avg("l_quantity"))
    return wide.where("F IS NOT NULL AND O IS NOT NULL").select("l_orderkey", F.round("F", 6).alias("f"), F.round("O", 6).alias("o"))


@register("row_match", "SELECT count(*) FILTER (WHERE b.c_custkey IS NULL) AS left_only, count(*) FILTER (WHERE a.c_custkey IS NULL) AS right_only, count(*) FILTER (WHERE a.c_mktsegment IS DISTINCT FROM b.c_mktsegment AND a.c_custkey IS NOT NULL AND b.c_custkey IS NOT NULL) AS differing FROM (SELECT * FROM customer WHERE c_custkey % 10 <> 1) a FULL JOIN (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 10 <> 2) b ON a.c_custkey = b.c_custkey")
def row_match(spark, sf_dir):
    """Two systems' rows must cover the same ids with equal metadata; nulls compare as values."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    a = c.where("c_custkey % 10 <> 1").select(F.col("c_custkey").alias("i"), F.col("c_mktsegment").alias("m"))
    b = c.where("c_custkey % 10 <> 2").selectExpr("c_custkey AS j", "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS n")
    return a.join(b, F.col("i") == F.col("j"), "full_outer").agg(F.expr("count_if(j IS NULL)").alias("left_only"), F.expr("count_if(i IS NULL)").alias("right_only"), F.expr("count_if(NOT (m <=> n) AND i IS NOT NULL AND j IS NOT NULL)").alias("differing"))


@register("routed_latency", "SELECT a.event_type, round(avg(CASE WHEN a.value > 50 THEN a.value + b.m ELSE a.value END), 6) AS latency, count(*) FILTER (WHERE a.value > 50) AS routed FROM events a JOIN (SELECT user_id, avg(value) AS m FROM events GROUP BY user_id) b ON a.user_id = b.user_id GROUP BY a.event_type")
def routed_latency(spark, sf_dir):
    """The direct row, or where it is routed the reasoned one with both latencies."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "value")
    slow = e.groupBy("user_id").agg(F.avg("value").alias("m"))
    return e.join(slow, "user_id").groupBy("event_type").agg(F.round(F.avg(F.expr("CASE WHEN value > 50 THEN value + m ELSE value END")), 6).alias("latency"), F.expr("count_if(value > 50)").alias("routed"))


@register("label_samples", "SELECT d.doc_id, CASE WHEN toxic = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p_true, 2 AS n_candidates FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
def label_samples(spark, sf_dir):
    """Labelled documents as canonical yes/no samples, read back."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    made = TR.boolean_noul(rows, "text", "Is the text toxic?", "toxic", ["doc_id"])
    return made.select(F.col("metadata")["doc_id"].cast("long").alias("doc_id"), F.explode("questions").alias("q")).select("doc_id", F.col("q.target")["b1"].alias("p_true"), F.size("q.candidates").alias("n_candidates"))


@register("score_samples", "WITH s AS (SELECT p_partkey, (p_size % 51) / 10.0 AS s FROM part), l AS (SELECT p_partkey, CAST(s AS DOUBLE) AS s, unnest(range(0, 6)) AS i FROM s) SELECT p_partkey, CAST(i AS INTEGER) AS level, round(CASE WHEN i = floor(s) AND floor(s) = least(floor(s) + 1, 5) THEN 1 WHEN i = floor(s) THEN 1 - (s - floor(s)) WHEN i = floor(s) + 1 THEN s - floor(s) ELSE 0 END, 6) AS mass FROM l WHERE s BETWEEN 0 AND 5")
def score_samples(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_name", "cast((p_size % 51) / 10.0 AS double) AS s")
    made = TR.real_score(rows, "p_name", "s", 6, "How large is the part?", metadata=["p_partkey"])
    q = made.select(F.col("metadata")["p_partkey"].cast("long").alias("p_partkey"), F.explode("questions").alias("q"))
    return q.select("p_partkey", F.posexplode("q.candidates").alias("level", "c"), "q.target").select("p_partkey", "level", F.round(F.col("target")[F.col("c.id")], 6).alias("mass"))


@register("schema_violations", "SELECT 'sum is not one' AS violation, count(*) AS n FROM part WHERE p_size % 5 = 0 HAVING count(*) > 0")
def schema_violations(spark, sf_dir):
    """Targets of which a fifth does not sum to 1."""
    rows = table(spark, sf_dir, "part").withColumn("y", F.when(F.col("p_size") % 5 == 0, F.array(F.lit(0.5), F.lit(0.25))).otherwise(F.array(F.lit(0.5), F.lit(0.5))))
    made = TR.samples(rows, F.col("p_name"), F.array(TR.question("q0", "choice", "Which?", TR.candidates(F.array(F.lit("a"), F.lit("b"))), F.col("y"))))
    return TR.validate(made).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


@register("grouped_turns", "SELECT conv_id, count(*) AS n_turns, string_agg(role, '>' ORDER BY turn) AS roles, max_by(md5(text), turn) AS last_text FROM conversations GROUP BY conv_id")
def grouped_turns(spark, sf_dir):
    turns = TR.grouped(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", ["role", "text"])
    return turns.select("conv_id", F.size("rows").cast("long").alias("n_turns"), F.array_join(F.transform("rows", lambda r: r["role"]), ">").alias("roles"), F.md5(F.element_at("rows", -1)["text"].cast("binary")).alias("last_text"))


@register("removed_candidate", "SELECT p_partkey, round(CASE WHEN p_size % 2 = 0 THEN 0.9 ELSE 1.0 END, 6) AS kept FROM part")
def removed_candidate(spark, sf_dir):
    """Without its first candidate a target keeps its mass: on none-of-these if there is one, else by scaling."""
    option = lambda i: F.struct(F.lit(i).alias("id"), F.lit(i).alias("description"))
    nota = F.col("p_size") % 2 == 0
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(nota, F.array(option("a"), option("b"), option("__nota__"))).otherwise(F.array(option("a"), option("b"))).alias("c"), F.when(nota, F.expr("map('a', 0.8D, 'b', 0.1D, '__nota__', 0.1D)")).otherwise(F.expr("map('a', 0.8D, 'b', 0.2D)")).alias("t"))
    out = rows.select("p_partkey", P.remove_candidate("c", "t", F.lit("a")).alias("r"))
    return out.select("p_partkey", F.round(F.coalesce(F.col("r.target")["__nota__"], F.col("r.target")["b"]), 6).alias("kept"))


@register("request_metrics", "SELECT event_type, count(*) AS n, CAST(sum(CASE WHEN value <= 10 THEN 1 ELSE 0 END) AS BIGINT) AS le_10, CAST(sum(CASE WHEN value <= 50 THEN 1 ELSE 0 END) AS BIGINT) AS le_50, CAST(sum(CASE WHEN value <= 100 THEN 1 ELSE 0 END) AS BIGINT) AS le_100, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def request_metrics(spark, sf_dir):
    from grainmill.streaming.requests import request_histogram

    return request_histogram(table(spark, sf_dir, "events"), ["event_type"], "value", (10, 50, 100))


@register("hourly_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def hourly_windows(spark, sf_dir):
    from grainmill.streaming.requests import tumbling

    return tumbling(table(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"], "value").withColumn("total", F.round("total", 4))


@register("running_best", "SELECT event_type, event_id, round(min(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) AS best FROM events")
def running_best(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("event_type").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_type", "event_id", F.round(F.min("value").over(w), 6).alias("best"))


@register("row_batches", "SELECT event_type, CAST((row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 100 AS BIGINT) AS batch, event_id FROM events")
def row_batches(spark, sf_dir):
    return S.batches_by_rows(table(spark, sf_dir, "events"), ["event_id"], 100, ["event_type"]).select("event_type", "batch", "event_id")
