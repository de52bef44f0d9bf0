"""Generated decisions with computed labels: rows of ``spark.range`` with hashed facts.

Each generator gives the facts, a rendered ``state`` and the ``label``; a
``verify_*`` twin reads the facts back from the text alone and computes the label
again in another way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.functions import dates as D


def pick(seed: int, name: str, n: int) -> Column:
    """A hashed integer below n for row ``id`` and fact ``name``."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(name), F.col("id")), F.lit(n)).cast("int")


def temporal(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """Whether an order arrived by the promised business day."""
    rows = spark.range(n).withColumn("ordered", F.date_add(F.lit("2024-01-01").cast("date"), pick(seed, "day", 700)))
    rows = rows.withColumn("promise", pick(seed, "promise", 7) + 2).withColumn("arrived", F.date_add("ordered", pick(seed, "took", 16) + 1))
    state = F.concat(F.lit("Ordered on "), F.date_format("ordered", "MMMM d, yyyy"), F.lit(". Promised within "), F.col("promise").cast("string"), F.lit(" business days. Arrived on "), F.date_format("arrived", "yyyy-MM-dd"), F.lit("."))
    return rows.withColumn("state", state).withColumn("label", D.business_days("ordered", "arrived") <= F.col("promise"))


def verify_temporal(rows: DataFrame) -> DataFrame:
    day = D.parse_date(F.regexp_extract("state", r"Ordered on ([A-Z][a-z]+ \d+, \d{4})", 1))
    got = D.parse_date(F.regexp_extract("state", r"Arrived on (\d{4}-\d{2}-\d{2})", 1))
    limit = F.regexp_extract("state", r"within (\d+) business", 1).cast("int")
    worked = F.size(F.filter(F.sequence(F.date_add(day, 1), got), lambda d: F.weekday(d) < 5))
    return rows.select("id", "label", (worked <= limit).alias("again"))


def numeric(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """Whether an invoice, discounted, taxed and with untaxed shipping, is within the budget."""
    dec = "decimal(18,2)"
    rows = spark.range(n).withColumns({"price": (pick(seed, "price", 90000) / 100.0 + 1).cast(dec), "quantity": pick(seed, "quantity", 9) + 1, "discount": pick(seed, "discount", 30), "tax": pick(seed, "tax", 25), "shipping": (pick(seed, "shipping", 3000) / 100.0).cast(dec)})
    net = F.round(F.col("price") * F.col("quantity") * (100 - F.col("discount")) / 100, 2)
    rows = rows.withColumn("total", (F.round(net * (100 + F.col("tax")) / 100, 2) + F.col("shipping")).cast(dec))
    rows = rows.withColumn("budget", F.round(F.col("total") * (90 + pick(seed, "budget", 20)) / 100, 2).cast(dec))
    state = F.format_string("%d items at %s. Discount %d%%, then tax %d%%. Shipping %s, untaxed. Budget %s.", "quantity", F.col("price").cast("string"), "discount", "tax", F.col("shipping").cast("string"), F.col("budget").cast("string"))
    return rows.withColumn("state", state).withColumn("label", F.col("total") <= F.col("budget"))


def verify_numeric(rows: DataFrame) -> DataFrame:
    """In whole cents."""
    cents = lambda p: F.round(F.regexp_extract("state", p, 1).cast("decimal(18,2)") * 100).cast("long")
    whole = lambda p: F.regexp_extract("state", p, 1).cast("long")
    half_up = lambda x: F.floor((x + 50) / 100).cast("long")
    net = half_up(cents(r"at ([\d.]+)\.") * whole(r"^(\d+) items") * (100 - whole(r"Discount (\d+)%")))
    total = half_up(net * (100 + whole(r"tax (\d+)%"))) + cents(r"Shipping ([\d.]+),")
    return rows.select("id", "label", (total <= cents(r"Budget ([\d.]+)\.")).alias("again"))


def policy_clauses(rows: DataFrame) -> Column:
    """Numbers of the clauses that fail; a fact that is missing fails its clause."""
    ok = lambda c: F.coalesce(c, F.lit(False))
    clauses = [ok(F.col("days") <= 30), ok(F.col("receipt")), ok(F.col("amount") <= F.when(F.col("category") == "travel", 2000).otherwise(500)), ok((F.col("category") != "alcohol") | F.col("approved"))]
    return F.array_compact(F.array(*[F.when(~c, F.lit(i + 1)) for i, c in enumerate(clauses)]))


def policy(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """The first clause of an expense policy that a claim fails; 0 if none."""
    rows = spark.range(n).withColumns({"days": F.when(pick(seed, "known", 10) > 0, pick(seed, "days", 45)), "receipt": pick(seed, "receipt", 10) > 1, "amount": pick(seed, "amount", 2500), "category": F.element_at(F.array(*map(F.lit, ("travel", "meals", "alcohol"))), pick(seed, "category", 3) + 1), "approved": pick(seed, "approved", 2) == 1})
    days = F.coalesce(F.concat(F.lit("Days since purchase: "), F.col("days").cast("string"), F.lit(". ")), F.lit(""))
    state = F.concat(days, F.lit("Receipt: "), F.col("receipt").cast("string"), F.lit(". Amount: "), F.col("amount").cast("string"), F.lit(". Category: "), F.col("category"), F.lit(". Approved: "), F.col("approved").cast("string"), F.lit("."))
    return rows.withColumn("state", state).withColumn("label", F.coalesce(F.try_element_at(policy_clauses(rows), F.lit(1)), F.lit(0)))


def verify_policy(rows: DataFrame) -> DataFrame:
    get = lambda p: F.nullif(F.regexp_extract("state", p, 1), F.lit(""))
    facts = rows.select("id", "label", get(r"purchase: (\d+)").cast("int").alias("d"), (get(r"Receipt: (\w+)") == "true").alias("r"), get(r"Amount: (\d+)").cast("int").alias("a"), get(r"Category: (\w+)").alias("c"), (get(r"Approved: (\w+)") == "true").alias("p"))
    again = F.expr("CASE WHEN d IS NULL OR d > 30 THEN 1 WHEN NOT r THEN 2 WHEN a > 500 AND (c <> 'travel' OR a > 2000) THEN 3 WHEN c = 'alcohol' AND NOT p THEN 4 ELSE 0 END")
    return facts.select("id", "label", again.alias("again"))


def calendar(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """Whether a notice in a zone with a fixed offset comes strictly before the cutoff, months after a start."""
    rows = spark.range(n).withColumns({"start": F.date_add(F.lit("2023-01-29").cast("date"), pick(seed, "start", 500)), "months": pick(seed, "months", 18) + 1, "offset": (pick(seed, "offset", 25) - 12) * 60})
    rows = rows.withColumn("cutoff", F.to_timestamp_ntz(F.concat(D.add_months("start", F.col("months")).cast("string"), F.lit(" 00:00:00"))))
    rows = rows.withColumn("sent", F.col("cutoff") + F.make_dt_interval(mins=pick(seed, "late", 2880) - 1440 + F.col("offset")))
    state = F.concat(F.lit("Start "), F.col("start").cast("string"), F.lit(", "), F.col("months").cast("string"), F.lit(" months. Sent "), F.date_format("sent", "yyyy-MM-dd HH:mm"), F.lit(" at UTC offset "), F.col("offset").cast("string"), F.lit(" minutes."))
    return rows.withColumn("state", state).withColumn("label", D.to_utc("sent", "offset") < F.col("cutoff"))


def verify_calendar(rows: DataFrame) -> DataFrame:
    start = F.regexp_extract("state", r"Start (\S+),", 1).cast("date")
    months = F.regexp_extract("state", r", (\d+) months", 1).cast("int")
    month = F.month(start) - 1 + months
    first = F.make_date(F.year(start) + F.floor(month / 12).cast("int"), (month % 12 + 1).cast("int"), F.lit(1))
    end = F.date_add(first, F.least(F.dayofmonth(start), F.dayofmonth(F.last_day(first))) - 1)
    sent = F.to_timestamp_ntz(F.regexp_extract("state", r"Sent (.+) at", 1), F.lit("yyyy-MM-dd HH:mm"))
    offset = F.regexp_extract("state", r"offset (-?\d+)", 1).cast("long")
    minute = F.datediff(F.to_date(sent), F.lit("1970-01-01").cast("date")).cast("long") * 1440 + F.hour(sent) * 60 + F.minute(sent) - offset
    return rows.select("id", "label", (minute < F.datediff(end, F.lit("1970-01-01").cast("date")).cast("long") * 1440).alias("again"))


def bayes(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """The posterior of a condition after a positive test, as a soft target."""
    rows = spark.range(n).withColumns({"prior": pick(seed, "prior", 50) + 1, "hit": pick(seed, "hit", 49) + 50, "false_alarm": pick(seed, "false", 40) + 1})
    state = F.format_string("Prior %d%%, sensitivity %d%%, false alarms %d%%, test positive.", "prior", "hit", "false_alarm")
    return rows.withColumn("state", state).withColumn("label", F.expr("prior * hit / (prior * hit + (100 - prior) * false_alarm)"))


def verify_bayes(rows: DataFrame) -> DataFrame:
    num = lambda p: F.regexp_extract("state", p, 1).cast("double") / 100
    odds = num(r"Prior (\d+)") / (1 - num(r"Prior (\d+)")) * num(r"sensitivity (\d+)") / num(r"alarms (\d+)")
    return rows.select("id", F.round("label", 9).alias("label"), F.round(odds / (1 + odds), 9).alias("again"))


def draws(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """Chance that a sample without replacement holds no marked item."""
    rows = spark.range(n).withColumns({"total": pick(seed, "total", 30) + 20, "marked": pick(seed, "marked", 8) + 1, "taken": pick(seed, "taken", 6) + 1})
    state = F.format_string("%d items, %d marked, %d drawn.", "total", "marked", "taken")
    return rows.withColumn("state", state).withColumn("label", D.combinations(F.col("total") - F.col("marked"), "taken") / D.combinations("total", "taken"))


def verify_draws(rows: DataFrame) -> DataFrame:
    num = lambda p: F.regexp_extract("state", p, 1).cast("int")
    total, marked, taken = num(r"^(\d+) items"), num(r", (\d+) marked"), num(r", (\d+) drawn")
    again = F.aggregate(F.sequence(F.lit(0), taken - 1), F.lit(1.0), lambda a, i: a * (total - marked - i) / (total - i))
    return rows.select("id", F.round("label", 9).alias("label"), F.round(again, 9).alias("again"))


GENERATORS = {"temporal": (temporal, verify_temporal), "numeric": (numeric, verify_numeric), "policy": (policy, verify_policy), "calendar": (calendar, verify_calendar), "bayes": (bayes, verify_bayes), "draws": (draws, verify_draws)}


def curriculum(spark: SparkSession, n: int, seed: int = 0, splits: tuple[str, ...] = ("train", "dev", "test")) -> DataFrame:
    """All generators crossed with splits, each split with rows of its own."""
    out = None
    for i, split in enumerate(splits):
        for kind, (make, _) in GENERATORS.items():
            rows = make(spark, n, seed * 1000 + i).select(F.lit(kind).alias("kind"), F.lit(split).alias("split"), "id", "state", F.col("label").cast("string").alias("label"))
            out = rows if out is None else out.unionByName(rows)
    return out
