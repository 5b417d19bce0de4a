"""One query per operator. Customers stand for players, orders for games, order years for
seasons, line items for shots, nations for teams, events for play-by-play."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from puckspark.functions import scalars as S
from puckspark.harness.comps_sql import compared
from puckspark.harness.registry import CENTS, R, SUM, Tables, cents, query
from puckspark.operators import flatten as fl
from puckspark.operators import names
from puckspark.operators import ordered as od
from puckspark.operators import quality as dq
from puckspark.operators import rates as rt
from puckspark.operators import relate as rl
from puckspark.operators import search as se
from puckspark.operators import similarity as sm
from puckspark.plans import marts as mt
from puckspark.plans import xg
from puckspark.session import pin, shared_dir
from puckspark.sources import raw, sinks

def order_year():
    return F.year("o_orderdate").cast("long")


def games(t: Tables):
    """Orders as a game log."""
    return t.orders.select(
        F.col("o_custkey").alias("player"), F.col("o_orderkey").alias("game"),
        F.to_date("o_orderdate").alias("day"), S.season_of_year(order_year()).alias("season"),
        (F.col("o_orderpriority") == "1-URGENT").cast("long").alias("scored"),
        (F.col("o_orderstatus") == "F").cast("long").alias("tried"),
        "o_orderpriority", "o_orderstatus", "o_totalprice",
    )


GAMES = """games AS (
  SELECT o_custkey AS player, o_orderkey AS game, CAST(o_orderdate AS DATE) AS "day",
         CAST(year(o_orderdate) AS BIGINT) * 10000 + year(o_orderdate) + 1 AS season,
         CAST(o_orderpriority = '1-URGENT' AS BIGINT) AS scored, CAST(o_orderstatus = 'F' AS BIGINT) AS tried,
         o_orderpriority, o_orderstatus, o_totalprice
  FROM orders)"""
LOG = 'PARTITION BY player ORDER BY "day", game'


# --- sources and sinks --------------------------------------------------------------


@query("season_spine", """
SELECT y * 10000 + y + 1 AS season_id, CAST(count(o_orderkey) AS BIGINT) AS games
FROM (SELECT unnest(range(min(year(o_orderdate)) - 2, max(year(o_orderdate)) + 3)) AS y FROM orders) LEFT JOIN orders ON year(o_orderdate) = y GROUP BY y""")
def season_spine(t):
    played = t.orders.groupBy(S.season_of_year(order_year()).alias("season_id")).agg(F.count("*").alias("games"))
    first, last = t.orders.agg(F.min(order_year()), F.max(order_year())).first()
    return raw.season_spine(t.spark, first - 2, last + 2).join(played, "season_id", "left").withColumn(
        "games", F.coalesce("games", F.lit(0)).cast("long"))


@query("union_seasons", f"""
SELECT CAST(year(o_orderdate) AS BIGINT) * 10000 + year(o_orderdate) + 1 AS season_id,
       CAST(count(*) AS BIGINT) AS n, {SUM(CENTS('o_totalprice'))} AS total
FROM orders GROUP BY 1""")
def union_seasons(t):
    first, last = t.orders.agg(F.min(order_year()), F.max(order_year())).first()
    reports = {
        y * 10000 + y + 1: t.orders.filter(
            (F.col("o_orderdate") >= f"{y}-01-01") & (F.col("o_orderdate") < f"{y + 1}-01-01")
        ).select("o_orderkey", "o_totalprice") for y in range(first, last + 1)
    }
    return rl.union_seasons(reports).groupBy("season_id").agg(F.count("*").alias("n"), F.sum(cents("o_totalprice")).alias("total"))


@query("season_fallback", """
SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN 19901991 WHEN o_orderstatus = 'O' THEN 19801981 END,
       20252026)::BIGINT AS season_id FROM orders""")
def season_fallback(t):
    rows = t.orders.select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", 19901991).cast("long").alias("season_id"),
        F.when(F.col("o_orderstatus") == "O", 19801981).cast("long").alias("seasonId"),
    )
    return raw.season_fallback(rows, 20252026)


@query("stamp_loaded", """
SELECT s_suppkey, s_name, TIMESTAMP '2026-01-02 03:04:05' AS "_loaded_at" FROM supplier""")
def stamp_loaded(t):
    return raw.stamp_loaded(t.supplier.select("s_suppkey", "s_name"), "2026-01-02 03:04:05").withColumn(
        "_loaded_at", F.col("_loaded_at").cast("timestamp_ntz"))


@query("wrap_payload", """
SELECT s_suppkey AS game_id, CAST(20252026 AS BIGINT) AS season_id, s_name AS name, s_acctbal AS balance FROM supplier""")
def wrap_payload(t):
    return raw.wrap_payload(t.supplier, "s_suppkey", 20252026).select(
        "game_id", "season_id", S.json_text("payload", "$.s_name").alias("name"),
        S.json_text("payload", "$.s_acctbal").cast("double").alias("balance"))


def fresh(t: Tables) -> str:
    return f"{shared_dir(t.spark)}/puckspark/out-{uuid.uuid4().hex}"


@query("publish_roundtrip", """
SELECT p_partkey, p_name, p_retailprice, (SELECT CAST(count(*) AS BIGINT) FROM part) AS written FROM part""")
def publish_roundtrip(t):
    root = fresh(t)
    n = sinks.publish(t.part, f"{root}/part")
    return raw.table(t.spark, root, "part").select("p_partkey", "p_name", "p_retailprice", F.lit(n).cast("long").alias("written"))


@query("ndjson_roundtrip", """
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status, o_totalprice,
       (SELECT CAST(count(*) AS BIGINT) FROM orders) AS written FROM orders""")
def ndjson_roundtrip(t):
    rows = t.orders.select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"), "o_totalprice")
    path = fresh(t)
    n = sinks.write_ndjson(rows, path)
    return t.spark.read.schema(rows.schema).json(path).withColumn("written", F.lit(n).cast("long"))


@query("read_raw", """
SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS "fullName", CASE WHEN n_regionkey <> 3 THEN 'N' || n_nationkey END AS "triCode",
  CAST(n_regionkey AS BIGINT) AS "franchiseId", TIMESTAMP '2026-01-02 03:04:05' AS "_loaded_at" FROM nation""")
def read_raw(t):
    rows = t.nation.select(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("fullName"), F.lit("ignored").alias("extra"),
        F.when(F.col("n_regionkey") != 3, F.concat(F.lit("N"), F.col("n_nationkey"))).alias("triCode"), F.col("n_regionkey").alias("franchiseId"))
    folder = fresh(t)
    sinks.write_ndjson(raw.stamp_loaded(rows, "2026-01-02 03:04:05"), f"{folder}/raw_teams.ndjson")
    return raw.read_raw(t.spark, folder, "raw_teams").withColumn("_loaded_at", F.col("_loaded_at").cast("timestamp_ntz"))


@query("read_payloads", "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation")
def read_payloads(t):
    """One file per document: the text sink writes one per key here."""
    folder = fresh(t)
    docs = t.nation.select("n_nationkey", F.to_json(F.struct("n_nationkey", "n_name")).alias("value"))
    docs.write.partitionBy("n_nationkey").text(folder)
    doc = S.json_text
    return raw.read_payloads(t.spark, f"{folder}/*/*.txt").select(
        doc("payload", "$.n_nationkey").cast("long").alias("id"), doc("payload", "$.n_name").alias("name"))


@query("append_log", """
SELECT text AS question, text || '\n---\n' || role AS sql_queries,
       CAST(2 AS BIGINT) AS sql_count, CAST(turn AS BIGINT) AS row_count FROM conversations
UNION ALL
SELECT role, role, CAST(1 AS BIGINT), CAST(turn AS BIGINT) FROM conversations""")
def append_log(t):
    def entries(question, *sql):
        return t.conversations.select(
            question.alias("question"), F.length("text").alias("answer_chars"), F.array(*sql).alias("sql"),
            F.col("turn").cast("long").alias("row_count"), F.lit(5).alias("duration_ms"),
            F.lit("ok").alias("status"), F.lit("m").alias("model"))
    path, text, role = fresh(t), F.col("text"), F.col("role")
    first = entries(text, text, role)
    sinks.append_log(first, path)
    sinks.append_log(entries(role, role), path)
    schema = sinks.log_rows(first).schema
    return t.spark.read.schema(schema).json(path).select(
        "question", "sql_queries", F.col("sql_count").cast("long").alias("sql_count"), "row_count")


@query("run_select", f"""
SELECT o_orderpriority AS priority, CAST(count(*) AS BIGINT) AS n, {SUM(CENTS('o_totalprice'))} AS total
FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""")
def run_select(t):
    path = fresh(t)
    sinks.publish(t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority", cents("o_totalprice").alias("cents")), path)
    sinks.register(t.spark, "nhl_marts", {"order_lines": path})
    return se.run_select(
        t.spark, "SELECT o_orderpriority AS priority, count(*) AS n, sum(cents) AS total "
        "FROM nhl_marts.order_lines WHERE o_orderstatus = :status GROUP BY o_orderpriority", {"status": "F"})


# --- flattening ---------------------------------------------------------------------


def right_rail_docs(t: Tables):
    """One document per order: quantities by return flag, one value per line status."""
    per_flag = t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(
        F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity").cast("long"))).alias("away"),
        F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity").cast("long"))).alias("home"),
    )
    # at most three flags per order are left to collect
    stats = F.collect_list(F.struct(
        F.col("l_returnflag").alias("category"), F.col("away").alias("awayValue"), F.col("home").alias("homeValue")))
    return per_flag.groupBy("l_orderkey").agg(F.to_json(F.struct(stats.alias("teamGameStats"))).alias("payload"))


FLAGS = """SELECT l_orderkey, l_returnflag AS category,
  sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS a, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS h
FROM lineitem GROUP BY 1, 2"""


@query("explode_categories", f"""
SELECT l_orderkey, category, CAST(CAST(a AS BIGINT) AS VARCHAR) AS away_value, CAST(CAST(h AS BIGINT) AS VARCHAR) AS home_value
FROM ({FLAGS})""")
def explode_categories(t):
    return fl.explode_categories(right_rail_docs(t), ["l_orderkey"])


@query("pivot_categories", f"""
SELECT l_orderkey, {', '.join(f"max(CASE WHEN category = '{c}' THEN CAST({s} AS BIGINT) END) AS {n}_{c.lower()}"
                              for c in 'ANR' for s, n in (('a', 'away'), ('h', 'home')))}
FROM ({FLAGS}) GROUP BY 1""")
def pivot_categories(t):
    long = fl.explode_categories(right_rail_docs(t), ["l_orderkey"])
    long = long.withColumns({c: F.col(c).cast("long") for c in ("away_value", "home_value")})
    return fl.pivot_categories(long, ["l_orderkey"], "category", {
        f"{s}_{c.lower()}": (c, f"{s}_value") for c in "ANR" for s in ("away", "home")})


def _ratio_text(t: Tables):
    per = t.lineitem.groupBy("l_suppkey").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count("*").alias("n"))
    return per.select("l_suppkey", "r", F.concat_ws("/", F.col("r").cast("string"), F.col("n").cast("string")).alias("text"))


@query("ratio_split_strict", """
SELECT l_suppkey, CAST(count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS made, CAST(count(*) AS BIGINT) AS total
FROM lineitem GROUP BY 1""")
def ratio_split_strict(t):
    return _ratio_text(t).select(
        "l_suppkey", S.ratio_part("text", 0, strict=True).alias("made"), S.ratio_part("text", 1, strict=True).alias("total"))


@query("ratio_split_lenient", """
SELECT l_suppkey, CASE WHEN r % 3 = 2 THEN NULL ELSE r END AS made, CASE WHEN r % 3 = 0 THEN n END AS total
FROM (SELECT l_suppkey, CAST(count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS r, CAST(count(*) AS BIGINT) AS n
      FROM lineitem GROUP BY 1)""")
def ratio_split_lenient(t):
    """A third of the texts get a bad second part and a third a third part."""
    r = F.col("r") % 3
    text = F.when(r == 0, F.col("text")).when(r == 1, F.concat("text", F.lit("x"))).otherwise(F.concat("text", F.lit("/1")))
    return _ratio_text(t).withColumn("text", text).select(
        "l_suppkey", S.ratio_part("text", 0).alias("made"), S.ratio_part("text", 1).alias("total"))


@query("dedupe_schedule", """
SELECT game, CAST(max(event_id) AS BIGINT) AS kept FROM (
  SELECT event_id, user_id * 100 + event_id % 60 AS game, 1 + event_id % 4 AS kind FROM events)
WHERE kind IN (2, 3) GROUP BY game""")
def dedupe_schedule(t):
    rows = t.events.select(
        F.col("event_id").alias("kept"), (F.col("user_id") * 100 + F.col("event_id") % 60).alias("game"),
        (1 + F.col("event_id") % 4).alias("kind"))
    return fl.dedupe_schedule(rows, "game", "kind", [F.desc("kept")]).drop("kind")


def plays(t: Tables):
    """Events as play-by-play: two sides, three zones, minutes for seconds."""
    return t.events.select(
        "user_id", "event_id", "ts", "event_type", (F.col("event_id") % 2).alias("side"),
        F.element_at(F.array(F.lit("N"), F.lit("D"), F.lit("O")), (F.col("event_id") % 3 + 1).cast("int")).alias("zone"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60000000).alias("minute"),
        F.dayofmonth("ts").cast("long").alias("period"))


PLAYS = """plays AS (
  SELECT user_id, event_id, ts, event_type, event_id % 2 AS side, CASE event_id % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'D' ELSE 'O' END AS zone,
         CAST(floor(epoch_us(ts) / 60000000) AS BIGINT) AS "minute", day(ts) AS period
  FROM events)"""
PLAY_ORDER = "PARTITION BY user_id ORDER BY ts, event_id"


@query("rush_flag", f"""
WITH {PLAYS}, held AS (
  SELECT *, last_value(CASE WHEN side = 0 AND zone IN ('N', 'D') THEN "minute" END IGNORE NULLS) OVER w AS m0,
            last_value(CASE WHEN side = 1 AND zone IN ('N', 'D') THEN "minute" END IGNORE NULLS) OVER w AS m1
  FROM plays WINDOW w AS ({PLAY_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT event_id, "minute" - (CASE side WHEN 0 THEN m0 ELSE m1 END) AS since_exit FROM held""")
def rush_flag(t):
    side = F.col("side")
    return fl.seconds_since_zone_exit(
        plays(t), ["user_id"], ["ts", "event_id"], side, side, [F.lit(0), F.lit(1)], F.col("zone").isin("N", "D"),
        F.col("minute"), "since_exit").select("event_id", "since_exit")


@query("rebound_flag", f"""
WITH {PLAYS}, held AS (
  SELECT *, event_type IN ('click', 'view', 'purchase') AS attempt,
    last_value(CASE WHEN event_type IN ('click', 'view', 'purchase') THEN event_id END IGNORE NULLS) OVER
      ({PLAY_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
  FROM plays)
SELECT h.event_id, coalesce(h.attempt AND p.side = h.side AND p.period = h.period AND h."minute" - p."minute" BETWEEN 0 AND 600, false) AS is_rebound
FROM held h LEFT JOIN plays p ON p.event_id = h.prev""")
def rebound_flag(t):
    return fl.follows_own_attempt(
        plays(t), ["user_id"], ["ts", "event_id"], F.col("event_type").isin("click", "view", "purchase"), F.col("side"),
        F.col("period"), F.col("minute"), 600, "is_rebound").select("event_id", "is_rebound")


@query("carry_last_value", f"""
SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER
  ({PLAY_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_purchase FROM events""")
def carry_last_value(t):
    bought = F.when(F.col("event_type") == "purchase", F.col("value"))
    return od.carry_last(t.events, ["user_id"], ["ts", "event_id"], {"last_purchase": bought}).select("event_id", "last_purchase")


@query("shooter_team", """
SELECT event_id, CASE WHEN event_type = 'error' THEN (CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END) ELSE event_id % 2 END AS shooter FROM events""")
def shooter_team(t):
    kind = F.when(F.col("event_type") == "error", "blocked-shot").otherwise("shot-on-goal")
    return t.events.select("event_id", fl.shooter_team(
        kind, F.col("event_id") % 2, F.lit(0).cast("long"), F.lit(1).cast("long")).alias("shooter"))


# --- scalars ------------------------------------------------------------------------


@query("id_digits", """
SELECT o_orderkey, year(o_orderdate)::BIGINT AS start_year, (year(o_orderdate) + 1)::BIGINT AS end_year,
       CAST(substr(CAST(year(o_orderdate) AS VARCHAR), 3, 2) AS BIGINT) AS short_year FROM orders""")
def id_digits(t):
    s = S.season_of_year(order_year())
    return t.orders.select("o_orderkey", S.digits(s, 1, 4).alias("start_year"), S.digits(s, 5, 4).alias("end_year"),
                           S.digits(s, 3, 2).alias("short_year"))


@query("season_label", """
SELECT o_custkey, CAST(min(year(o_orderdate)) AS VARCHAR) || '-' || substr(CAST(min(year(o_orderdate)) + 1 AS VARCHAR), 3, 2) AS label,
       CAST(min(year(o_orderdate)) AS VARCHAR) || '-' || CAST(max(year(o_orderdate)) + 1 AS VARCHAR) AS span
FROM orders GROUP BY 1""")
def season_label(t):
    per = t.orders.groupBy("o_custkey").agg(F.min(S.season_of_year(order_year())).alias("a"), F.max(S.season_of_year(order_year())).alias("b"))
    return per.select("o_custkey", S.season_label("a").alias("label"), S.season_span("a", "b").alias("span"))


@query("game_clock", """
SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE (event_id % 20) * 60 + (event_id * 7) % 60 END AS clock,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE (event_id % 3) * 1200 + (event_id % 20) * 60 + (event_id * 7) % 60 END AS elapsed
FROM events""")
def game_clock(t):
    e = F.col("event_id")
    text = F.when(e % 11 == 0, "late").otherwise(F.format_string("%02d:%02d", e % 20, (e * 7) % 60))
    return t.events.select("event_id", S.clock_seconds(text).alias("clock"), S.game_seconds(e % 3 + 1, text).alias("elapsed"))


XY = "SELECT event_id, (event_id * 37) % 201 - 100 AS x, (event_id * 53) % 85 - 42 AS y, (CASE WHEN (user_id % 2 = 0) = (event_id % 2 = 0) THEN 89.0 ELSE -89.0 END)::DOUBLE AS net FROM events"


def shot_xy(t: Tables):
    e = F.col("event_id")
    net = S.attack_net_x(F.col("user_id") % 2 == 0, F.when(e % 2 == 0, "left").otherwise("right"))
    return t.events.select("event_id", ((e * 37) % 201 - 100).alias("x"), ((e * 53) % 85 - 42).alias("y"), net.alias("net"))


@query("shot_geometry", f"""
SELECT event_id, net, {R('sqrt((net - x) * (net - x) + y * y)', 2)} AS distance_ft,
       {R('degrees(atan2(CAST(abs(y) AS DOUBLE), abs(net - x)))', 2)} AS angle_deg FROM ({XY})""")
def shot_geometry(t):
    return shot_xy(t).select("event_id", "net", S.shot_distance("x", "y", "net").alias("distance_ft"), S.shot_angle("x", "y", "net").alias("angle_deg"))


@query("normalize_shots", f"""
SELECT event_id, least(abs(x), 99) AS plot_x, CASE WHEN x >= 0 THEN y ELSE -y END AS plot_y FROM ({XY}) WHERE event_id % 4 <> 3""")
def normalize_shots(t):
    zone = F.when(F.col("event_id") % 4 == 3, "D").when(F.col("event_id") % 4 == 2, "O")
    return fl.normalize_shots(shot_xy(t).withColumn("zone", zone), "x", "y", "zone").select("event_id", "plot_x", "plot_y")


@query("strength_state", """
SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'EV'
    WHEN lead > 0 THEN 'PP' WHEN lead < 0 THEN 'SH' ELSE 'EV' END AS strength FROM (
  SELECT event_id, (CASE WHEN user_id % 2 = 0 THEN 1 ELSE -1 END) * ((3 + event_id % 4) - (3 + event_id % 3)) AS lead FROM events)""")
def strength_state(t):
    e = F.col("event_id")
    code = F.when(e % 13 == 0, "").otherwise(F.concat(F.lit("1"), (3 + e % 3).cast("string"), (3 + e % 4).cast("string"), F.lit("1")))
    return t.events.select("event_id", S.strength_state(code, F.col("user_id") % 2 == 0).alias("strength"))


@query("age_at_season_end", """
SELECT o_orderkey, CAST(floor(date_diff('day', DATE '1960-01-01' + CAST(o_custkey % 9000 AS INTEGER), make_date(year(o_orderdate) + 1, 4, 15)) / 365.25) AS BIGINT) AS age
FROM orders""")
def age_at_season_end(t):
    birth = F.date_add(F.lit("1960-01-01").cast("date"), (F.col("o_custkey") % 9000).cast("int"))
    return t.orders.select("o_orderkey", S.age_at_season_end(birth, S.season_of_year(order_year())).alias("age"))


@query("json_extract", """
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
       TRY_CAST(substr(event_type, 1, 2) || json_extract_string(props, '$.k') AS BIGINT) AS bad FROM events""")
def json_extract(t):
    rows = t.events.select("event_id", S.json_text("props", "$.k").alias("k"), F.substring("event_type", 1, 2).alias("head"))
    return rl.try_cast_cols(rows.withColumn("bad", F.concat("head", "k")), {"k": "long", "bad": "long"}).drop("head")


@query("last_in_list", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE o_orderpriority END AS last_stop FROM orders""")
def last_in_list(t):
    stops = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).otherwise(F.concat_ws(", ", "o_orderstatus", "o_orderpriority"))
    return t.orders.select("o_orderkey", S.last_in_list(stops).alias("last_stop"))


@query("position_group", """
SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'D' WHEN 'MACHINERY' THEN 'G' ELSE 'F' END AS three_way,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'D' ELSE 'F' END AS two_way FROM customer""")
def position_group(t):
    code = F.when(F.col("c_mktsegment") == "BUILDING", "D").when(F.col("c_mktsegment") == "MACHINERY", "G").otherwise("C")
    return t.customer.select("c_custkey", S.position_group(code).alias("three_way"), S.position_group(code, goalies=False).alias("two_way"))


@query("game_result", """
SELECT l_orderkey, CASE WHEN a > h THEN 'W' WHEN l_orderkey % 2 = 0 THEN 'L' ELSE 'OTL' END AS result,
       CASE WHEN a > h THEN 'W' ELSE 'L' END AS playoff_result
FROM (SELECT l_orderkey, count(*) FILTER (l_linestatus = 'F') AS a, count(*) FILTER (l_linestatus = 'O') AS h FROM lineitem GROUP BY 1)""")
def game_result(t):
    per = t.lineitem.groupBy("l_orderkey").agg(
        F.count_if(F.col("l_linestatus") == "F").alias("a"), F.count_if(F.col("l_linestatus") == "O").alias("h"))
    period = F.when(F.col("l_orderkey") % 2 == 0, "REG").otherwise("OT")
    return per.select("l_orderkey", S.game_result("a", "h", period).alias("result"), S.game_result("a", "h").alias("playoff_result"))


@query("surrogate_key", """
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_custkey AS VARCHAR) || '-' || o_orderstatus END AS game_key FROM orders""")
def surrogate_key(t):
    part = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    return t.orders.select("o_orderkey", S.surrogate_key("o_custkey", part).alias("game_key"))


# --- windows ------------------------------------------------------------------------


@query("dedupe_latest", """
SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def dedupe_latest(t):
    return od.latest_per(t.events, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])


@query("latest_identity", """
SELECT entity, name, kind FROM (
  SELECT 'c' || c_nationkey AS entity, c_name AS name, 'customer' AS kind, c_custkey AS k FROM customer
  UNION ALL SELECT 'c' || s_nationkey, s_name, 'supplier', s_suppkey FROM supplier)
QUALIFY row_number() OVER (PARTITION BY entity ORDER BY k DESC, kind) = 1""")
def latest_identity(t):
    both = t.customer.select(F.concat(F.lit("c"), F.col("c_nationkey")).alias("entity"), F.col("c_name").alias("name"),
                             F.lit("customer").alias("kind"), F.col("c_custkey").alias("k")).unionByName(
        t.supplier.select(F.concat(F.lit("c"), F.col("s_nationkey")).alias("entity"), F.col("s_name").alias("name"),
                          F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("k")))
    return od.latest_per(both, ["entity"], [F.desc("k"), "kind"]).drop("k")


@query("sequence_number", f"""
WITH {GAMES} SELECT game, CAST(row_number() OVER ({LOG}) AS BIGINT) AS game_number FROM games""")
def sequence_number(t):
    return od.sequence_number(games(t), ["player"], ["day", "game"], "game_number").select("game", "game_number")


@query("rest_days", f"""
WITH {GAMES} SELECT game, date_diff('day', lag("day") OVER ({LOG}), "day") AS rest_days FROM games""")
def rest_days(t):
    rows = od.windowed(games(t), ["player"], ["day", "game"], 1, mt.rest_columns("day"))
    return rows.select("game", "rest_days")


@query("back_to_back", f"""
WITH {GAMES} SELECT game, coalesce(date_diff('day', lag("day") OVER ({LOG}), "day") = 1, false) AS is_back_to_back FROM games""")
def back_to_back(t):
    return od.windowed(games(t), ["player"], ["day", "game"], 1, mt.rest_columns("day")).select("game", "is_back_to_back")


def _rolling(n: int, one_minus: bool) -> str:
    frame = f'OVER ({LOG} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)'
    e = f"(sum(scored) {frame} / nullif(sum(tried) {frame}, 0)::DOUBLE)"
    return R(f"(1 - {e})" if one_minus else e, 4)


ROLLING_SQL = f"""
WITH {GAMES} SELECT game, CAST(row_number() OVER ({LOG}) AS BIGINT) AS game_number,
  {', '.join(f'{_rolling(n, False)} AS pp_last_{n}' for n in (5, 10, 15))},
  {', '.join(f'{_rolling(n, True)} AS pk_last_{n}' for n in (5, 10, 15))} FROM games"""


@query("trailing_ratio", ROLLING_SQL)
def trailing_ratio(t):
    return mt.trailing_ratios(games(t).select("player", "day", "game", "scored", "tried"), ["player"], ["day", "game"], [
        mt.TrailingRatio("pp", "scored", "tried"), mt.TrailingRatio("pk", "scored", "tried", complement=True),
    ], number="game_number").drop("player", "day", "scored", "tried")


@query("best_rolling_ratio", f"""
SELECT game, pp_last_10 FROM ({ROLLING_SQL}) WHERE game_number >= 10 ORDER BY pp_last_10 DESC NULLS LAST, game LIMIT 20""")
def best_rolling_ratio(t):
    full = trailing_ratio(t).filter("game_number >= 10")
    return full.orderBy(F.col("pp_last_10").desc_nulls_last(), "game").limit(20).select("game", "pp_last_10")


@query("trailing_sums", f"""
WITH {GAMES} SELECT game, {', '.join(f'{SUM(CENTS("o_totalprice"))[:-11]} OVER ({LOG} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS BIGINT) AS sum_{n}' for n in (5, 10, 15))} FROM games""")
def trailing_sums(t):
    build = lambda w: {f"sum_{n}": F.sum("cents").over(w.rowsBetween(1 - n, 0)) for n in (5, 10, 15)}
    rows = games(t).withColumn("cents", cents("o_totalprice"))
    return od.windowed(rows, ["player"], ["day", "game"], 14, build).select("game", "sum_5", "sum_10", "sum_15")


FORM = f'OVER ({LOG} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)'


@query("rolling_form", f"""
WITH {GAMES}, xg AS (SELECT l_orderkey AS game, {SUM(CENTS('l_tax'))} AS xg FROM lineitem GROUP BY 1),
base AS (SELECT player, season, {R('sum(scored) / count(*)::DOUBLE', 4)} AS pace FROM games GROUP BY 1, 2),
j AS (SELECT games.*, coalesce(xg, 0) / 100.0::DOUBLE AS xg FROM games LEFT JOIN xg USING (game)),
r AS (SELECT game, player, season, CAST(row_number() OVER ({LOG}) AS BIGINT) AS n, CAST(sum(scored) {FORM} AS BIGINT) AS pts, CAST(sum(tried) {FORM} AS BIGINT) AS gls, {R(f"(sum(xg) {FORM})", 2)} AS x FROM j)
SELECT game, least(n, 10) AS games_in_window, pts AS points_last_10, gls AS goals_last_10, x AS xg_last_10,
  {R('(pts / least(n, 10)::DOUBLE)', 3)} AS points_per_gp_last_10, {R('(gls - x)', 2)} AS finishing_last_10,
  {R('(pts / least(n, 10)::DOUBLE - pace)', 3)} AS form_delta
FROM r LEFT JOIN base USING (player, season)""")
def rolling_form(t):
    xg_sum = t.lineitem.groupBy(F.col("l_orderkey").alias("game")).agg(F.sum(cents("l_tax")).alias("x"))
    log = games(t).join(xg_sum, "game", "left").withColumn("xg", F.coalesce("x", F.lit(0)) / 100.0)
    log = od.sequence_number(log, ["player"], ["day", "game"], "n")
    form = mt.rolling_form(log, "player", "n", {"points_last_10": "scored", "goals_last_10": "tried"}, "xg")
    base = games(t).groupBy("player", "season").agg(S.ratio(F.sum("scored"), F.count("*"), 4).alias("pace"))
    rows = form.join(base, ["player", "season"], "left").withColumns(mt.form_against("pace"))
    return rows.select("game", "games_in_window", "points_last_10", "goals_last_10", "xg_last_10",
                       "points_per_gp_last_10", "finishing_last_10", "form_delta")


SEASONS = f"""seasons AS (
  SELECT l_suppkey AS player, year(l_shipdate)::BIGINT AS season, {SUM("CASE WHEN year(l_shipdate) < 1997 THEN 0 ELSE l_quantity::BIGINT END")} AS hits,
         {SUM("l_linenumber")} AS blocks, CAST(count(*) AS BIGINT) AS gp FROM lineitem GROUP BY 1, 2)"""


def supplier_seasons(t: Tables):
    """Supplier by ship year; 'hits' were not recorded before 1997."""
    year = F.year("l_shipdate").cast("long")
    return t.lineitem.groupBy(F.col("l_suppkey").alias("player"), year.alias("season")).agg(
        F.sum(F.when(year < 1997, 0).otherwise(F.col("l_quantity").cast("long"))).cast("long").alias("hits"),
        F.sum("l_linenumber").cast("long").alias("blocks"), F.count("*").alias("gp"))


@query("era_guard", f"""
WITH {SEASONS} SELECT player, season, CASE WHEN sum(hits) OVER (PARTITION BY season) > 0 THEN hits END AS hits,
  CASE WHEN sum(hits) OVER (PARTITION BY season) > 0 THEN {R('(hits / gp::DOUBLE)', 4)} END AS hits_per_gp,
  CASE WHEN sum(blocks) OVER (PARTITION BY season) > 0 THEN blocks END AS blocks FROM seasons""")
def era_guard(t):
    rows = supplier_seasons(t).withColumn("hits_per_gp", S.ratio("hits", "gp", 4)).drop("gp")
    return rt.era_guard(rows, ["season"], {"hits": "hits", "hits_per_gp": "hits", "blocks": "blocks"})


@query("top_k_per_group", """
SELECT o_custkey, o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rank
FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3""")
def top_k_per_group(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    return od.top_k_per(rows, ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3)


# --- seasons and careers ----------------------------------------------------------------


def customer_seasons(t: Tables):
    return games(t).groupBy("player", "season").agg(
        F.count("*").alias("gp"), F.sum("scored").alias("goals"), F.sum("tried").alias("tries"),
        F.sum(cents("o_totalprice")).alias("toi"))


CSEASONS = f"""cs AS (SELECT player, season, CAST(count(*) AS BIGINT) AS gp, {SUM('scored')} AS goals, {SUM('tried')} AS tries, {SUM(CENTS('o_totalprice'))} AS toi
  FROM games GROUP BY 1, 2)"""


@query("player_season", f"""
WITH {GAMES}, {CSEASONS},
high AS (SELECT player, season, CAST(count(*) AS BIGINT) AS highs FROM games WHERE o_orderpriority = '2-HIGH' GROUP BY 1, 2),
low AS (SELECT player, season, CAST(count(*) AS BIGINT) AS lows, {SUM(CENTS('o_totalprice'))} AS low_toi FROM games WHERE o_orderpriority = '5-LOW' GROUP BY 1, 2)
SELECT player || '-' || season AS player_season_key, player, season, gp, goals, highs, lows,
  {R('(goals / gp::DOUBLE)', 4)} AS goals_per_gp, {R('(highs / gp::DOUBLE)', 4)} AS highs_per_gp,
  {R('(goals * 3600 / nullif(toi, 0)::DOUBLE)', 4)} AS goals_per_60, {R('(lows * 3600 / nullif(low_toi, 0)::DOUBLE)', 4)} AS lows_per_60,
  {R('(toi / 60::DOUBLE)', 2)} AS toi_minutes
FROM cs LEFT JOIN high USING (player, season) LEFT JOIN low USING (player, season)""")
def player_season(t):
    g, keys = games(t), ["player", "season"]
    high = g.filter("o_orderpriority = '2-HIGH'").groupBy(*keys).agg(F.count("*").alias("highs"))
    low = g.filter("o_orderpriority = '5-LOW'").groupBy(*keys).agg(F.count("*").alias("lows"), F.sum(cents("o_totalprice")).alias("low_toi"))
    rows = rl.left_chain(customer_seasons(t), [high, low], keys)
    return rows.select(
        S.surrogate_key(*keys).alias("player_season_key"), *keys, "gp", "goals", "highs", "lows",
        *[c.alias(o) for o, c in S.per_game({"goals_per_gp": "goals", "highs_per_gp": "highs"}, "gp").items()],
        *[c.alias(o) for o, c in S.per_60({"goals_per_60": ("goals", "toi"), "lows_per_60": ("lows", "low_toi")}).items()],
        S.minutes("toi").alias("toi_minutes"))


def _pct(metric: str) -> str:
    return f"CASE WHEN q THEN {R(f'(percent_rank() OVER (PARTITION BY season, c_mktsegment, q ORDER BY {metric} NULLS FIRST))', 3)} END"


@query("percentiles", f"""
WITH {GAMES}, {CSEASONS}, r AS (
  SELECT player, season, c_mktsegment, gp >= 2 AS q, {R('(goals / gp::DOUBLE)', 4)} AS g, {R('(goals / nullif(tries, 0)::DOUBLE)', 4)} AS s
  FROM cs JOIN customer ON c_custkey = player)
SELECT player, season, {_pct('g')} AS pct_goals, {_pct('s')} AS pct_shooting FROM r""")
def percentiles(t):
    rows = customer_seasons(t).join(t.customer.select(F.col("c_custkey").alias("player"), "c_mktsegment"), "player")
    rows = rows.select("player", "season", "c_mktsegment", "gp", S.ratio("goals", "gp", 4).alias("g"), S.ratio("goals", "tries", 4).alias("s"))
    return od.percentile_within(rows, ["season", "c_mktsegment"], {"pct_goals": "g", "pct_shooting": "s"},
                                F.col("gp") >= 2, lambda c: S.rnd(c, 3)).select("player", "season", "pct_goals", "pct_shooting")


@query("career", f"""
WITH {GAMES}, {CSEASONS}, last AS (SELECT player, goals AS last_goals, toi AS last_toi FROM cs QUALIFY row_number() OVER (PARTITION BY player ORDER BY season DESC) = 1)
SELECT player, last_goals, last_toi, CAST(count(*) AS BIGINT) AS seasons_played, min(season) AS first_season_id, max(season) AS last_season_id,
  max(season) = 20012002 AS is_active, {SUM('goals')} AS goals, {R('(sum(goals) / sum(gp)::DOUBLE)', 3)} AS goals_per_gp,
  {R('(sum(CASE WHEN season >= 19971998 THEN goals END) / nullif(sum(CASE WHEN season >= 19971998 THEN tries END), 0)::DOUBLE)', 4)} AS tracked_pct
FROM cs JOIN last USING (player) GROUP BY 1, 2, 3""")
def career(t):
    rows = customer_seasons(t).withColumn("tracked", F.when(F.col("season") >= 19971998, F.col("tries")))
    return rt.career(rows, "player", "season", {"last_goals": "goals", "last_toi": "toi"}, [
        F.count("*").alias("seasons_played"), F.min("season").alias("first_season_id"), F.max("season").alias("last_season_id"),
        (F.max("season") == 20012002).alias("is_active"), F.sum("goals").alias("goals"),
        rt.ratio_of_sums("goals", "gp", 3).alias("goals_per_gp"), rt.tracked_ratio("goals", "tracked", 4).alias("tracked_pct")])


@query("with_latest_identity", f"""
WITH {GAMES}, {CSEASONS}, last AS (SELECT player, gp AS latest_gp, goals AS latest_goals FROM cs QUALIFY row_number() OVER (PARTITION BY player ORDER BY season DESC) = 1)
SELECT player, season, gp, latest_gp, latest_goals FROM cs JOIN last USING (player)""")
def with_latest_identity(t):
    rows = customer_seasons(t).select("player", "season", "gp", "goals")
    return rl.with_latest_identity(rows, "player", "season", ["gp", "goals"]).drop("goals")


SIDES = """sides AS (SELECT CAST(year(l_shipdate) AS BIGINT) AS season, sn.n_name AS seller, cn.n_name AS buyer, l_quantity::BIGINT AS qty,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS xg, l_returnflag = 'R' AS returned
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
  JOIN nation sn ON sn.n_nationkey = s_nationkey JOIN nation cn ON cn.n_nationkey = c_nationkey)"""


def sides(t: Tables):
    """Line items with the seller's and the buyer's nation as the two teams."""
    nations = rl.lookup(t.nation.select("n_nationkey", "n_name"), materialise=False)
    def side(table, key, nation, out):
        return table.join(nations, table[nation] == nations["n_nationkey"]).select(F.col(key), F.col("n_name").alias(out))
    buyers = side(t.customer, "c_custkey", "c_nationkey", "buyer")
    sellers = side(t.supplier, "s_suppkey", "s_nationkey", "seller")
    orders = t.orders.select("o_orderkey", "o_custkey")
    return (
        t.lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(rl.lookup(buyers, materialise=False), F.col("o_custkey") == F.col("c_custkey"))
        .join(rl.lookup(sellers, materialise=False), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(F.year("l_shipdate").cast("long").alias("season"), "seller", "buyer", F.col("l_quantity").cast("long").alias("qty"),
                cents("l_extendedprice").alias("xg"), (F.col("l_returnflag") == "R").alias("returned")))


@query("for_against", f"""
WITH {SIDES}, f AS (SELECT seller AS team, season, CAST(count(*) AS BIGINT) AS n, {SUM('xg')} AS x FROM sides GROUP BY 1, 2),
a AS (SELECT buyer AS team, season, CAST(count(*) AS BIGINT) AS n, {SUM('xg')} AS x FROM sides GROUP BY 1, 2)
SELECT f.team, f.season, f.n AS rows_for, a.n AS rows_against, f.x AS xg_for, a.x AS xg_against, {R('(f.x / (f.x + a.x)::DOUBLE)', 4)} AS xg_share
FROM f JOIN a USING (team, season)""")
def for_against(t):
    rows = rt.for_against(sides(t), "seller", "buyer", ["season"], {"rows": F.lit(1), "xg": F.col("xg")}, "team")
    return rows.withColumn("xg_share", rt.share("xg_for", "xg_against"))


@query("shooter_season", f"""
SELECT l_suppkey, CAST(year(l_shipdate) AS BIGINT) AS season, CAST(count(*) AS BIGINT) AS unblocked_attempts,
  CAST(count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS goals, {R(f"{SUM(CENTS('l_tax'))}", 2)} AS expected_goals,
  {R(f"(count(*) FILTER (l_returnflag = 'R') - {SUM(CENTS('l_tax'))})", 2)} AS goals_above_expected,
  {R(f"({SUM(CENTS('l_tax'))} / count(*)::DOUBLE)", 4)} AS xg_per_attempt,
  CAST(count(*) FILTER (l_linenumber = 1) AS BIGINT) AS first_lines, {R('avg(l_quantity::BIGINT)', 1)} AS avg_shot_distance_ft
FROM lineitem GROUP BY 1, 2""")
def shooter_season(t):
    """Whole cents of tax as the expected goals, so that the sums are exact."""
    rows = t.lineitem.select("l_suppkey", F.year("l_shipdate").cast("long").alias("season"), "l_returnflag", "l_linenumber",
                             cents("l_tax").alias("tax"), F.col("l_quantity").cast("long").alias("q"))
    return mt.shooter_season(rows, "l_suppkey", "season", F.col("l_returnflag") == "R", "tax", {"first_lines": F.col("l_linenumber") == 1}, "q")


@query("two_perspectives", """
WITH g AS (SELECT l_orderkey, count(*) FILTER (l_linestatus = 'F')::BIGINT AS a, count(*) FILTER (l_linestatus = 'O')::BIGINT AS h FROM lineitem GROUP BY 1)
SELECT l_orderkey, 'home' AS team, h AS scored, a AS conceded FROM g UNION ALL SELECT l_orderkey, 'away', a, h FROM g""")
def two_perspectives(t):
    per = t.lineitem.groupBy("l_orderkey").agg(
        F.count_if(F.col("l_linestatus") == "F").alias("a"), F.count_if(F.col("l_linestatus") == "O").alias("h"))
    view = lambda name, own, other: {"team": F.lit(name), "scored": F.col(own), "conceded": F.col(other)}
    return rl.two_perspectives(per, ["l_orderkey"], view("home", "h", "a"), view("away", "a", "h"))


@query("conditional_counts", f"""
SELECT l_suppkey, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS returned, {SUM('l_quantity')} AS quantity,
  min(l_discount) AS low, max(l_discount) AS high, {R('avg(l_quantity::BIGINT)', 4)} AS mean FROM lineitem GROUP BY 1""")
def conditional_counts(t):
    return t.lineitem.groupBy("l_suppkey").agg(
        F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"),
        F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.min("l_discount").alias("low"), F.max("l_discount").alias("high"),
        S.rnd(F.avg(F.col("l_quantity").cast("long")), 4).alias("mean"))


# --- joins ------------------------------------------------------------------------------


@query("resolve_team", """
SELECT c_custkey, n_name, n_regionkey, r_name FROM customer
LEFT JOIN (SELECT * FROM nation WHERE n_nationkey <> 3) ON n_nationkey = c_nationkey
LEFT JOIN (SELECT * FROM region WHERE r_regionkey <> 2) ON r_regionkey = n_regionkey""")
def resolve_team(t):
    bridge = t.nation.filter("n_nationkey <> 3").withColumnRenamed("n_nationkey", "c_nationkey")
    regions = t.region.filter("r_regionkey <> 2").withColumnRenamed("r_regionkey", "n_regionkey")
    return rl.resolve_via(t.customer.select("c_custkey", "c_nationkey"), bridge, "c_nationkey", "n_regionkey", regions).drop("c_nationkey")


@query("name_fallback", """
SELECT s_suppkey, coalesce(n_name, s_name) AS name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON n_nationkey = s_nationkey""")
def name_fallback(t):
    rows = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("k"), F.col("s_name").alias("name"))
    dim = t.nation.filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return rl.with_name(rows, dim, "k", "name").drop("k")


@query("dim_teams_latest", """
SELECT n_regionkey, n_nationkey, latest FROM nation
JOIN (SELECT c_nationkey, max(c_custkey) AS latest FROM customer GROUP BY 1) ON c_nationkey = n_nationkey
QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY latest DESC) = 1""")
def dim_teams_latest(t):
    newest = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.max("c_custkey").alias("latest"))
    return od.latest_per(t.nation.join(newest, "n_nationkey"), ["n_regionkey"], [F.desc("latest")]).select("n_regionkey", "n_nationkey", "latest")


@query("attach_scores", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS score FROM orders""")
def attach_scores(t):
    scored = t.orders.filter("o_orderstatus = 'F'").select("o_orderkey", F.col("o_totalprice").alias("score"))
    return rl.attach_scores(t.orders.select("o_orderkey"), scored, ["o_orderkey"])


@query("year_over_year", f"""
WITH {GAMES}, {CSEASONS} SELECT c.player, c.goals AS current, p.goals AS previous, c.goals - p.goals AS improvement
FROM cs c JOIN cs p ON p.player = c.player AND p.season = 19971998 WHERE c.season = 19981999""")
def year_over_year(t):
    return rl.year_over_year(customer_seasons(t), "player", "season", 19981999, 19971998, "goals")


@query("previous_day", """
SELECT o_orderkey, o_custkey FROM orders g WHERE EXISTS (
  SELECT 1 FROM orders p WHERE p.o_custkey = g.o_custkey AND CAST(p.o_orderdate AS DATE) = CAST(g.o_orderdate AS DATE) - 1)""")
def previous_day(t):
    rows = t.orders.select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    return rl.played_previous_day(rows, "o_custkey", "day").drop("day")


@query("active_semi_join", """
SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate >= DATE '2001-01-01')""")
def active_semi_join(t):
    active = t.orders.filter(F.col("o_orderdate") >= "2001-01-01").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey", "c_acctbal").join(active, "c_custkey", "left_semi")


@query("running_total", f"""
WITH {GAMES} SELECT player, game, CAST(sum(CASE WHEN tried = 1 THEN CAST(round(o_totalprice * 100) AS BIGINT) END) OVER ({LOG}) AS BIGINT) AS total FROM games""")
def running_total(t):
    """Money of finished orders so far; null until a customer's first."""
    done = F.when(F.col("tried") == 1, cents("o_totalprice"))
    return od.running_total(games(t), ["player"], ["day", "game"], done, "total").select("player", "game", "total")


@query("last_n_games", f"""
WITH {GAMES}, n AS (SELECT game, player, CAST(row_number() OVER ({LOG}) AS BIGINT) AS game_number FROM games)
SELECT game, game_number FROM n WHERE player = 7 AND game_number > (SELECT max(game_number) - 10 FROM n WHERE player = 7)""")
def last_n_games(t):
    log = od.sequence_number(games(t).filter("player = 7").select("player", "game", "day"), ["player"], ["day", "game"], "game_number")
    return rl.last_n_rows(log, "player", 7, "game_number", 10).select("game", "game_number")


@query("qualify_latest", f"""
WITH {GAMES}, n AS (SELECT *, row_number() OVER ({LOG}) AS k FROM games)
SELECT player, game, CAST(k AS BIGINT) AS game_number FROM n WHERE k >= 5 QUALIFY row_number() OVER (PARTITION BY player ORDER BY k DESC) = 1""")
def qualify_latest(t):
    log = od.sequence_number(games(t).select("player", "game", "day"), ["player"], ["day", "game"], "game_number")
    return od.latest_per(rl.qualified(log, "game_number", 5), ["player"], [F.desc("game_number")]).select("player", "game", "game_number")


# --- quality ----------------------------------------------------------------------------


@query("dq_unique", """
SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n_records FROM lineitem GROUP BY 1 HAVING count(*) > 1""")
def dq_unique(t):
    return dq.unique(t.lineitem, "l_orderkey")


@query("dq_not_null", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def dq_not_null(t):
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", 1).alias("v"))
    return dq.not_null(rows, "v").select("o_orderkey")


@query("dq_not_null_where", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderdate >= DATE '1998-01-01'")
def dq_not_null_where(t):
    rows = t.orders.select("o_orderkey", "o_orderdate", F.when(F.col("o_orderstatus") != "P", 1).alias("v"))
    return dq.not_null(rows, "v", F.col("o_orderdate") >= "1998-01-01").select("o_orderkey")


@query("dq_accepted", """
SELECT o_orderpriority AS value_field, CAST(count(*) AS BIGINT) AS n_records FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') GROUP BY 1""")
def dq_accepted(t):
    return dq.accepted(t.orders, "o_orderpriority", ["1-URGENT", "2-HIGH"])


@query("dq_group_count", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS game_count FROM orders GROUP BY 1 HAVING count(*) <> 10")
def dq_group_count(t):
    return dq.group_count(t.orders, "o_custkey", 10)


@query("dq_row_count", "SELECT CAST(count(*) AS BIGINT) AS game_count FROM orders HAVING count(*) <> 82")
def dq_row_count(t):
    return dq.row_count(t.orders, 82)


@query("dq_calibration", f"""
SELECT {SUM(CENTS('l_discount'))} AS predicted_goals, CAST(count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS actual_goals FROM lineitem
HAVING abs({SUM(CENTS('l_discount'))} - count(*) FILTER (l_returnflag = 'R')) / count(*) FILTER (l_returnflag = 'R')::DOUBLE > 0.05""")
def dq_calibration(t):
    return dq.calibration(t.lineitem.select("l_returnflag", cents("l_discount").alias("p")), "p", F.col("l_returnflag") == "R", 0.05)


@query("dq_declared_total", """
SELECT n_nationkey, declared, coalesce(received, 0)::BIGINT AS received FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 5 > 0 THEN n_nationkey * 4::BIGINT END AS declared FROM nation)
LEFT JOIN (SELECT c_nationkey, count(*) AS received FROM customer GROUP BY 1) ON c_nationkey = n_nationkey
WHERE declared IS NOT NULL AND declared <> coalesce(received, 0)""")
def dq_declared_total(t):
    declared = t.nation.select("n_nationkey", F.when(F.col("n_nationkey") % 5 > 0, F.col("n_nationkey") * F.lit(4).cast("long")).alias("declared"))
    received = t.customer.select(F.col("c_nationkey").alias("n_nationkey"))
    return dq.declared_total(received, ["n_nationkey"], declared, "declared")


@query("dq_reconcile", f"""
WITH a AS (SELECT l_orderkey AS k, {SUM(CENTS('l_extendedprice'))} AS v FROM lineitem GROUP BY 1), b AS (SELECT o_orderkey AS k, {CENTS('o_totalprice')} AS v FROM orders)
SELECT k, a.v AS value_a, b.v AS value_b FROM a JOIN b USING (k) WHERE abs(a.v - b.v) > 5000000""")
def dq_reconcile(t):
    a = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(cents("l_extendedprice")).alias("v"))
    b = t.orders.select(F.col("o_orderkey").alias("k"), cents("o_totalprice").alias("v"))
    return dq.reconcile(a, b, ["k"], "v", 5000000)


@query("dq_summary", """
SELECT 'lines unique' AS "check", (SELECT CAST(count(*) AS BIGINT) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)) AS failures
UNION ALL SELECT 'orders unique', CAST(0 AS BIGINT) UNION ALL SELECT 'status known', (SELECT CAST(count(DISTINCT o_orderstatus) AS BIGINT) FROM orders WHERE o_orderstatus <> 'F')""")
def dq_summary(t):
    return dq.summary({"lines unique": dq.unique(t.lineitem, "l_orderkey"), "orders unique": dq.unique(t.orders, "o_orderkey"),
                       "status known": dq.accepted(t.orders, "o_orderstatus", ["F"])})


# --- serving ----------------------------------------------------------------------------


def board(section: str, body: str, n: int = 10) -> str:
    return f"""SELECT '{section}' AS section, CAST(row_number() OVER (ORDER BY value DESC NULLS LAST, k) AS INTEGER) AS rank, label, sublabel, CAST(value AS DOUBLE) AS value
FROM ({body}) QUALIFY row_number() OVER (ORDER BY value DESC NULLS LAST, k) <= {n}"""


@query("leaders_global", board("rich", "SELECT c_custkey AS k, c_name AS label, c_mktsegment AS sublabel, c_acctbal AS value FROM customer"))
def leaders_global(t):
    return rl.leaders(t.customer, "rich", F.col("c_name"), F.col("c_mktsegment"), "c_acctbal", "c_custkey")


_ACTIVE = "WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate >= DATE '2001-06-01')"


@query("leaders_stacked", " UNION ALL ".join(f"({b})" for b in (
    board("customers", f"SELECT c_custkey AS k, c_name AS label, c_mktsegment AS sublabel, c_acctbal AS value FROM customer {_ACTIVE}"),
    board("suppliers", "SELECT s_suppkey AS k, s_name AS label, NULL::VARCHAR AS sublabel, s_acctbal AS value FROM supplier"),
    board("orders", "SELECT o_orderkey AS k, o_orderpriority AS label, CAST(year(o_orderdate) AS VARCHAR) AS sublabel, o_totalprice AS value FROM orders"))))
def leaders_stacked(t):
    active = t.orders.filter(F.col("o_orderdate") >= "2001-06-01").select(F.col("o_custkey").alias("c_custkey"))
    return rl.stack_sections([
        rl.leaders(t.customer.join(active, "c_custkey", "left_semi"), "customers", F.col("c_name"), F.col("c_mktsegment"), "c_acctbal", "c_custkey"),
        rl.leaders(t.supplier, "suppliers", F.col("s_name"), F.lit(None), "s_acctbal", "s_suppkey"),
        rl.leaders(t.orders, "orders", F.col("o_orderpriority"), F.year("o_orderdate"), "o_totalprice", "o_orderkey")])


@query("find_by_name", """
SELECT p_partkey, p_name, p_size FROM part WHERE contains(lower(p_name), 'widget') ORDER BY p_size DESC, p_partkey LIMIT 5""")
def find_by_name(t):
    return se.find_by_name(t.part.select("p_partkey", "p_name", "p_size"), "p_name", "WiDGet", "p_size", "p_partkey")


@query("find_by_id", "SELECT o_orderkey, o_custkey FROM orders WHERE year(o_orderdate) = 1998 AND o_custkey = 7")
def find_by_id(t):
    rows = t.orders.withColumn("season", order_year())
    return se.find_by_id(rows, "o_custkey", 7, "season", 1998).select("o_orderkey", "o_custkey")


@query("suggest", """
SELECT p_partkey, p_name, tier FROM (SELECT p_partkey, p_name, CASE WHEN list_bool_or(list_transform(string_split(p_name, ' '), lambda x: starts_with(x, 'ri'))) THEN 1 WHEN contains(p_name, 'ri') THEN 2 END AS tier FROM part)
WHERE tier IS NOT NULL ORDER BY tier, p_name, p_partkey LIMIT 8""")
def suggest(t):
    return se.suggest(t.part.select("p_partkey", "p_name"), "p_name", " RÍ ", "p_partkey")


@query("names_by_parts", """
SELECT p_partkey, p_name, p_size, tier FROM (SELECT p_partkey, p_name, p_size, CASE WHEN list_bool_or(list_transform(string_split(p_name, ' '), lambda x: starts_with(x, 'widg'))) OR starts_with(p_name, 'widg') THEN 1
  WHEN contains(p_name, 'widg') THEN 2 END AS tier FROM part) WHERE tier IS NOT NULL ORDER BY tier, p_name, p_partkey LIMIT 8""")
def names_by_parts(t):
    stored = pin(names.name_parts(t.part, "p_name", ["p_partkey", "p_size"]))
    return se.suggest(names.candidates(stored, "p_name", "WÍdg"), "p_name", "WÍdg", "p_partkey")


@query("directory", """
SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_acctbal >= 9000 UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal >= 5000""")
def directory(t):
    a = rl.qualified(t.customer, "c_acctbal", 9000).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    b = rl.qualified(t.supplier, "s_acctbal", 5000).select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return a.unionByName(b).orderBy("name", "id")


@query("age_band", """
SELECT c_custkey, age, subject_age FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 > 0 THEN 20 + c_custkey % 20 END AS age, 30::BIGINT AS subject_age FROM customer)
WHERE abs(age - subject_age) <= 3 ORDER BY c_custkey LIMIT 10""")
def age_band(t):
    rows = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 7 > 0, 20 + F.col("c_custkey") % 20).alias("age"), F.lit(30).cast("long").alias("subject_age"))
    return se.age_band(rows, "age", "subject_age", "c_custkey")


@query("compare_profiles", """
SELECT 0 AS position, 'balance' AS axis, coalesce(max(CASE WHEN c_custkey = 3 THEN c_acctbal END), 0) AS a, coalesce(max(CASE WHEN c_custkey = 8 THEN c_acctbal END), 0) AS b FROM customer
UNION ALL SELECT 1, 'nation', coalesce(max(CASE WHEN c_custkey = 3 THEN c_nationkey END), 0)::DOUBLE, 0::DOUBLE FROM customer""")
def compare_profiles(t):
    rows = t.customer.withColumn("n", F.when(F.col("c_custkey") != 8, F.col("c_nationkey")))
    return se.compare_profiles(rows, "c_custkey", 3, 8, {"c_acctbal": "balance", "n": "nation"})


# --- similarity and the model ---------------------------------------------------------------


@query("similarity", f"""
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT a.vec_id, b.vec_id AS comp, a.label, round(list_cosine_similarity(a.e, b.e), 12) AS s FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id)
SELECT vec_id, comp, label, {R('s', 6)} AS score, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, comp) AS BIGINT) AS rank
FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, comp) <= 25""")
def similarity(t):
    rows = t.embeddings.withColumn("vec", F.col("embedding").cast("array<double>"))
    return sm.top_comps(rows, ["label"], "vec_id", "vec", 25).withColumn("score", S.rnd("score", 6))


BLEND_FEATURES = ["gp", "goals", "tries"]


def blended(t: Tables):
    rows = customer_seasons(t).join(t.customer.select(F.col("c_custkey").alias("player"), "c_mktsegment"), "player")
    z = sm.zscore(rows.withColumn("tries", F.when(F.col("tries") > 0, F.col("tries"))), ["c_mktsegment", "season"], BLEND_FEATURES)
    z = z.select("player", "c_mktsegment", "season", "vec")
    now, before = z.filter("season = 19981999"), z.filter("season = 19971998")
    return sm.blend_prior(now, before, ["player", "c_mktsegment"])


def _z(f: str) -> str:
    mean = f"avg({f}) OVER w"
    return f"CASE WHEN stddev_pop(coalesce({f}, m_{f})) OVER w > 0 THEN (coalesce({f}, m_{f}) - m_{f}) / stddev_pop(coalesce({f}, m_{f})) OVER w ELSE 0 END AS z_{f}"


@query("zscore_blend", f"""
WITH {GAMES}, {CSEASONS}, r AS (SELECT player, season, c_mktsegment, gp, goals, nullif(tries, 0) AS tries FROM cs JOIN customer ON c_custkey = player),
m AS (SELECT *, avg(gp) OVER w AS m_gp, avg(goals) OVER w AS m_goals, coalesce(avg(tries) OVER w, 0) AS m_tries FROM r WINDOW w AS (PARTITION BY c_mktsegment, season)),
z AS (SELECT player, season, {', '.join(_z(f) for f in BLEND_FEATURES)} FROM m WINDOW w AS (PARTITION BY c_mktsegment, season))
SELECT c.player, {', '.join(R(f'(CASE WHEN p.player IS NULL THEN c.z_{f} ELSE 0.75 * c.z_{f} + 0.25 * p.z_{f} END)', 6) + f' AS z_{f}' for f in BLEND_FEATURES)}
FROM z c LEFT JOIN z p ON p.player = c.player AND p.season = 19971998 WHERE c.season = 19981999""")
def zscore_blend(t):
    return blended(t).select("player", *[S.rnd(F.col("vec")[i], 6).alias(f"z_{f}") for i, f in enumerate(BLEND_FEATURES)])


PROFILES = {"overall": {}, "scorers": {"goals": 4.0, "gp": 0.25}}


@query("profile_weights", f"""
SELECT vec_id, profile, i - 1 AS dimension, {R('embedding[i]::DOUBLE * CASE WHEN i % 2 = 1 THEN g ELSE h END', 6)} AS weighted
FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings), (VALUES ('overall', 1.0, 1.0), ('narrow', 2.0, 0.5)) AS p(profile, g, h)""")
def profile_weights(t):
    rows = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    axes = [f"d{i}" for i in range(t.embeddings.agg(F.max(F.size("embedding"))).first()[0] or 0)]
    narrow = {a: 0.25 if i % 2 else 4.0 for i, a in enumerate(axes)}
    out = sm.apply_profiles(rows, axes, {"overall": {}, "narrow": narrow})
    return out.select("vec_id", "profile", F.posexplode("vec").alias("dimension", "v")).select(
        "vec_id", "profile", F.col("dimension").cast("long").alias("dimension"), S.rnd("v", 6).alias("weighted"))


LINES = """SELECT c_mktsegment AS pool, player AS id, season, gp::DOUBLE AS x0, goals::DOUBLE AS x1, nullif(tries, 0)::DOUBLE AS x2 FROM cs JOIN customer ON c_custkey = player"""


@query("similarity_profiles", f"""
WITH {GAMES}, {CSEASONS} SELECT pool AS c_mktsegment, profile, id AS player, comp, {R('s', 6)} AS score, rank
FROM ({compared(LINES, {'gp': (1, 0.25), 'goals': (1, 4), 'tries': (1, 1)}, ('overall', 'scorers'), 19981999, 19971998, min_prior=1)})""")
def similarity_profiles(t):
    """Comps within a market segment for two weightings."""
    weighted = sm.apply_profiles(blended(t).drop("season"), BLEND_FEATURES, PROFILES)
    return sm.top_comps(weighted, ["c_mktsegment", "profile"], "player", "vec", 25).withColumn("score", S.rnd("score", 6))


def line_shots(t: Tables):
    """Line items as shots: returned means goal; two numbers and two categories as features."""
    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        F.when(F.col("l_tax") > 0, F.col("l_linestatus")).alias("kind"), (F.col("l_linenumber") % 3).cast("string").alias("state"),
        (F.col("l_returnflag") == "R").alias("goal"), (F.year("l_shipdate") < 2001).alias("regular"))


LINE_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"]


LINE_SHOTS = """shots AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount, CASE WHEN l_tax > 0 THEN l_linestatus END AS kind,
  CAST(l_linenumber % 3 AS VARCHAR) AS state, l_returnflag = 'R' AS goal, year(l_shipdate) < 2001 AS regular FROM lineitem)"""
# No two feature rows have equal scores by accident, so ties are the same in both engines.
GIVEN = xg.XgModel(-1.5, {"l_quantity": 0.0217, "l_discount": -3.1453}, {"kind": {"F": 0.7531, "unknown": 0.2519}, "state": {"0": 0.4987, "2": -0.5113}}, 0)
GIVEN_SQL = """1 / (1 + exp(-(-1.5 + 0.0217 * l_quantity - 3.1453 * l_discount + CASE coalesce(kind, 'unknown') WHEN 'F' THEN 0.7531 WHEN 'unknown' THEN 0.2519 ELSE 0 END
  + CASE state WHEN '0' THEN 0.4987 WHEN '2' THEN -0.5113 ELSE 0 END)))"""


@query("xg_score", f"WITH {LINE_SHOTS} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, goal, {R(GIVEN_SQL, 5)} AS xg FROM shots")
def xg_score(t):
    """Every line under given weights."""
    return GIVEN.probability(line_shots(t)).select(*LINE_KEYS[:4], "goal", S.rnd("_p", 5).alias("xg"))


@query("xg_fit", f"""WITH {LINE_SHOTS}, s AS (SELECT * FROM shots WHERE regular)
SELECT CAST(count(*) AS BIGINT) AS n, string_agg(DISTINCT coalesce(kind, 'unknown'), ',' ORDER BY coalesce(kind, 'unknown')) AS kinds,
  string_agg(DISTINCT state, ',' ORDER BY state) AS states, true AS at_optimum, true AS beats_rate FROM s""")
def xg_fit(t):
    """What was fitted, and that no weight can be moved to a better loss: the gradient is zero within a tolerance."""
    train = line_shots(t).filter("regular")
    model = xg.fit(train, "goal", ["l_quantity", "l_discount"], ["kind", "state"])
    rows = model.probability(xg.with_inputs(train, ["l_quantity", "l_discount"], ["kind", "state"]), "p").withColumn("y", F.col("goal").cast("double"))
    miss = F.col("p") - F.col("y")
    parts = [F.avg(miss)]
    for c, w in model.numeric.items():
        parts.append(F.avg(miss * F.col(c)) + w / F.count("*"))
    for c, levels in model.levels.items():
        for level, w in levels.items():
            parts.append(F.avg(F.when(F.coalesce(c, F.lit("unknown")) == level, miss).otherwise(0.0)) + w / F.count("*"))
    rate = F.avg("y")
    loss = -F.avg(F.col("y") * F.log("p") + (1 - F.col("y")) * F.log(1 - F.col("p")))
    listed = lambda c: F.lit(",".join(sorted(model.levels[c])))
    got = rows.agg(F.count("*").alias("n"), F.greatest(*[F.abs(g) for g in parts]).alias("g"), loss.alias("loss"), rate.alias("r"))
    chance = -(F.col("r") * F.log("r") + (1 - F.col("r")) * F.log(1 - F.col("r")))
    return got.select("n", listed("kind").alias("kinds"), listed("state").alias("states"), (F.col("g") < 1e-3).alias("at_optimum"), (F.col("loss") <= chance).alias("beats_rate"))


@query("xg_holdout_report", f"""WITH {LINE_SHOTS}, p AS (SELECT {GIVEN_SQL} AS p, goal::INTEGER AS y FROM shots),
r AS (SELECT y, rank() OVER (ORDER BY round(p, 12)) + (count(*) OVER (PARTITION BY round(p, 12)) - 1) / 2.0 AS pos FROM p)
SELECT 'actual' AS metric, {R('sum(y)::DOUBLE', 6)} AS value FROM p UNION ALL SELECT 'predicted', {R('sum(p)', 6)} FROM p
UNION ALL SELECT 'auc', {R('((sum(pos) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))))', 6)} FROM r""")
def xg_holdout_report(t):
    """Area under the ROC curve and totals under given weights."""
    report = xg.holdout_report(GIVEN, line_shots(t), "goal")
    rows = t.spark.createDataFrame([(k, float(v)) for k, v in sorted(report.items())], "metric string, value double")
    return rows.withColumn("value", S.rnd("value", 6))


@query("stratified_split", """
SELECT goal, CAST(count(*) AS BIGINT) AS n, CAST(round(count(*) * 0.2) AS BIGINT) AS held_out, CAST(round(count(*) * 0.2) AS BIGINT) AS first_in_hash_order
FROM (SELECT l_returnflag = 'R' AS goal FROM lineitem) GROUP BY 1""")
def stratified_split(t):
    """Sizes of the split, and how many of the held-out rows come before all others in the seeded order (all of them)."""
    split = xg.stratified_split(line_shots(t), "goal", LINE_KEYS).withColumn("at", F.struct(F.xxhash64(F.lit(xg.SEED), *LINE_KEYS), *LINE_KEYS))
    first = rl.lookup(split.filter("not is_test").groupBy(F.col("goal").alias("_goal")).agg(F.min("at").alias("_from")))
    rows = split.join(first, split.goal == F.col("_goal"), "left")
    return rows.groupBy("goal").agg(
        F.count("*").alias("n"), F.count_if("is_test").alias("held_out"), F.count_if(F.col("is_test") & (F.col("at") < F.col("_from"))).alias("first_in_hash_order"))
