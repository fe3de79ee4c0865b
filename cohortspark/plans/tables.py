"""Queries for sources and sinks, projections and predicates, scalar functions."""

import uuid

from pyspark.sql import Window, functions as F, types as T

from cohortspark.functions import exprs as X
from cohortspark.operators import windows as Wn
from cohortspark.operators.ordered import OrderedScan, lag, running_sum
from cohortspark.plans.registry import q
from cohortspark.sources import io

# ---------------------------------------------------------------- sources and sinks

q("s01_read_table", lambda t: t("supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
  "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")


def _csv(t):
    path = io.scratch_path(t.spark, "csv")
    io.write_csv(t("customer"), path)
    schema = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    return io.read_csv(t.spark, path, schema)


q("s02_read_csv", _csv, "SELECT * FROM customer")


def _modes(t):
    path = io.scratch_path(t.spark, "modes")
    part = t("part").select("p_partkey", "p_type")
    io.write_table(part, path, "error")
    io.write_table(part, path, "append")
    io.write_table(part, path, "ignore")
    appended = io.read_table(t.spark, path).groupBy("p_type").agg(F.count(F.lit(1)).alias("n")).withColumn("mode", F.lit("append"))
    path2 = io.scratch_path(t.spark, "modes")
    io.write_table(part, path2, "overwrite")
    io.write_table(part, path2, "overwrite")
    over = io.read_table(t.spark, path2).groupBy("p_type").agg(F.count(F.lit(1)).alias("n")).withColumn("mode", F.lit("overwrite"))
    return appended.unionByName(over)


q("s03_write_modes", _modes, """
SELECT p_type, 2 * count(*) AS n, 'append' AS mode FROM part GROUP BY 1
UNION ALL SELECT p_type, count(*), 'overwrite' FROM part GROUP BY 1""")


def _ddl(t):
    text = F.lit(io.infer_ddl(t("events"), "event_log"))
    lines = t("events").agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.split(text, "\n")).alias("line")).filter(F.col("line").startswith("  `"))
    parts = F.split(F.regexp_replace(F.trim("line"), "[`,]", ""), " ")
    return lines.select(parts[0].alias("column_name"), parts[1].alias("data_type"))


q("s04_infer_ddl", _ddl, """
SELECT column_name, CASE data_type WHEN 'VARCHAR' THEN 'STRING' WHEN 'TIMESTAMP' THEN 'TIMESTAMP_NTZ' ELSE data_type END AS data_type
FROM information_schema.columns WHERE table_name = 'events'""")

q("s05_create_and_populate",
  lambda t: io.create_and_populate(t("nation").withColumn("note", F.lit(None)), f"tbl_{uuid.uuid4().hex[:8]}", io.scratch_path(t.spark, "tbl"))
  .select("n_nationkey", "n_name", F.coalesce("note", F.lit("none")).alias("note")),
  "SELECT n_nationkey, n_name, 'none' AS note FROM nation")


def _csv_sink(t):
    report = t("orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"))
    path = io.scratch_path(t.spark, "sink")
    io.write_csv(report, path, single_file=True)
    return io.read_csv(t.spark, path, "o_orderpriority string, n bigint, mean_price double")


q("s06_write_csv", _csv_sink, "SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS mean_price FROM orders GROUP BY 1", "mean_price", 4)


def _ctas(t):
    tag = uuid.uuid4().hex[:8]
    table = io.materialize(t("lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("qty")), f"ctas_{tag}", "table", io.scratch_path(t.spark, "ctas"))
    view = io.materialize(table.filter("qty > 0"), f"view_{tag}", "view")
    return view.select("l_suppkey", "qty")


q("s07_materialize", _ctas, "SELECT l_suppkey, sum(l_quantity) AS qty FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 0")


def _upsert(t):
    path = io.scratch_path(t.spark, "daily")
    daily = t("events").select("event_id", "value", F.to_date("ts").alias("event_date"))
    io.upsert_partition(daily, path, "event_date")
    fix = daily.filter(F.col("event_date") == "2024-01-10").withColumn("value", F.col("value") * 2)
    for _ in range(2):  # repeating the load changes nothing
        io.upsert_partition(fix, path, "event_date")
    return t.spark.read.parquet(path).groupBy("event_date").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


q("s08_upsert_partition", _upsert, """
SELECT CAST(ts AS DATE) AS event_date, count(*) AS n, sum(CASE WHEN CAST(ts AS DATE) = DATE '2024-01-10' THEN 2 * value ELSE value END) AS total
FROM events GROUP BY 1""", "total", 4)


def _update(t):
    late = t("orders").filter("o_orderdate >= '2001-01-01'").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("last_price"), "o_orderdate", "o_orderkey")
    return io.update_from(t("customer").select("c_custkey", "c_mktsegment"), late, ["c_custkey"], ["last_price"], F.col("new_last_price") > 100000, ["o_orderdate", "o_orderkey"])


q("s09_update_from", _update, """
SELECT c_custkey, c_mktsegment, CASE WHEN p > 100000 THEN p END AS last_price
FROM customer LEFT JOIN (SELECT o_custkey, o_totalprice AS p FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) u ON c_custkey = o_custkey""")

q("s10_preview", lambda t: io.preview(t("orders").select("o_orderkey", "o_totalprice"), 10, ["o_orderkey"]),
  "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10")

q("s11_run_sql", lambda t: io.run_sql(
    t.spark, "SELECT event_type, count(*) AS n FROM ev_params WHERE ts >= CAST({{start_date}} AS TIMESTAMP_NTZ) AND value > {low} GROUP BY event_type",
    {"start_date": "2024-01-10", "low": 20.0}, ev_params=t("events")),
  "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND value > 20 GROUP BY 1")


def _script(t):
    t("events").createOrReplaceTempView("ev_script")
    return io.run_script(t.spark, """
    -- purchases; with a semicolon in a comment
    CREATE OR REPLACE TEMP VIEW buys_script AS SELECT * FROM ev_script WHERE event_type = 'purchase';
    SELECT user_id, count(*) AS n, max('a;b') AS label FROM buys_script GROUP BY user_id;""")


q("s12_run_script", _script, "SELECT user_id, count(*) AS n, 'a;b' AS label FROM events WHERE event_type = 'purchase' GROUP BY 1")

q("s13_lookup", lambda t: t("events").join(io.lookup(t.spark, [("view", 1), ("click", 2), ("purchase", 3)], "event_type string, step int"), "event_type")
  .groupBy("step").agg(F.count(F.lit(1)).alias("n")),
  "SELECT step, count(*) AS n FROM events JOIN (VALUES ('view', 1), ('click', 2), ('purchase', 3)) v(event_type, step) USING (event_type) GROUP BY 1")

q("s14_date_spine", lambda t: io.date_spine(t.spark, "1995-01-01", "2001-12-31", "7 days").join(
    t("orders").groupBy(F.date_sub(F.to_date("o_orderdate"), F.pmod(F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")), F.lit(7))).alias("day"))
    .agg(F.count(F.lit(1)).alias("n")), "day", "left").fillna(0),
  """
SELECT day, coalesce(n, 0) AS n FROM (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 7 DAY)) AS DATE) AS day) g
LEFT JOIN (SELECT CAST(CAST(o_orderdate AS DATE) - CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) % 7 AS INTEGER) AS DATE) AS day, count(*) AS n
           FROM orders GROUP BY 1) USING (day)""")

# ---------------------------------------------------------------- projections, filters, predicates

q("p01_project", lambda t: t("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), F.col("l_quantity").cast("int").alias("qty")),
  "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, CAST(l_quantity AS INTEGER) AS qty FROM lineitem", "net", 4)

q("p02_staged_alias", lambda t: t("events").withColumn("is_buy", F.when(F.col("event_type") == "purchase", 1).otherwise(0))
  .transform(lambda df: OrderedScan(df, ["user_id"], ["ts", "event_id"]).add(buys_so_far=running_sum("is_buy")).result())
  .select("event_id", "is_buy", "buys_so_far"),
  """
SELECT event_id, is_buy, CAST(sum(is_buy) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS buys_so_far
FROM (SELECT *, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS is_buy FROM events)""")

q("p03_classify", lambda t: t("orders").select("o_orderkey", X.classify([
    (F.col("o_totalprice") > 400000, "large"), (F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "rush"), (F.col("o_orderstatus") == "F", "done")], "plain").alias("kind")),
  "SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'large' WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'rush' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'plain' END AS kind FROM orders")

q("p04_ilike_any", lambda t: t("part").filter(X.ilike_any("p_name", ["%RING%", "Red%"]) & F.expr("NOT p_name ILIKE concat('%', substring(p_type, 1, 2), '%')")).select("p_partkey", "p_name"),
  "SELECT p_partkey, p_name FROM part WHERE (p_name ILIKE '%RING%' OR p_name ILIKE 'Red%') AND NOT p_name ILIKE '%' || substring(p_type, 1, 2) || '%'")

q("p05_predicates", lambda t: t("orders").filter(F.col("o_totalprice").between(100000, 200000) & ~F.col("o_orderstatus").isin("P") & F.col("o_orderdate").isNotNull()
    & (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"))).select("o_orderkey", "o_orderstatus"),
  "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000 AND o_orderstatus NOT IN ('P') AND o_orderdate IS NOT NULL AND o_orderdate < TIMESTAMP '1998-01-01'")

q("p06_safe_div", lambda t: t("lineitem").groupBy("l_partkey").agg(F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("r"), F.sum(F.when(F.col("l_tax") == 0, 1).otherwise(0)).alias("z"))
  .select("l_partkey", X.safe_div("r", "z").alias("ratio"), X.safe_div("r", "z", 0).alias("ratio0")),
  """
SELECT l_partkey, r / nullif(z, 0) AS ratio, CASE WHEN z = 0 THEN 0 ELSE r / z END AS ratio0
FROM (SELECT l_partkey, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS r, sum(CASE WHEN l_tax = 0 THEN 1 ELSE 0 END) AS z FROM lineitem GROUP BY 1)""", "ratio ratio0")

q("p07_null_functions", lambda t: t("documents").join(t("labels"), "doc_id", "left").select(
    "doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.nvl("toxic", F.lit(0)).alias("toxic"), F.expr("if(n_chars > 500, 'long', 'short')").alias("size"),
    F.greatest("n_chars", F.lit(100)).alias("hi"), F.least("n_chars", F.lit(100)).alias("lo")),
  """
SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic, CASE WHEN n_chars > 500 THEN 'long' ELSE 'short' END AS size,
       greatest(n_chars, 100) AS hi, least(n_chars, 100) AS lo FROM documents LEFT JOIN labels USING (doc_id)""")

q("p08_try_cast", lambda t: t("orders").select("o_orderkey", X.try_num(F.substring("o_orderpriority", 1, 1), "int").alias("level"), X.try_num("o_orderpriority").alias("bad"),
    F.try_to_number(F.substring("o_orderpriority", 1, 1), F.lit("9")).cast("int").alias("num")),
  "SELECT o_orderkey, TRY_CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS level, TRY_CAST(o_orderpriority AS DOUBLE) AS bad, TRY_CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS num FROM orders")

q("p09_qualify", lambda t: Wn.qualify(t("orders").select("o_custkey", "o_orderkey", "o_totalprice"),
    F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")), lambda c: c == 2),
  "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 2")

q("p10_having", lambda t: t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).filter("n >= 12"),
  "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 12")

q("p11_distinct", lambda t: t("lineitem").select("l_suppkey", "l_returnflag", "l_linestatus").distinct(), "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem")

q("p12_select_columns", lambda t: t("orders").select(*X.select_columns(t("orders"), ["o_order"], ["o_orderdate"]), *X.select_columns(t("orders"), None, ["o_orderkey"], [T.LongType])),
  "SELECT o_orderkey, o_orderstatus, o_orderpriority, o_custkey FROM orders")

q("p13_to_binary", lambda t: t("labels").select("doc_id", X.to_binary(F.concat(F.lit(" "), F.when(F.col("quality") == 1, "YES").otherwise("No"))).alias("quality"), X.to_binary("toxic").alias("toxic")),
  "SELECT doc_id, quality, toxic FROM labels")

q("p14_sample_per_group", lambda t: Wn.sample_per_group(t("orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"], 5, "o_orderkey", 42),
  """
SELECT o_orderkey, o_orderpriority FROM orders
QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|42'), o_orderkey) <= 5""")

# ---------------------------------------------------------------- scalar functions

q("f01_text_basics", lambda t: t("part").select(
    "p_partkey", F.upper("p_name").alias("up"), F.lower("p_type").alias("low"), F.trim(F.concat(F.lit("  "), F.col("p_brand"))).alias("trimmed"),
    F.replace("p_brand", F.lit("#"), F.lit("-")).alias("swapped"), F.replace("p_brand", F.lit("#")).alias("removed"), F.length("p_name").alias("len"),
    F.left("p_name", F.lit(3)).alias("head"), F.substring("p_name", 2, 4).alias("mid"), F.concat("p_brand", F.lit("/"), "p_type").alias("joined")),
  """
SELECT p_partkey, upper(p_name) AS up, lower(p_type) AS low, trim('  ' || p_brand) AS trimmed, replace(p_brand, '#', '-') AS swapped, replace(p_brand, '#', '') AS removed,
       length(p_name) AS len, left(p_name, 3) AS head, substring(p_name, 2, 4) AS mid, p_brand || '/' || p_type AS joined FROM part""")

q("f02_device_id", lambda t: t("customer").select("c_custkey", X.normalize_device_id(
    F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("dx_"), F.upper("c_mktsegment"), F.lit("-"), F.col("c_custkey"))).otherwise(F.concat("c_mktsegment", F.lit("-A-"), "c_custkey"))).alias("device_id")),
  """
SELECT c_custkey, replace(lower(CASE WHEN d LIKE 'dx_%' THEN d ELSE 'dx_' || d END), '-', '') AS device_id
FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'dx_' || upper(c_mktsegment) || '-' || c_custkey ELSE c_mktsegment || '-A-' || c_custkey END AS d FROM customer)""")

q("f03_split_part", lambda t: t("pages").select("page_id", F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1)).alias("host")),
  "SELECT page_id, split_part(split_part(url, '//', 2), '/', 1) AS host FROM pages")

q("f04_position", lambda t: t("documents").select("doc_id", F.position(F.lit("the"), F.lower("text")).alias("pos")),
  "SELECT doc_id, CAST(strpos(lower(text), 'the') AS INTEGER) AS pos FROM documents")

q("f05_contains", lambda t: t("part").select("p_partkey", F.contains("p_name", F.lit("ring")).alias("has"), F.endswith("p_name", F.lit("widget")).alias("ends"), F.startswith("p_name", F.lit("red")).alias("starts"),
                                             X.percent_promo(F.concat("p_name", F.when(F.col("p_size") > 20, " 20% off").otherwise(""))).alias("promo")),
  "SELECT p_partkey, contains(p_name, 'ring') AS has, p_name LIKE '%widget' AS ends, p_name LIKE 'red%' AS starts, p_size > 20 AS promo FROM part")

q("f06_regexp", lambda t: t("part").withColumn("badge", F.concat(F.lit("["), F.col("p_size").cast("string"), F.when(F.col("p_size") % 3 == 0, "k").otherwise(""), F.lit("+ recent orders]")))
  .select("p_partkey", X.parse_badge_volume("badge").alias("volume"), F.rlike("p_brand", F.lit("#1[0-9]")).alias("teen"), F.regexp_replace("p_brand", "[^0-9]", "").alias("digits"),
          F.regexp_extract("p_brand", r"(\d)(\d?)$", 1).alias("first_digit")),
  r"""
SELECT p_partkey, CAST(p_size AS BIGINT) * CASE WHEN p_size % 3 = 0 THEN 1000 ELSE 1 END AS volume, regexp_matches(p_brand, '#1[0-9]') AS teen,
       regexp_replace(p_brand, '[^0-9]', '', 'g') AS digits, regexp_extract(p_brand, '(\d)(\d?)$', 1) AS first_digit FROM part""")

q("f07_parse_url", lambda t: t("pages").select("page_id", X.url_path("url").alias("path"), X.url_param("url", "page").alias("page")),
  r"""
SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page FROM pages""")

q("f08_slug_phone", lambda t: t("customer").withColumn("phone", F.concat(F.when(F.col("c_nationkey") % 2 == 0, "+1").otherwise("+61"), F.lpad(F.col("c_custkey").cast("string"), 9, "4"), F.when(F.col("c_custkey") % 3 == 0, "0").otherwise("")))
  .select("c_custkey", X.slugify(F.concat("c_name", F.lit(" / "), "c_mktsegment", F.lit("!"))).alias("slug"), X.valid_e164("phone", F.when(F.col("c_nationkey") % 2 == 0, "US").otherwise("AU")).alias("valid")),
  r"""
SELECT c_custkey, regexp_replace(regexp_replace(lower(trim(c_name || ' / ' || c_mktsegment || '!')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
       CASE WHEN c_nationkey % 2 = 0 THEN c_custkey % 3 = 0 ELSE c_custkey % 3 <> 0 END AS valid FROM customer""")

q("f10_user_agent", lambda t: t("pages").withColumn("ua", F.concat(F.lit("Mozilla/5.0 ("), F.element_at(F.array(*[F.lit(x) for x in ("iPhone; CPU", "Linux; Android 14", "Windows NT 10.0", "Macintosh; Intel Mac OS X")]), (F.col("page_id") % 4 + 1).cast("int")),
    F.lit(") "), F.element_at(F.array(*[F.lit(x) for x in ("Version/17 Safari/604", "Chrome/120 Safari/537", "Gecko Firefox/121", "Chrome/120 Edg/120", "Googlebot/2.1")]), (F.col("page_id") % 5 + 1).cast("int"))))
  .select("page_id", X.classify_user_agent("ua").alias("u")).select("page_id", "u.*"),
  """
SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'safari' WHEN 1 THEN 'chrome' WHEN 2 THEN 'firefox' WHEN 3 THEN 'edge' ELSE 'other' END AS browser,
       CASE page_id % 4 WHEN 0 THEN 'ios' WHEN 1 THEN 'android' WHEN 2 THEN 'windows' ELSE 'macos' END AS os, CASE WHEN page_id % 5 = 4 THEN 1 ELSE 0 END AS is_bot FROM pages""")

_AGENTS = ["x FBAV/400 Chrome/1", "a FB4A;FB/IAB", "Instagram 300 Safari", "musical TIKTOK 3", "Twitter for iPhone Safari", "Snapchat/12", "Pinterest/0.2 Chrome", "LinkedInApp Safari", "Chrome/1 OPR/9",
           "Opera/9.8", "Chrome/120 Edg/120", "Edge/18", "Chrome/120 Safari", "CriOS/120 Safari", "FxiOS/9 Safari", "Firefox/121", "Version/17 Safari/604", "SamsungBrowser/20", "UCBrowser/13", "YaBrowser/23",
           "Brave/1", "Vivaldi/6", "DuckDuckGo/7", "MQQBrowser/6", "Maxthon/5", "Sogou web", "Puffin/9", "NAVER(inapp)", "curl/8", "prerender Chrome", "x Read-Aloud"]
_BROWSERS = ["Facebook In-App", "Facebook In-App", "Instagram In-App", "TikTok In-App", "Twitter In-App", "Snapchat In-App", "Pinterest In-App", "LinkedIn In-App", "Opera",
             "Opera", "Edge", "Edge", "Chrome", "Chrome iOS", "Firefox iOS", "Firefox", "Safari", "Samsung Internet", "UC Browser", "Yandex",
             "Brave", "Vivaldi", "DuckDuckGo", "QQ Browser", "Maxthon", "Sogou", "Puffin", "Naver Whale", "Other", "Chrome", "Other"]
_N = len(_AGENTS) + 1  # and NULL
q("f10_browser_names", lambda t: t("pages").withColumn("ua", F.get(F.array(*[F.lit(a) for a in _AGENTS]), (F.col("page_id") % _N).cast("int"))).select("page_id", X.browser_name("ua").alias("browser"), X.is_visitor("ua").alias("visitor")),
  f"SELECT page_id, coalesce({_BROWSERS!r}[CAST(page_id % {_N} AS INTEGER) + 1], 'Other') AS browser, CASE WHEN page_id % {_N} < {_N - 1} THEN page_id % {_N} < {_N - 3} END AS visitor FROM pages")
_PHONES = ["+14155550123", "+141555501", "+4155550123", "14155550123", "+1415555012", "+141555501234", "+61412345678", "+6141234567", "+614123456789", "+61412345678901", "+64211234567", "+6421123456", "+642112345", "+525512345678", "+52551234567", "+5255123456",
           "+819012345678", "+81901234567", "+819012345", "+447911123456", "+4479", "+44791112345678901", "+0000000000", "+4930123456", "", "+1", "+100000", "+6100000000000"]
_VALID = [True, False, True, False, True, False, True, True, True, False, True, True, False, True, True, False, True, True, False, True, False, False, False, True, False, False, False, False]
_P = len(_PHONES) + 1  # and NULL
q("f08_telephone", lambda t: t("customer").withColumn("phone", F.get(F.array(*[F.lit(a) for a in _PHONES]), (F.col("c_custkey") % _P).cast("int"))).select("c_custkey", X.telephone("phone").alias("telephone")),
  f"SELECT c_custkey, CASE WHEN {_VALID!r}[CAST(c_custkey % {_P} AS INTEGER) + 1] THEN {_PHONES!r}[CAST(c_custkey % {_P} AS INTEGER) + 1] END AS telephone FROM customer")

q("f11_date_add", lambda t: t("orders").select("o_orderkey", F.date_add(F.to_date("o_orderdate"), 28).alias("d28"), F.add_months(F.to_date("o_orderdate"), -1).alias("m1"), X.plus("o_orderdate", hours=36).alias("h36")),
  "SELECT o_orderkey, CAST(o_orderdate AS DATE) + 28 AS d28, CAST(CAST(o_orderdate AS DATE) - INTERVAL 1 MONTH AS DATE) AS m1, o_orderdate + INTERVAL 36 HOUR AS h36 FROM orders")

q("f12_boundary_diff", lambda t: OrderedScan(t("events"), ["user_id"], ["ts", "event_id"]).add(prev=lag("ts")).result()
  .select("event_id", *[X.boundary_diff(u, "prev", "ts").alias(u) for u in ("second", "minute", "hour", "day", "week", "month", "year")]),
  "SELECT event_id, " + ", ".join(f"date_diff('{u}', prev, ts) AS {u}" for u in ("second", "minute", "hour", "day", "month", "year"))
  + ", CAST(date_diff('day', date_trunc('week', prev), date_trunc('week', ts)) / 7 AS BIGINT) AS week FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)")

q("f13_time_slice", lambda t: t("events").select("event_id", X.trunc_ts("hour", "ts").alias("h"), X.time_slice("ts", 300).alias("slice5"), X.trunc_ts("week", "ts").alias("w")),
  "SELECT event_id, date_trunc('hour', ts) AS h, time_bucket(INTERVAL 5 MINUTE, ts) AS slice5, CAST(date_trunc('week', ts) AS TIMESTAMP) AS w FROM events")

q("f14_time_zone", lambda t: t("events").select("event_id", X.zone_shift("ts", "America/Los_Angeles").alias("la"),
    X.zone_shift("ts", F.when(F.col("user_id") % 2 == 0, "America/New_York").otherwise("Asia/Tokyo")).alias("own")),
  """
SELECT event_id, ts - INTERVAL 8 HOUR AS la, CASE WHEN user_id % 2 = 0 THEN ts - INTERVAL 5 HOUR ELSE ts + INTERVAL 9 HOUR END AS own FROM events""")

q("f15_date_parts", lambda t: t("events").select("event_id", F.hour("ts").alias("h"), X.day_of_week("ts").alias("dow"), F.date_format("ts", "EEE").alias("dayname"), F.month("ts").alias("m")),
  "SELECT event_id, hour(ts) AS h, dayofweek(ts) AS dow, left(dayname(ts), 3) AS dayname, month(ts) AS m FROM events")

q("f16_day_part", lambda t: t("events").select("event_id", X.day_part("ts").alias("part"), X.dow_close(X.day_of_week("ts"), F.col("user_id") % 7).alias("near")),
  """
SELECT event_id, CASE WHEN hour(ts) < 5 THEN 'late night' WHEN hour(ts) < 11 THEN 'morning' WHEN hour(ts) < 14 THEN 'lunch' WHEN hour(ts) < 17 THEN 'afternoon' WHEN hour(ts) < 21 THEN 'dinner' ELSE 'night' END AS part,
       abs(dayofweek(ts) - user_id % 7) IN (0, 1, 6) AS near FROM events""")

q("f17_conversions", lambda t: t("events").select("event_id", F.col("user_id").cast("string").alias("uid"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("text"), F.to_date(F.date_format("ts", "yyyyMMdd"), "yyyyMMdd").alias("day"),
    X.from_micros(F.floor(X.micros("ts") / 1000) * 1000).alias("from_ms")),
  "SELECT event_id, CAST(user_id AS VARCHAR) AS uid, strftime(ts, '%Y-%m-%d %H:%M') AS text, CAST(ts AS DATE) AS day, date_trunc('millisecond', ts) AS from_ms FROM events")

q("f18_numbers", lambda t: t("lineitem").select("l_orderkey", "l_linenumber", F.round("l_extendedprice", -2).cast("double").alias("r"), F.ceil(F.col("l_extendedprice").cast("decimal(18,2)"), F.lit(-2)).cast("double").alias("c"),
    F.floor("l_quantity").alias("f"), (F.col("l_orderkey") % 7).alias("m"), F.abs(F.col("l_discount") - 0.05).alias("a"), F.power("l_quantity", F.lit(2)).alias("p"), F.sqrt("l_quantity").alias("s"), F.ln("l_quantity").alias("l")),
  """
SELECT l_orderkey, l_linenumber, round(l_extendedprice / 100) * 100 AS r, ceil(CAST(l_extendedprice AS DECIMAL(18,2)) / 100) * 100 AS c, CAST(floor(l_quantity) AS BIGINT) AS f,
       l_orderkey % 7 AS m, abs(l_discount - 0.05) AS a, power(l_quantity, 2) AS p, sqrt(l_quantity) AS s, ln(l_quantity) AS l FROM lineitem""", "r c a p s l")

q("f19_hash_bucket", lambda t: t("customer").select("c_custkey", X.md5_bucket("c_custkey", 10).alias("bucket"), X.hash_bucket("c_custkey", 10).between(0, 9).alias("in_range")),
  "SELECT c_custkey, CAST(CAST('0x' || substring(md5(CAST(c_custkey AS VARCHAR)), 1, 8) AS BIGINT) % 10 AS INTEGER) AS bucket, TRUE AS in_range FROM customer")

q("f20_arrays", lambda t: t("part").withColumn("w", F.split("p_name", " ")).select(
    "p_partkey", F.size("w").alias("n"), F.array_join(F.sort_array("w"), "+").alias("sorted"), F.array_contains("w", "ring").alias("has"),
    F.array_join(F.array_compact(F.array(F.when(F.col("p_size") > 25, "big"), F.col("p_type"))), ",").alias("packed")),
  """
SELECT p_partkey, len(string_split(p_name, ' ')) AS n, array_to_string(list_sort(string_split(p_name, ' ')), '+') AS sorted, list_contains(string_split(p_name, ' '), 'ring') AS has,
       CASE WHEN p_size > 25 THEN 'big,' || p_type ELSE p_type END AS packed FROM part""")

q("f21_flatten", lambda t: t("documents").select("doc_id", F.explode(F.split(F.lower("text"), r"\s+")).alias("w")).select(F.trim("w").alias("w")).filter("w <> ''").groupBy("w").agg(F.count(F.lit(1)).alias("n")),
  r"SELECT w, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '\s+')) AS w FROM documents) WHERE w <> '' GROUP BY 1")

q("f22_json_path", lambda t: t("events").withColumn("outer_json", F.to_json(F.struct(F.col("props").alias("inner"), "event_type"))).select(
    "event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.expr("variant_get(parse_json(props), '$.k', 'int')").alias("kv"),
    F.get_json_object(F.get_json_object("outer_json", "$.inner"), "$.k").cast("int").alias("nested"), F.from_json("props", "k int")["k"].alias("kf")),
  "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(json_extract_string(props, '$.k') AS INTEGER) AS kv, CAST(json_extract_string(props, '$.k') AS INTEGER) AS nested, CAST(json_extract_string(props, '$.k') AS INTEGER) AS kf FROM events")

q("f23_object", lambda t: t("nation").select("n_nationkey", F.to_json(F.struct(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey")).alias("region"))).alias("obj")),
  """
SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN '{"name":"' || n_name || '","region":' || n_regionkey || '}' ELSE '{"name":"' || n_name || '"}' END AS obj FROM nation""")


def _jw(t):
    from cohortspark.operators.joins import jaro_winkler

    return t("part").select("p_partkey", jaro_winkler(F.lower("p_name"), F.lower(F.concat("p_type", F.lit(" widget")))).alias("similarity"))


q("f09_jaro_winkler", _jw, "SELECT p_partkey, CAST(floor(jaro_winkler_similarity(lower(p_name), lower(p_type || ' widget')) * 100 + 0.5) AS BIGINT) AS similarity FROM part")

