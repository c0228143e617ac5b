"""Queries: readers, writers and audits on data written from the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ramplake.plans import base
from ramplake.plans.base import SQL_FC, SQL_RAW
from ramplake.plans.registry import load, query, rounded
from ramplake.sources import audit, readers, writers


@query("read_scada_csv", """WITH r AS (SELECT l_suppkey::VARCHAR AS turbine_id, l_shipdate AS t, l_quantity - 10 AS w, l_extendedprice / 1000 - 5 AS p, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem),
k AS (SELECT turbine_id, t, greatest(w, 0) AS w, greatest(p, 0) AS p FROM r WHERE greatest(w, 0) BETWEEN 0 AND 35 AND greatest(p, 0) BETWEEN 1 AND 80 AND t >= TIMESTAMP '1997-01-01' AND t < TIMESTAMP '2000-01-01')
SELECT turbine_id, count(DISTINCT t) AS rows, epoch_us(min(t)) AS first_us, epoch_us(max(t)) AS last_us FROM k GROUP BY 1""")
def _(spark, sf):
    path = writers.scratch(spark, "scada")
    li = load(spark, sf, "lineitem")
    li.select(F.col("l_suppkey").alias("fan_id"), F.col("l_shipdate").alias("Timestamp"), (F.col("l_quantity") - 10).alias("Wind_Speed"), (F.col("l_extendedprice") / 1000 - 5).alias("Active_Power")).write.option("header", True).csv(path)
    out = readers.read_scada_csv(spark, path, wind=(0.0, 35.0), power_min=1.0, power_max=80.0, start="1997-01-01", end="1999-12-31", overrides={"id": "fan_id"})
    return out.groupBy("turbine_id").agg(F.count("*").alias("rows"), F.min(F.unix_micros("datetime")).alias("first_us"), F.max(F.unix_micros("datetime")).alias("last_us"))


@query("remap_encoded_ids", """WITH r AS (SELECT o_orderdate AS t, CASE WHEN o_custkey % 7 = 0 THEN 9000 + o_custkey % 130 ELSE o_custkey % 117 + 1 END AS id FROM orders), e AS (SELECT t, max(id) > 117 AS enc FROM r GROUP BY t)
SELECT CASE WHEN enc AND id::VARCHAR LIKE '90%' AND substr(id::VARCHAR, 3)::INT BETWEEN 1 AND 117 AND length(id::VARCHAR) > 2 THEN substr(id::VARCHAR, 3)::INT::VARCHAR ELSE id::VARCHAR END AS unit, count(*) AS n FROM r JOIN e USING (t) GROUP BY 1""".replace("substr(id::VARCHAR, 3)::INT", "try_cast(substr(id::VARCHAR, 3) AS INT)"))
def _(spark, sf):
    k = F.col("o_custkey")
    r = load(spark, sf, "orders").select(F.col("o_orderdate").alias("t"), F.when(k % 7 == 0, 9000 + k % 130).otherwise(k % 117 + 1).alias("unit"))
    return readers.remap_encoded_ids(r, "unit", "t", "90").groupBy("unit").agg(F.count("*").alias("n"))


@query("read_parquet_folder", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def _(spark, sf):
    path = writers.scratch(spark, "folder")
    load(spark, sf, "events").write.parquet(path)
    return rounded(readers.read_table(spark, path).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")), 4)


@query("read_table_gzip_csv", "SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 4) AS total FROM customer GROUP BY 1")
def _(spark, sf):
    path = writers.scratch(spark, "table") + ".csv"
    load(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal").write.option("header", True).option("compression", "gzip").csv(path)
    t = readers.read_table(spark, path, "c_custkey bigint, c_nationkey bigint, c_acctbal double")
    return rounded(t.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("total")), 4)


@query("read_event_csv_strict", "SELECT user_id % 2 = 0 AS valid, count(*) AS n, round(sum(value), 4) AS power FROM events GROUP BY 1")
def _(spark, sf):
    path = writers.scratch(spark, "series")
    word = F.when(F.col("user_id") % 2 == 0, F.when(F.col("user_id") % 4 == 0, "True").otherwise("1")).otherwise("no")
    load(spark, sf, "events").select(F.col("ts").alias("timestamp"), F.col("value").alias("power"), word.alias("valid")).write.option("header", True).csv(path)
    return rounded(readers.read_event_csv(spark, path).groupBy("valid").agg(F.count("*").alias("n"), F.sum("power").alias("power")), 4)


@query("static_priors", "SELECT l_suppkey, round(quantile_cont(l_quantity, 0.5), 6) AS l_quantity, round(quantile_cont(l_tax, 0.5), 6) AS l_tax FROM lineitem GROUP BY 1")
def _(spark, sf):
    return rounded(readers.static_priors(load(spark, sf, "lineitem"), "l_suppkey", ["l_quantity", "l_tax"]))


@query("write_monthly_partitions", "SELECT strftime(o_orderdate, '%Y%m') AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def _(spark, sf):
    path = writers.scratch(spark, "monthly")
    writers.write_monthly(load(spark, sf, "orders"), path, "o_orderdate")
    back = spark.read.schema("o_totalprice double, month string").parquet(path)
    return rounded(back.groupBy("month").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")), 2)


_BUNDLE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("write_bundle", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS rows FROM {n}" for n in _BUNDLE))
def _(spark, sf):
    path = writers.scratch(spark, "bundle")
    writers.write_bundle({n: load(spark, sf, n) for n in _BUNDLE}, path, {"version": 1})
    tables, _ = writers.read_bundle(spark, path)
    one = lambda n: tables[n].agg(F.lit(n).alias("name"), F.count("*").alias("rows"))
    return reduce(DataFrame.unionByName, map(one, _BUNDLE))


@query("write_catalog_gzip", SQL_RAW + "\nSELECT unit, count(*) AS events, count(DISTINCT user_id) AS users FROM raw GROUP BY unit")
def _(spark, sf):
    path = writers.scratch(spark, "catalog")
    raw = base.raw_events(spark, sf).select("unit", "user_id", F.array(F.col("event_id"), F.col("user_id")).alias("ids"))
    writers.write_catalog(raw, path)
    back = spark.read.option("header", True).csv(f"{path}/events")
    return back.groupBy("unit").agg(F.count("*").alias("events"), F.countDistinct(F.element_at(F.split("ids", "\\|"), 2)).alias("users"))


@query("weather_hourly_union", """WITH a AS (SELECT o_orderdate AS t, min(o_totalprice) AS v FROM orders WHERE o_orderdate < TIMESTAMP '1998-03-01' GROUP BY 1), z AS (SELECT o_orderdate AS t, max(o_totalprice) AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1)
SELECT epoch_us(coalesce(a.t, z.t)) AS us, round(coalesce(a.v, z.v), 2) AS v FROM a FULL JOIN z ON a.t = z.t""")
def _(spark, sf):
    o = load(spark, sf, "orders")
    part = lambda cond, agg: o.filter(cond).groupBy(F.col("o_orderdate").alias("time")).agg(agg("o_totalprice").alias("v"))
    out = readers.weather_hourly_union([part("o_orderdate < TIMESTAMP '1998-03-01'", F.min), part("o_orderdate >= TIMESTAMP '1998-01-01'", F.max)])
    return rounded(out.select(F.unix_micros("time").alias("us"), "v"), 2)


@query("file_digest_audit")
def _(spark, sf):
    """Digests of the given files, against a manifest in which one name and one digest are wrong."""
    found = audit.file_digests(spark, sf, "*.parquet")
    wrong = F.col("name") == "region.parquet"
    manifest = found.select(F.when(F.col("name") == "nation.parquet", F.lit("other.parquet")).otherwise(F.col("name")).alias("name"), F.when(wrong, F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("sha256"))
    bad = audit.verify_digests(found, manifest).agg(F.sort_array(F.collect_list("name"))).scalar()
    return found.withColumn("mismatches", F.array_join(bad, ","))


@query("row_set_digest", "SELECT l_suppkey, count(*) AS rows, bit_xor(('0x' || substr(md5(l_orderkey || '-' || l_linenumber), 1, 15))::BIGINT) AS digest FROM lineitem GROUP BY 1")
def _(spark, sf):
    return audit.md5_row_digest(load(spark, sf, "lineitem"), ["l_suppkey"], F.concat_ws("-", "l_orderkey", "l_linenumber"))


_RX = r"'(?i)(api[_ -]?key|authorization:|bearer\s+[A-Za-z0-9._-]{12,})'"


@query("privacy_scan", f"""SELECT 'documents' AS kind, doc_id AS id FROM documents WHERE list_has_any(string_split(lower(source), '/'), ['raw', 'private', 'scada', 'turbine', 'coordinates', 'operational_status', 'whereturbins.csv']) OR regexp_matches(text, {_RX})
UNION ALL SELECT 'pages', page_id FROM pages WHERE list_has_any(string_split(lower(url), '/'), ['raw', 'private', 'scada', 'turbine', 'coordinates', 'operational_status', 'whereturbins.csv']) OR regexp_matches(html, {_RX})""")
def _(spark, sf):
    docs = audit.privacy_hits(load(spark, sf, "documents").select(F.lit("documents").alias("kind"), F.col("doc_id").alias("id"), "source", "text"), F.col("source"), F.col("text"))
    pages = audit.privacy_hits(load(spark, sf, "pages").select(F.lit("pages").alias("kind"), F.col("page_id").alias("id"), F.col("url").alias("source"), F.col("html").alias("text")), F.col("source"), F.col("text"))
    return docs.unionByName(pages).filter("path_hit OR text_hit").select("kind", "id")


@query("privacy_scan_totals", f"""SELECT kind, count(*) AS scanned, sum(length(body))::BIGINT AS letters, count(*) FILTER (WHERE regexp_matches(body, {_RX})) AS text_hits, count(*) FILTER (WHERE regexp_matches(body || ' Authorization: none', {_RX})) AS marked_hits
FROM (SELECT 'documents' AS kind, text AS body FROM documents UNION ALL SELECT 'pages', html FROM pages) GROUP BY kind""")
def _(spark, sf):
    """What was scanned, and that the scan finds a mark at the end of every text."""
    parts = [("documents", "text"), ("pages", "html")]
    rows = [load(spark, sf, t).select(F.lit(t).alias("kind"), F.col(c).alias("body")) for t, c in parts]
    rows = rows[0].unionByName(rows[1])
    plain = audit.privacy_hits(rows, F.lit(""), F.col("body"))
    marked = audit.privacy_hits(plain.withColumnRenamed("text_hit", "plain_hit").drop("path_hit"), F.lit(""), F.concat("body", F.lit(" Authorization: none")))
    return marked.groupBy("kind").agg(
        F.count("*").alias("scanned"), F.sum(F.length("body")).alias("letters"), F.count_if("plain_hit").alias("text_hits"), F.count_if("text_hit").alias("marked_hits"))


@query("forecast_contract", SQL_FC + "\nSELECT count(*) AS rows, count(*) FILTER (WHERE abs(list_sum(p) - 1) > 1e-9) AS sums_to_one, count(*) FILTER (WHERE arr NOT BETWEEN 0 AND 16) AS arrival_range, count(*) FILTER (WHERE len(q) <> 16) AS width, 0::BIGINT AS repeated_keys FROM fc")
def _(spark, sf):
    total = F.aggregate("p", F.lit(0.0), lambda a, v: a + v)
    rules = {"sums_to_one": F.abs(total - 1) <= 1e-9, "arrival_range": F.col("arr").between(0, 16), "width": F.size("q") == 16}
    return audit.contract_violations(base.forecasts(spark, sf), rules, ["arm", "lead", "b"])
