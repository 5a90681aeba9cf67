"""Queries: string, numeric, date, list and geometric functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions import dates
from tidewheel.functions import scalars as S
from tidewheel.plans.registry import Plans
from tidewheel.tables import load

plans = Plans()

# strings


@plans.query("SELECT c_custkey, c_name || ' \"' || nullif(c_mktsegment, 'BUILDING') || '\" ' || c_nationkey::VARCHAR AS label FROM customer")
def str_concat(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "customer").select("c_custkey", S.plus(F.col("c_name"), F.lit(' "'), F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit('" '), F.col("c_nationkey").cast("string")).alias("label"))


@plans.query("SELECT p_partkey, left(p_name, 4) AS head, length(p_name) AS n, length(rtrim(p_brand || '   ')) AS n_char, upper(p_name) AS up, lower(p_brand) AS low, rtrim(p_type || '  ') AS trimmed FROM part")
def str_basic(spark: SparkSession, d: str) -> DataFrame:
    padded = F.concat("p_brand", F.lit("   "))
    return load(spark, d, "part").select(
        "p_partkey", F.left("p_name", F.lit(4)).alias("head"), F.length("p_name").cast("long").alias("n"), S.char_length(padded).cast("long").alias("n_char"), F.upper("p_name").alias("up"), F.lower("p_brand").alias("low"), F.rtrim(F.concat("p_type", F.lit("  "))).alias("trimmed")
    )


@plans.query(r"SELECT doc_id, md5(trim(regexp_replace(text, '[ \t\n\v\f\r]+', ' ', 'g'))) AS squeezed FROM documents")
def str_squeeze(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", F.md5(S.squeeze(F.col("text"))).alias("squeezed"))


@plans.query("SELECT p_partkey, substr(hex(encode(p_name)), 5, 2) AS third FROM part")
def str_byteextract(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").select("p_partkey", F.hex(S.byteextract(F.col("p_name"), 3)).alias("third"))


@plans.query("SELECT doc_id, CASE WHEN instr(text, 'the') > 0 THEN instr(text, 'the') ELSE length(text) + 1 END::BIGINT AS at FROM documents")
def str_locate(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", S.locate(F.col("text"), "the").cast("long").alias("at"))


@plans.query("SELECT n_name, hex(encode(n_name)) AS hexed, n_name AS back FROM nation")
def str_hex(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "nation").select("n_name", F.hex(F.encode("n_name", "UTF-8")).alias("hexed"), F.decode(F.unhex(F.hex(F.encode("n_name", "UTF-8"))), "UTF-8").alias("back"))


@plans.query("""
WITH b AS (SELECT p_partkey, list_transform(range(1, strlen(p_name) + 1), lambda i: ('0x' || substr(hex(encode(p_name)), 2 * i - 1, 2))::BIGINT) AS b, strlen(p_name) AS n FROM part)
SELECT p_partkey, (((list_sum(list_transform(range(1, n + 1), lambda i: (n - i + 1) * b[i])) + n) % 65521) * 65536 + (1 + list_sum(b)) % 65521)::BIGINT AS checksum FROM b
""")
def checksum_adler32(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").select("p_partkey", S.checksum(F.col("p_name")).alias("checksum"))


@plans.query("""
WITH b AS (SELECT p_partkey, flatten([[('0x' || substr(hex(encode(p_name)), 2 * i - 1, 2))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR i IN range(1, strlen(p_name) + 1)]) AS steps FROM part)
SELECT p_partkey, xor(list_reduce(list_prepend(4294967295::BIGINT, steps), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END), 4294967295::BIGINT) AS hash FROM b
""")
def hash_crc32(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").select("p_partkey", S.hash_value(F.col("p_name")).alias("hash"))


@plans.query("SELECT upper(left(p_name, 1)) AS letter, count(*) AS n, count(DISTINCT lower(p_brand)) AS n_brands FROM part GROUP BY upper(left(p_name, 1))")
def case_blind_group(spark: SparkSession, d: str) -> DataFrame:
    """The case-blind type, as a collation on declared columns only."""
    rows = load(spark, d, "part").select(F.collate(F.left("p_name", F.lit(1)), "UTF8_LCASE").alias("c"), F.lower("p_brand").alias("b"))
    grouped = rows.groupBy("c").agg(F.count("*").alias("n"), F.count_distinct("b").alias("n_brands"))
    return grouped.select(F.upper(F.collate("c", "UTF8_BINARY")).alias("letter"), "n", "n_brands")


@plans.query("""
SELECT o_orderpriority AS padded, count(*) AS n FROM orders GROUP BY ALL
""")
def blank_padded_compare(spark: SparkSession, d: str) -> DataFrame:
    """char values with and without trailing blanks are one group."""
    value = F.when(F.col("o_orderkey") % 2 == 0, F.concat("o_orderpriority", F.lit("   "))).otherwise(F.col("o_orderpriority"))
    grouped = load(spark, d, "orders").select(S.blank_padded(value).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    return grouped.select(F.rtrim(F.collate("c", "UTF8_BINARY")).alias("padded"), "n")


# numbers


@plans.query("SELECT l_orderkey, l_linenumber, l_quantity = l_linenumber AS eq, l_quantity::DECIMAL(12,2) > l_partkey AS gt, l_orderkey::VARCHAR < '2' AS txt FROM lineitem")
def mixed_type_compare(spark: SparkSession, d: str) -> DataFrame:
    """Values of two types are compared in the wider one."""
    c = F.col
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (c("l_quantity") == c("l_linenumber")).alias("eq"), (c("l_quantity").cast("decimal(12,2)") > c("l_partkey")).alias("gt"), (c("l_orderkey").cast("string") < "2").alias("txt"))


@plans.query("SELECT l_orderkey, l_linenumber, (l_orderkey - 20000) % 7 AS m, abs(l_orderkey - 20000) AS a, sqrt(l_quantity) AS root, -l_quantity AS neg FROM lineitem")
def num_basic(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_orderkey") - 20000
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (k % 7).alias("m"), F.abs(k).alias("a"), F.sqrt("l_quantity").alias("root"), (-F.col("l_quantity")).alias("neg"))


@plans.query("SELECT p_partkey, round(pow(p_size::DOUBLE, 3), 4) AS cube, round(pow(p_retailprice / 1000, -2), 6) AS inverse FROM part")
def num_power(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").select("p_partkey", F.round(S.power(F.col("p_size"), 3), 4).alias("cube"), F.round(S.power(F.col("p_retailprice") / 1000, -2), 6).alias("inverse"))


@plans.query("SELECT p_partkey, round(sin(p_size), 9) AS s, round(cos(p_size), 9) AS c, round(atan(p_size), 9) AS a, round(exp(p_size / 10.0::DOUBLE), 6) AS e, round(ln(p_size), 9) AS l, ceil(p_retailprice)::BIGINT AS up, round(p_retailprice, 0) AS whole FROM part")
def num_math(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("p_size").cast("double")
    return load(spark, d, "part").select("p_partkey", F.round(F.sin(x), 9).alias("s"), F.round(F.cos(x), 9).alias("c"), F.round(F.atan(x), 9).alias("a"), F.round(F.exp(x / 10.0), 6).alias("e"), F.round(F.ln(x), 9).alias("l"), F.ceil("p_retailprice").cast("long").alias("up"), F.round("p_retailprice", 0).alias("whole"))


@plans.query("SELECT l_orderkey, l_linenumber, l_orderkey & 255 AS conj, l_orderkey | 255 AS disj, xor(l_orderkey, l_partkey) AS excl, l_partkey << 3 AS moved, bit_count(l_orderkey)::INTEGER AS bits FROM lineitem")
def num_bitwise(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_orderkey")
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", k.bitwiseAND(F.lit(255)).alias("conj"), k.bitwiseOR(F.lit(255)).alias("disj"), k.bitwiseXOR(F.col("l_partkey")).alias("excl"), F.shiftleft("l_partkey", 3).alias("moved"), F.bit_count(k).alias("bits"))


@plans.query("SELECT l_orderkey, l_linenumber, greatest(l_orderkey, l_partkey, l_suppkey) AS high, least(l_orderkey, l_partkey, l_suppkey) AS low, coalesce(nullif(l_returnflag, 'N'), '-') AS flag FROM lineitem")
def num_greatest_least_ifnull(spark: SparkSession, d: str) -> DataFrame:
    keys = ["l_orderkey", "l_partkey", "l_suppkey"]
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.greatest(*keys).alias("high"), F.least(*keys).alias("low"), F.ifnull(F.nullif("l_returnflag", F.lit("N")), F.lit("-")).alias("flag"))


@plans.query("""
SELECT s_suppkey, s_acctbal::DECIMAL(14,2)::VARCHAR AS money, (s_acctbal::DECIMAL(14,2) * 3)::DECIMAL(14,2)::VARCHAR AS thrice, sign(s_acctbal::DECIMAL(14,2) - 5000)::INTEGER AS cmp FROM supplier
""")
def num_money(spark: SparkSession, d: str) -> DataFrame:
    m = S.money(F.col("s_acctbal"))
    return load(spark, d, "supplier").select("s_suppkey", m.cast("string").alias("money"), S.money(m * 3).cast("string").alias("thrice"), S.money_compare(m, F.lit(5000)).alias("cmp"))


@plans.query("SELECT o_orderkey, (n // 1000000)::VARCHAR || '.' || lpad((n % 1000000)::VARCHAR, 6, '0') AS seventh, taxed FROM (SELECT o_orderkey, (((o_totalprice::DECIMAL(12,2) * 100)::BIGINT * 20000 + 7) // 14)::BIGINT AS n, (o_totalprice::DECIMAL(12,2) * 1.075)::DECIMAL(18,5)::VARCHAR AS taxed FROM orders)")
def num_decimal(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("o_totalprice").cast("decimal(12,2)")
    seventh = (v / F.lit(7).cast("decimal(1,0)")).cast("decimal(18,6)")  # a decimal quotient of six places, rounded half up
    return load(spark, d, "orders").select("o_orderkey", seventh.cast("string").alias("seventh"), (v * F.lit("1.075").cast("decimal(4,3)")).cast("decimal(18,5)").cast("string").alias("taxed"))


@plans.query("SELECT event_id, (event_id % 120)::TINYINT AS i1, (event_id % 30000)::SMALLINT AS i2, event_id::INTEGER AS i4, event_id::VARCHAR AS c, ts::DATE AS day FROM events")
def num_casts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    return load(spark, d, "events").select("event_id", (k % 120).cast("tinyint").alias("i1"), (k % 30000).cast("smallint").alias("i2"), k.cast("int").alias("i4"), k.cast("string").alias("c"), F.col("ts").cast("date").alias("day"))


@plans.query("SELECT l_orderkey, l_linenumber, l_extendedprice / nullif(l_linenumber - 1, 0) AS quotient FROM lineitem")
def num_try_divide(spark: SparkSession, d: str) -> DataFrame:
    """A math exception is an error; the try_ form gives NULL."""
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.try_divide("l_extendedprice", F.col("l_linenumber") - 1).alias("quotient"))


# dates


@plans.query("""
SELECT o_orderkey, o_orderdate + INTERVAL '1 year 2 months 3 days 12 hours 24 minutes 48 seconds' AS later, o_orderdate - INTERVAL 7 DAYS AS before FROM orders
""")
def date_interval(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate")
    return load(spark, d, "orders").select("o_orderkey", dates.add(day, "1 yrs 2 mos 3 days 12 hrs 24 mins 48 secs").alias("later"), dates.subtract(day, "7 days").alias("before"))


@plans.query("SELECT o_orderkey, day(last_day(o_orderdate::DATE)) AS days, month(o_orderdate) AS month, dayofweek(o_orderdate) + 1 AS dow FROM orders")
def date_month_day_names(spark: SparkSession, d: str) -> DataFrame:
    """Month and week day go through their names."""
    day = F.col("o_orderdate")
    o = load(spark, d, "orders")
    return o.select("o_orderkey", dates.days_in_month(day).cast("long").alias("days"), dates.month_number(F.date_format(day, "MMMM")).cast("long").alias("month"), dates.day_number(F.date_format(day, "EEE")).cast("long").alias("dow"))


@plans.query("SELECT event_id, year(ts) AS y, quarter(ts) AS q, month(ts) AS m, day(ts) AS dd, hour(ts) AS h, minute(ts) AS mi, week(ts) AS w FROM events")
def date_parts(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts")
    return load(spark, d, "events").select("event_id", *(dates.part(p, ts).cast("long").alias(n) for p, n in (("year", "y"), ("quarter", "q"), ("month", "m"), ("day", "dd"), ("hour", "h"), ("minute", "mi"), ("week", "w"))))


@plans.query("SELECT event_id, strftime(ts, '%Y_%m_%d %H:%M:%S') || ' GMT' AS gmt, strftime(make_timestamp(event_id * 86400 * 1000000), '%Y_%m_%d %H:%M:%S') || ' GMT' AS of_seconds FROM events")
def date_gmt(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", dates.date_gmt(F.col("ts")).alias("gmt"), dates.gmt_timestamp(F.col("event_id") * 86400).alias("of_seconds"))


@plans.query("SELECT event_id, year(t) AS y, month(t) AS m, day(t) AS dd, hour(t) AS h, minute(t) AS mi, second(t) AS s FROM (SELECT event_id, make_timestamp(event_id * 98765 * 1000000) AS t FROM events)")
def date_components(spark: SparkSession, d: str) -> DataFrame:
    c = dates.components(F.col("event_id") * 98765)
    return load(spark, d, "events").select("event_id", *(c[f].cast("long").alias(n) for f, n in (("year", "y"), ("month", "m"), ("day", "dd"), ("hour", "h"), ("minute", "mi"), ("second", "s"))))


_DATE_FORMS = ["dd-MMM-yyyy", "MMM/dd/yyyy", "yyyy_MM_dd", "MMMM dd, yyyy", "MM-dd-yy", "MM/dd/yy", "dd-MMM-yy", "yyyy/MM/dd", "M-d-yyyy", "MMM d, yyyy"]


@plans.query(f"SELECT o_orderkey, {', '.join(f'o_orderdate::DATE AS f{k}' for k in range(len(_DATE_FORMS)))}, NULL::DATE AS empty FROM orders")
def date_literal_forms(spark: SparkSession, d: str) -> DataFrame:
    """Dates written in several forms, and read again."""
    o = load(spark, d, "orders")
    read = lambda k, f: dates.parse_date((F.lower, F.upper)[k % 2](F.date_format("o_orderdate", f))).alias(f"f{k}")
    return o.select("o_orderkey", *(read(k, f) for k, f in enumerate(_DATE_FORMS)), dates.parse_date(F.lit(" ")).alias("empty"))


@plans.query("""
SELECT event_id, (epoch_us(ts - date_trunc('day', ts)) // 1000000)::DOUBLE AS clock, (hour(ts) * 3600 + minute(ts) * 60)::DOUBLE AS half,
  (event_id % 9) * 12 + event_id % 5 AS months, ((event_id % 40) * 86400 + (event_id % 11) * 3600 + 30)::DOUBLE AS seconds, ts::DATE AS day FROM events
""")
def date_input_templates(spark: SparkSession, d: str) -> DataFrame:
    """Times, intervals and dates in a text, read by the type that is asked for."""
    k, text = F.col("event_id"), lambda n: F.col("event_id").cast("long") % n
    span = F.concat_ws(" ", text(9).cast("string"), F.lit("yrs"), text(5).cast("string"), F.lit("mos"), text(40).cast("string"), F.lit("days"), text(11).cast("string"), F.lit("hrs 30 secs"))
    found = dates.parse_as("interval", span)
    return load(spark, d, "events").select(k, dates.parse_as("time", F.date_format("ts", "HH:mm:ss")).alias("clock"), dates.parse_as("time", F.date_format("ts", "hh:mm a")).alias("half"), found["months"].alias("months"), found["seconds"].alias("seconds"), dates.parse_as("date", F.date_format("ts", "dd-MMM-yyyy")).alias("day"))


@plans.query("SELECT o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS kind, count(*) AS n FROM orders GROUP BY ALL")
def date_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Absolute, interval or empty, as two columns hold the one date type."""
    o = load(spark, d, "orders").select("o_orderstatus", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("at"), F.when(F.col("o_orderstatus") == "O", F.expr("INTERVAL 3 DAYS")).alias("span"))
    return o.groupBy("o_orderstatus", dates.date_kind("at", "span").alias("kind")).agg(F.count("*").alias("n"))


@plans.query("SELECT count(*) AS n FROM orders WHERE o_orderdate < now()")
def date_now(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").where(F.col("o_orderdate") < F.current_timestamp()).agg(F.count("*").alias("n"))


# lists, complex numbers, pairs, geometry


@plans.query("SELECT vec_id, embedding[3]::DOUBLE AS third, len(embedding)::BIGINT AS n, list_position(embedding, embedding[5])::BIGINT AS at, len(list_concat(embedding, embedding[1:2]))::BIGINT AS longer FROM embeddings")
def list_functions(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    return load(spark, d, "embeddings").select("vec_id", F.try_element_at(e, F.lit(3)).cast("double").alias("third"), F.size(e).cast("long").alias("n"), S.list_locate(e, F.try_element_at(e, F.lit(5))).alias("at"), F.size(F.concat(e, F.slice(e, 1, 2))).cast("long").alias("longer"))


@plans.query("SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def list_total(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "embeddings").select("vec_id", F.round(S.list_total(F.col("embedding")), 6).alias("total"))


@plans.query("""
WITH z AS (SELECT p_partkey, p_size::DOUBLE AS a, (p_partkey % 17)::DOUBLE AS b FROM part)
SELECT p_partkey, a + 1 AS sum_re, b + 2 AS sum_im, a * a - b * b AS sq_re, 2 * a * b AS sq_im, -b AS conj_im, round(sqrt(a * a + b * b), 9) AS modulus, round(atan2(b, a), 9) AS angle FROM z
""")
def complex_numbers(spark: SparkSession, d: str) -> DataFrame:
    z = S.complex_of(F.col("p_size"), F.col("p_partkey") % 17)
    total, square, polar = S.complex_add(z, S.complex_of(F.lit(1), F.lit(2))), S.complex_multiply(z, z), S.polar(z)
    return load(spark, d, "part").select(
        "p_partkey", total["re"].alias("sum_re"), total["im"].alias("sum_im"), square["re"].alias("sq_re"), square["im"].alias("sq_im"), S.conjugate(z)["im"].alias("conj_im"), F.round(polar["radius"], 9).alias("modulus"), F.round(polar["angle"], 9).alias("angle")
    )


@plans.query("""
WITH p AS (SELECT s_suppkey, (s_suppkey % 10)::DOUBLE AS x, s_nationkey::DOUBLE AS y FROM supplier)
SELECT s_suppkey, round(sqrt((x - 3) * (x - 3) + (y - 4) * (y - 4)), 9) AS distance, CASE WHEN x <> 3 THEN (4 - y) / (3 - x) END AS slope, (x + 3) / 2 AS mid_x, (y + 4) / 2 AS mid_y FROM p
""")
def ordered_pairs(spark: SparkSession, d: str) -> DataFrame:
    p, q = S.pair(F.col("s_suppkey") % 10, F.col("s_nationkey")), S.pair(F.lit(3), F.lit(4))
    return load(spark, d, "supplier").select("s_suppkey", F.round(S.distance(p, q), 9).alias("distance"), S.slope(p, q).alias("slope"), S.midpoint(p, q)["x"].alias("mid_x"), S.midpoint(p, q)["y"].alias("mid_y"))


@plans.query("""
WITH b AS (SELECT p_partkey, p_size::DOUBLE AS w, (1 + p_partkey % 9)::DOUBLE AS h FROM part)
SELECT p_partkey, w * h AS area, 2 * (w + h) AS perimeter, w + h AS path, 5 < w AND 3 < h AS inside, 5 <= w AND 3 <= h AS meets FROM b
""")
def plane_geometry(spark: SparkSession, d: str) -> DataFrame:
    w, h, zero = F.col("p_size"), 1 + F.col("p_partkey") % 9, F.lit(0)
    box = F.array(S.pair(zero, zero), S.pair(w, zero), S.pair(w, h), S.pair(zero, h))
    five = S.pair(F.lit(5), F.lit(3))
    return load(spark, d, "part").select(
        "p_partkey", S.area(box).alias("area"), S.perimeter(box).alias("perimeter"), S.path_length(F.slice(box, 1, 3)).alias("path"), S.inside(five, box).alias("inside"), S.boxes_intersect(five, S.pair(F.lit(9), F.lit(9)), S.pair(zero, zero), S.pair(w, h)).alias("meets")
    )


@plans.query("""
WITH g AS (SELECT p_partkey, list_extract(['Point', 'PolygonZ', 'MultiLineStringM', 'blob'], 1 + (p_partkey % 4)::INTEGER) AS name FROM part)
SELECT p_partkey, name, CASE name WHEN 'Point' THEN 1 WHEN 'PolygonZ' THEN 1003 WHEN 'MultiLineStringM' THEN 2005 END AS code, CASE name WHEN 'Point' THEN 0 WHEN 'PolygonZ' THEN 2 WHEN 'MultiLineStringM' THEN 1 END AS dimension FROM g
""")
def geometry_names(spark: SparkSession, d: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, ["Point", "PolygonZ", "MultiLineStringM", "blob"])), (1 + F.col("p_partkey") % 4).cast("int"))
    rows = load(spark, d, "part").select("p_partkey", name.alias("name")).withColumn("code", S.geometry_code(F.col("name")))
    return rows.withColumn("dimension", S.geometry_dimension(F.col("code")))


@plans.query("""
WITH v AS (SELECT event_id, event_id * 37 % 1000000 AS n FROM events)
SELECT event_id, (n // 10000)::VARCHAR || '.' || (n // 100 % 100)::VARCHAR || CASE WHEN n % 100 = 0 THEN '' ELSE '.' || (n % 100)::VARCHAR END AS version FROM v
""")
def cmptversion(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", S.version_text(F.col("event_id") * 37 % 1000000).alias("version"))


@plans.query("SELECT 'bigint' AS key_type, 'string' AS name_type, count(*) AS n FROM customer")
def type_names(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "customer")
    return c.select(S.type_name(F.col("c_custkey")).alias("key_type"), S.type_name(F.col("c_name")).alias("name_type")).groupBy("key_type", "name_type").agg(F.count("*").alias("n"))


@plans.query("SELECT count(*) AS n, count(*) AS distinct_ids, 36::BIGINT AS width FROM customer")
def uuid_values(spark: SparkSession, d: str) -> DataFrame:
    u = load(spark, d, "customer").select(F.uuid().alias("u"))
    return u.agg(F.count("*").alias("n"), F.count_distinct("u").alias("distinct_ids"), F.max(F.length("u")).cast("long").alias("width"))


@plans.query("SELECT c_custkey, c_name, true AS hidden, 28 + strlen(c_name) AS sealed_bytes FROM customer")
def encrypt_decrypt(spark: SparkSession, d: str) -> DataFrame:
    key = F.lit("0123456789abcdef")
    sealed = load(spark, d, "customer").select("c_custkey", "c_name", F.aes_encrypt("c_name", key).alias("sealed"))
    hidden = F.instr(F.hex("sealed"), F.hex("c_name")) == 0
    return sealed.select("c_custkey", F.aes_decrypt("sealed", key).cast("string").alias("c_name"), hidden.alias("hidden"), F.octet_length("sealed").cast("long").alias("sealed_bytes"))


@plans.query("SELECT count(*) AS n, 0::BIGINT AS outside FROM lineitem")
def random_values(spark: SparkSession, d: str) -> DataFrame:
    r = load(spark, d, "lineitem").select(F.rand(7).alias("r"))
    return r.agg(F.count("*").alias("n"), F.count_if((F.col("r") < 0) | (F.col("r") >= 1)).alias("outside"))


@plans.query("""
SELECT o_orderkey, lpad(o_orderkey::VARCHAR, 9, '0') AS key, format('{:,.2f}', o_totalprice::DECIMAL(12,2)::DOUBLE) AS price, printf('%8d', o_orderkey) AS i8,
  CASE WHEN length(printf('%.1f', o_totalprice::DECIMAL(12,2)::DECIMAL(12,1)::DOUBLE)) > 9 THEN '*********' ELSE printf('%9s', o_totalprice::DECIMAL(12,2)::DECIMAL(12,1)::VARCHAR) END AS f9, rpad(left(o_orderpriority, 4), 4, ' ') AS c4, o_orderpriority AS c0
FROM orders
""")
def display_formats(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("o_totalprice").cast("decimal(12,2)")
    return load(spark, d, "orders").select(
        "o_orderkey", F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("key"), F.format_number(price, 2).alias("price"), S.display(F.col("o_orderkey"), "i8").alias("i8"), S.display(price, "f9.1").alias("f9"), S.display(F.col("o_orderpriority"), "c4").alias("c4"), S.display(F.col("o_orderpriority"), "c0").alias("c0")
    )


@plans.query("""
SELECT vec_id, round(list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding]), 6) AS squares, len([x FOR x IN embedding IF x > 0])::BIGINT AS positive, len(embedding) > 0 AND list_bool_or([x > 0.1 FOR x IN embedding]) AS some,
  {'low': round(list_min(embedding)::DOUBLE, 6), 'high': round(list_max(embedding)::DOUBLE, 6)}['high'] AS high FROM embeddings
""")
def ext_arrays_maps(spark: SparkSession, d: str) -> DataFrame:
    """Extension: not from the reference. Higher-order functions and maps."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    extremes = F.create_map(F.lit("low"), F.array_min(e), F.lit("high"), F.array_max(e))
    return load(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(e, F.lit(0.0), lambda a, x: a + x * x), 6).alias("squares"), F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("positive"), F.exists("embedding", lambda x: x > 0.1).alias("some"), F.round(F.element_at(extremes, "high"), 6).alias("high"))


@plans.query("SELECT event_id, json_extract_string(props, '$.k') AS k, len(props)::BIGINT AS n FROM events")
def ext_json(spark: SparkSession, d: str) -> DataFrame:
    """Extension: not from the reference."""
    return load(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.length("props").cast("long").alias("n"))
