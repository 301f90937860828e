"""More queries over the shared tables: text and path functions, rules of folders and
verified boot, links, caps and report rows, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmscope.functions import exprs as X
from firmscope.operators import device, diff, facts, ranges, report, rules, verified_boot
from firmscope.queries import _ENTRIES, _PROPS, _SERVICES, entries, props, query, services, table
from firmscope.sources import sniff
from firmscope.sources import text as tx


@query(
    f"""WITH {_PROPS}, v AS (SELECT key, string_agg(DISTINCT value, '/' ORDER BY value) AS shown, list(DISTINCT value) AS vs FROM props GROUP BY key),
s AS (SELECT max(CASE WHEN key = 'ro.secure' THEN shown END) AS secure, max(CASE WHEN key = 'ro.adb.secure' THEN shown END) AS adb_secure, max(CASE WHEN key = 'ro.debuggable' THEN shown END) AS debuggable, max(CASE WHEN key = 'persist.sys.usb.config' THEN shown END) AS usb FROM v)
SELECT coalesce(secure, 'not set') AS secure, coalesce(adb_secure, 'not set') AS adb_secure, coalesce(debuggable, 'not set') AS debuggable, coalesce(usb, 'not set') AS usb,
  CASE WHEN list_contains(string_split(debuggable, '/'), '1') OR list_contains(string_split(secure, '/'), '0') THEN 'adbd can run as root' WHEN list_contains(string_split(adb_secure, '/'), '0') THEN 'ADB needs no authorization'
  WHEN secure IS NULL AND adb_secure IS NULL AND debuggable IS NULL THEN 'no ADB properties found' ELSE 'ADB needs authorization and does not run as root' END AS verdict FROM s"""
)
def q_adb_summary(spark: SparkSession, sf: str) -> DataFrame:
    return device.adb_summary(props(spark, sf))


_FOLDERS = """files AS (SELECT c_custkey % 40 AS dir, CASE c_custkey % 6 WHEN 0 THEN 'System' WHEN 1 THEN 'vendor' WHEN 2 THEN 'boot' ELSE 'x' || c_custkey END
  || CASE WHEN c_custkey % 40 < 8 THEN '.txt' WHEN c_custkey % 40 < 20 THEN '.transfer.list' WHEN c_custkey % 7 = 0 THEN '.IMG' WHEN c_custkey % 7 = 1 THEN '.transfer.list' WHEN c_custkey % 7 = 2 THEN '.json' ELSE '.bin' END AS name, c_custkey % 11 <> 0 AS is_file FROM customer)"""


def _folders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").selectExpr(
        "c_custkey % 40 dir",
        "concat(case c_custkey % 6 when 0 then 'System' when 1 then 'vendor' when 2 then 'boot' else concat('x', c_custkey) end, case when c_custkey % 40 < 8 then '.txt' when c_custkey % 40 < 20 then '.transfer.list' when c_custkey % 7 = 0 then '.IMG' when c_custkey % 7 = 1 then '.transfer.list' when c_custkey % 7 = 2 then '.json' else '.bin' end) name",
        "c_custkey % 11 <> 0 is_file",
    )


@query(
    f"""WITH {_FOLDERS}, h AS (SELECT DISTINCT dir, regexp_extract(lower(name), '^(.+?)(\\.img|\\.transfer\\.list)$', 1) AS p FROM files WHERE is_file AND regexp_matches(lower(name), '^.+(\\.img|\\.transfer\\.list)$')), d AS (SELECT DISTINCT dir FROM files)
SELECT dir, 'error' AS severity, 'images' AS subject FROM d WHERE dir NOT IN (SELECT dir FROM h)
UNION ALL SELECT d.dir, 'warn', e.p || '.img' FROM d, (VALUES ('system'), ('vendor'), ('boot')) e(p) WHERE d.dir IN (SELECT dir FROM h) AND NOT EXISTS (SELECT 1 FROM h WHERE h.dir = d.dir AND h.p = e.p)"""
)
def q_folder_coverage(spark: SparkSession, sf: str) -> DataFrame:
    expected = spark.createDataFrame([(x,) for x in device.EXPECTED], "name string")
    return device.partition_coverage(_folders(spark, sf), expected)


@query(
    f"""WITH {_FOLDERS}, g AS (SELECT dir FROM files GROUP BY dir HAVING NOT bool_or(is_file AND suffix(lower(name), '.img')) AND bool_or(is_file AND suffix(lower(name), '.transfer.list')))
SELECT dir, rule FROM g, (VALUES ('mode_anomalies'), ('duplicate_properties'), ('selinux_label_gaps'), ('init_service_hygiene'), ('debug_leftovers')) r(rule)"""
)
def q_update_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return device.update_gaps(_folders(spark, sf))


@query(
    f"""WITH {_FOLDERS} SELECT dir, name FROM files WHERE is_file AND lower(name) NOT IN ('payload_properties.txt', 'metadata', 'care_map.pb', 'compatibility.zip') AND NOT regexp_matches(lower(name), '\\.(img|transfer\\.list|new\\.dat|new\\.dat\\.br|patch\\.dat|json|sha256)$')"""
)
def q_unhandled_input(spark: SparkSession, sf: str) -> DataFrame:
    return device.unhandled_input(_folders(spark, sf))


@query(
    f"""WITH {_ENTRIES}, e AS (SELECT image || (o_orderkey % 50) AS image, kind, o_orderkey % 50 > 20 AND o_orderkey % 3 = 0 AS labelled FROM entries)
SELECT image, count(*) FILTER (WHERE kind = 'file') AS files, count(*) FILTER (WHERE kind = 'file' AND labelled) AS labelled FROM e GROUP BY image HAVING count(*) FILTER (WHERE kind = 'file' AND labelled) = 0"""
)
def q_label_gaps(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf).withColumn("image", F.concat("image", (F.col("o_orderkey") % 50).cast("string")))
    labelled = (F.col("o_orderkey") % 50 > 20) & (F.col("o_orderkey") % 3 == 0)
    return device.label_gaps(e.withColumn("xattrs", F.when(labelled, F.col("xattrs")).otherwise(F.create_map().cast("map<string,string>"))))


@query(
    f"""WITH {_ENTRIES}, {_PROPS}, {_SERVICES}, i AS (SELECT DISTINCT image FROM entries UNION SELECT 'broken'),
q AS (SELECT image, 'mode_anomalies' AS rule, path AS subject, 'low' AS severity FROM entries WHERE kind = 'file' AND (mode & 2050) <> 0
UNION ALL SELECT image, 'duplicate_properties', key, 'low' FROM props GROUP BY image, key HAVING count(*) > 1 UNION ALL SELECT image, 'init_service_hygiene', name, 'low' FROM services GROUP BY image, name HAVING count(*) > 1
UNION ALL SELECT image, 'debug_leftovers', path, 'low' FROM entries WHERE kind = 'file' AND (regexp_matches(lower(path), '\\.(test|bak|log)$') OR contains(lower(path), '/test/') OR suffix(lower(path), '/test'))
UNION ALL SELECT 'broken', r, 'broken', 'info' FROM (VALUES ('mode_anomalies'), ('duplicate_properties'), ('selinux_label_gaps'), ('init_service_hygiene'), ('debug_leftovers')) x(r))
SELECT image, rule, subject, severity, rule IS NOT NULL AND image = 'broken' AS gap FROM q"""
)
def q_quality_grid(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf)
    images = e.select("image").distinct().withColumn("readable", F.lit(True)).unionByName(spark.createDataFrame([("broken", False)], "image string, readable boolean"))
    return device.quality_grid(images, e, props(spark, sf), services(spark, sf)).select("image", "rule", "subject", "severity", "gap")


_LINKS = """n AS (SELECT p_brand AS image, 'd/' || p_partkey AS path, CASE WHEN p_partkey % 3 = 0 THEN 'symlink' ELSE 'file' END AS kind,
  CASE p_partkey % 4 WHEN 0 THEN '/d/' || (p_partkey + 25) WHEN 1 THEN '../d/./' || (p_partkey + 50) WHEN 2 THEN CAST(p_partkey - 25 AS VARCHAR) ELSE '../../up' END AS link FROM part)"""


@query(
    f"""WITH RECURSIVE {_LINKS}, t AS (SELECT image, path, kind, CASE WHEN contains(link, 'up') THEN NULL ELSE 'd/' || regexp_extract(link, '-?[0-9]+$') END AS target FROM n),
w AS (SELECT image, path, target, 0 AS hop FROM t WHERE kind = 'symlink' UNION ALL
  SELECT w.image, w.path, t.target, w.hop + 1 FROM w JOIN t ON t.image = w.image AND t.path = w.target AND t.kind = 'symlink' WHERE w.hop < 7),
e AS (SELECT w.image, w.path, w.target FROM w JOIN t ON t.image = w.image AND t.path = w.target AND t.kind = 'file')
SELECT l.image, l.path, e.target FROM (SELECT image, path FROM t WHERE kind = 'symlink') l LEFT JOIN e USING (image, path)"""
)
def q_symlinks(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "part").selectExpr(
        "p_brand image",
        "concat('d/', p_partkey) path",
        "case when p_partkey % 3 = 0 then 'symlink' else 'file' end kind",
        "case p_partkey % 4 when 0 then concat('/d/', p_partkey + 25) when 1 then concat('../d/./', p_partkey + 50) when 2 then cast(p_partkey - 25 as string) else '../../up' end link",
    )
    return device.resolve_links(nodes)


@query(
    """WITH e AS (SELECT 'i' || (o_custkey % 4) AS image, 'f' || o_orderkey AS path, o_orderkey % 700 AS ino, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 2 END AS nlink, sha256(CAST(o_orderkey AS VARCHAR)) AS sha, o_orderkey % 6 <> 0 AS is_file FROM orders),
f AS (SELECT * FROM e WHERE is_file), w AS (SELECT *, first_value(path) OVER (PARTITION BY image, ino ORDER BY path) AS fp, first_value(sha) OVER (PARTITION BY image, ino ORDER BY path) AS fs FROM f)
SELECT image, path, CASE WHEN nlink > 1 THEN fp ELSE path END AS data_path, CASE WHEN nlink > 1 THEN fs ELSE sha END AS sha256 FROM w"""
)
def q_hard_links(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "orders").selectExpr("concat('i', o_custkey % 4) image", "concat('f', o_orderkey) path", "o_orderkey % 700 ino", "case when o_orderkey % 5 = 0 then 1 else 2 end nlink", "sha2(cast(o_orderkey as string), 256) sha256", "case when o_orderkey % 6 <> 0 then 'file' else 'dir' end kind")
    return report.hard_links(e)


@query(
    """WITH r AS (SELECT c_mktsegment AS seg, c_name || chr(10) || c_custkey AS line, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS n FROM customer)
SELECT seg, list(replace(line, chr(10), ' ') ORDER BY n) FILTER (WHERE n <= 25) AS lines, CAST(greatest(count(*) - 25, 0) AS BIGINT) AS more FROM r GROUP BY seg"""
)
def q_text_caps(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").selectExpr("c_mktsegment seg", "concat(c_name, '\n', c_custkey) line", "c_custkey")
    return report.capped_lists(c, "seg", "c_custkey", F.col("line"))


@query(
    """WITH c AS (SELECT 'img' || (o_custkey % 9) AS image, lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS path, ['added', 'removed', 'modified', 'metadata', 'unchanged'][CAST(o_orderkey % 5 + 1 AS INTEGER)] AS status FROM orders),
s AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY path) AS n FROM c WHERE status <> 'unchanged'), t AS (SELECT image, count(*) AS n, string_agg('  ' || rpad(status, 8, ' ') || ' /' || path, chr(10) ORDER BY n) FILTER (WHERE n <= 25) AS shown FROM s GROUP BY image)
SELECT c.image, c.image || ': ' || count(*) FILTER (WHERE status = 'added') || ' added, ' || count(*) FILTER (WHERE status = 'removed') || ' removed, ' || count(*) FILTER (WHERE status = 'modified') || ' modified, ' || count(*) FILTER (WHERE status = 'metadata') || ' metadata-only, ' || count(*) FILTER (WHERE status = 'unchanged') || ' unchanged'
  || coalesce(chr(10) || max(t.shown), '') || CASE WHEN max(t.n) > 25 THEN chr(10) || '  ... ' || (max(t.n) - 25) || ' more' ELSE '' END AS text FROM c LEFT JOIN t USING (image) GROUP BY c.image"""
)
def q_diff_digest(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "orders").selectExpr("concat('img', o_custkey % 9) image", "lpad(cast(o_orderkey as string), 9, '0') path", "element_at(array('added', 'removed', 'modified', 'metadata', 'unchanged'), cast(o_orderkey % 5 + 1 as int)) status")
    return report.diff_digest(c)


@query(
    """WITH h AS (SELECT o_custkey % 20 AS image, o_orderkey, CASE WHEN o_custkey % 20 < 10 THEN sha256(CAST(o_orderkey AS VARCHAR)) ELSE repeat('ab', 32) END AS h FROM orders),
b AS (SELECT image, h[2 * i - 1:2 * i] AS b FROM h, generate_series(1, 32) g(i)), n AS (SELECT image, b, count(*) AS n FROM b GROUP BY ALL), t AS (SELECT image, sum(n) AS t, sum(n * log2(n)) AS s FROM n GROUP BY image)
SELECT image, round(log2(t) - s / t, 6) AS entropy FROM t WHERE t >= 4096 AND log2(t) - s / t >= 7.9"""
)
def q_high_entropy(spark: SparkSession, sf: str) -> DataFrame:
    h = F.when(F.col("o_custkey") % 20 < 10, F.sha2(F.col("o_orderkey").cast("string"), 256)).otherwise("ab" * 32)
    data = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 20).alias("image")).agg(F.unhex(F.array_join(F.collect_list(h), "")).alias("data"))
    return ranges.high_entropy(data, ["image"], "data").select("image", F.round("entropy", 6).alias("entropy"))


_ELF_FILES = "SELECT 'img' || (o_custkey % 3) AS image, 'lib/' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') || CASE WHEN o_orderkey % 2 = 0 THEN '.so' ELSE '' END AS path, CASE WHEN o_orderkey % 3 = 0 THEN 73 ELSE 420 END AS mode, (o_orderkey * 7919) % 3000000 AS size, CASE WHEN o_orderkey % 17 = 0 THEN 'dir' ELSE 'file' END AS kind FROM orders"


@query(
    f"""WITH e AS ({_ELF_FILES}), c AS (SELECT image, path, size, count(*) OVER w AS n, sum(size) OVER w AS used FROM e WHERE kind = 'file' AND size BETWEEN 52 AND 67108864 AND (contains(path, '.so') OR (mode & 73) <> 0) WINDOW w AS (PARTITION BY image ORDER BY path ROWS UNBOUNDED PRECEDING))
SELECT image, path, size, (SELECT bool_or(x.n > 20000 OR x.used > 536870912) FROM c x WHERE x.image = c.image) AS truncated FROM c WHERE n <= 20000 AND used <= 536870912"""
)
def q_elf_candidates(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "orders").selectExpr("concat('img', o_custkey % 3) image", "concat('lib/', lpad(cast(o_orderkey as string), 9, '0'), case when o_orderkey % 2 = 0 then '.so' else '' end) path", "case when o_orderkey % 3 = 0 then 73 else 420 end mode", "(o_orderkey * 7919) % 3000000 size", "case when o_orderkey % 17 = 0 then 'dir' else 'file' end kind")
    files, cut = facts.elf_candidates(e)
    return files.join(F.broadcast(cut), "image")  # one row an image


@query(
    """WITH x AS (SELECT o_orderkey AS k, chr(8206) || o_orderpriority || chr(9) || '`it''s' || chr(27) AS t FROM orders)
SELECT k, regexp_replace(t, '[\\x00-\\x1f\\x7f-\\x{9f}\\x{200b}-\\x{200f}\\x{2028}-\\x{202e}\\x{2060}-\\x{2069}\\x{feff}]', ' ', 'g') AS plain,
  substr(replace(regexp_replace(t, '[\\x00-\\x1f\\x7f-\\x{9f}\\x{200b}-\\x{200f}\\x{2028}-\\x{202e}\\x{2060}-\\x{2069}\\x{feff}]', ' ', 'g'), '`', ''''), 1, 300) AS field, '''' || replace(t, '''', '''\\''''') || '''' AS quoted FROM x"""
)
def q_text_safety(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("‎"), F.col("o_orderpriority"), F.lit("\t`it's\x1b")).alias("t"))
    return x.select("k", X.sanitize(F.col("t")).alias("plain"), X.clean_field(F.col("t")).alias("field"), X.shell_quote(F.col("t")).alias("quoted"))


@query(
    """WITH x AS (SELECT o_orderkey AS k, ['a.tar.gz', 'a.tgz', 'b.tar.md5', 'c.ozip', 'd.tar.lz4.md5', 'e.img.xz', 'f', 'g.tbz2.md5'][CAST(o_orderkey % 8 + 1 AS INTEGER)] AS name, CASE o_orderkey % 5 WHEN 0 THEN '2024-13-01' WHEN 1 THEN '1969-12-31' WHEN 2 THEN '2023-02' WHEN 3 THEN '24-01-01' ELSE strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') END AS d, o_orderkey % 40 AS sdk FROM orders)
SELECT k, ['a', 'a', 'b', 'c', 'd', 'e.img', 'f', 'g'][CAST(k % 8 + 1 AS INTEGER)] AS stem, CASE WHEN k % 5 = 2 THEN DATE '2023-02-01' WHEN k % 5 = 4 THEN CAST(d AS DATE) END AS day,
  CASE WHEN sdk BETWEEN 21 AND 36 THEN ['5.0', '5.1', '6.0', '7.0', '7.1', '8.0', '8.1', '9', '10', '11', '12', '12L', '13', '14', '15', '16'][CAST(sdk - 20 AS INTEGER)] END AS release, CAST(greatest(0, 36 - sdk) AS BIGINT) AS behind FROM x"""
)
def q_names_and_dates(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "orders").selectExpr("o_orderkey k", "element_at(array('a.tar.gz', 'a.tgz', 'b.tar.md5', 'c.ozip', 'd.tar.lz4.md5', 'e.img.xz', 'f', 'g.tbz2.md5'), cast(o_orderkey % 8 + 1 as int)) name", "case o_orderkey % 5 when 0 then '2024-13-01' when 1 then '1969-12-31' when 2 then '2023-02' when 3 then '24-01-01' else date_format(o_orderdate, 'yyyy-MM-dd') end d", "o_orderkey % 40 sdk")
    return x.select("k", X.archive_stem(F.col("name")).alias("stem"), X.strict_date(F.col("d")).alias("day"), X.android_release(F.col("sdk")).alias("release"), X.releases_behind(F.col("sdk")).cast("bigint").alias("behind"))


@query(
    """WITH x AS (SELECT o_orderkey AS k, CAST(pow(3, o_orderkey % 26) AS BIGINT) + o_custkey AS n FROM orders), u AS (SELECT *, CASE WHEN n >= 1099511627776 THEN 1099511627776 WHEN n >= 1073741824 THEN 1073741824 WHEN n >= 1048576 THEN 1048576 WHEN n >= 1024 THEN 1024 ELSE 0 END AS b FROM x)
SELECT k, CASE WHEN b = 0 THEN n || ' B' ELSE regexp_replace(printf('%.1f', n::DOUBLE / b), '\\.0$', '') || CASE b WHEN 1024 THEN ' KiB' WHEN 1048576 THEN ' MiB' WHEN 1073741824 THEN ' GiB' ELSE ' TiB' END END AS shown FROM u"""
)
def q_human_size(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), (F.pow(F.lit(3), F.col("o_orderkey") % 26).cast("bigint") + F.col("o_custkey")).alias("n"))
    return x.select("k", X.human_size(F.col("n")).alias("shown"))


@query(
    """WITH x AS (SELECT o_orderkey AS k, sha256(CAST(o_orderkey AS VARCHAR)) AS h FROM orders)
SELECT k, CAST('0x' || h[7:8] || h[5:6] || h[3:4] || h[1:2] AS BIGINT) AS little, CAST('0x' || h[3:10] AS BIGINT) AS big FROM x"""
)
def q_integers(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.unhex(F.sha2(F.col("o_orderkey").cast("string"), 256)).alias("b"))
    return x.select("k", X.little_endian(F.col("b"), 0, 4).alias("little"), X.big_endian(F.col("b"), 1, 4).alias("big"))


_MAGIC = "['504B0304', '504B0506', '43724155', '1F8B08', '1F8B00', '40414D4C', '55AA5AA5', '0353494E', '425A6839', '425A6861', '00000000']"


@query(
    f"""WITH f AS (SELECT c_custkey AS k, c_custkey % 11 AS m, c_custkey || CASE c_custkey % 3 WHEN 0 THEN '.nb0' WHEN 1 THEN '.cpb' ELSE '.bin' END AS path FROM customer),
z AS (SELECT k, max(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END) AS ab, max(CASE WHEN o_orderkey % 3 = 1 THEN 1 ELSE 0 END) AS blk FROM f JOIN orders ON o_custkey = k GROUP BY k)
SELECT path, CASE WHEN m <= 1 THEN CASE WHEN ab = 1 THEN 'ab-ota-zip' WHEN blk = 1 THEN 'block-ota-zip' ELSE 'zip' END WHEN m = 2 THEN 'payload-bin' WHEN m = 3 THEN 'gzip' WHEN m = 5 THEN 'aml-container' WHEN m = 6 THEN 'huawei-update-app' WHEN m = 7 THEN 'sony-sin' WHEN m = 8 THEN 'bzip2'
  ELSE CASE k % 3 WHEN 0 THEN 'nokia-nb0' WHEN 1 THEN 'coolpad-cpb' ELSE 'unknown' END END AS kind FROM f LEFT JOIN z USING (k)"""
)
def q_identify(spark: SparkSession, sf: str) -> DataFrame:
    path = "concat(c_custkey, case c_custkey % 3 when 0 then '.nb0' when 1 then '.cpb' else '.bin' end) path"
    files = table(spark, sf, "customer").selectExpr(path, f"unhex(element_at(array{_MAGIC.replace('[', '(').replace(']', ')')}, cast(c_custkey % 11 + 1 as int))) content", "c_custkey")
    names = F.when(F.col("o_orderkey") % 3 == 0, "payload.bin").when(F.col("o_orderkey") % 3 == 1, "system.transfer.list").otherwise("d/vendor.transfer.list")
    members = files.join(table(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey")).select("path", names.alias("name"))
    return sniff.identify(files, members)


@query(
    f"""WITH {_ENTRIES}, o AS (SELECT * FROM entries WHERE o_orderkey % 10 <> 0), n AS (SELECT * REPLACE ((mode * 3) % 4096 AS mode) FROM entries WHERE o_orderkey % 10 <> 1),
{_SERVICES}, so AS (SELECT image, file, name, arg_max("user" IS NULL OR "user" = 'root', ord) AS root FROM services WHERE ord % 3 <> 0 GROUP BY ALL), sn AS (SELECT image, file, name, arg_max("user" IS NULL OR "user" = 'root', ord) AS root FROM services WHERE ord % 3 <> 1 GROUP BY ALL)
SELECT n.image, 'diff-new-setuid' AS rule, 'high' AS severity, n.path AS subject, '' AS key FROM n WHERE n.kind = 'file' AND (n.mode & 3072) <> 0 AND NOT EXISTS (SELECT 1 FROM o WHERE o.image = n.image AND o.path = n.path AND o.kind = 'file' AND (o.mode & 3072) <> 0)
UNION ALL SELECT n.image, 'diff-new-capability', 'medium', n.path, 'c' || (n.o_orderkey % 2) FROM n WHERE n.o_orderkey % 7 = 0 AND NOT EXISTS (SELECT 1 FROM o WHERE o.image = n.image AND o.path = n.path AND o.o_orderkey % 14 = 0)
UNION ALL SELECT sn.image, 'diff-root-service', 'high', sn.file, sn.name FROM sn LEFT JOIN so USING (image, file, name) WHERE sn.root AND (so.root IS NULL OR NOT so.root)
UNION ALL SELECT coalesce(o.image, n.image), 'diff-sepolicy-changed', 'medium', coalesce(o.path, n.path), '' FROM o FULL JOIN n ON o.image = n.image AND o.path = n.path WHERE (o.path IS NULL OR n.path IS NULL) AND contains(coalesce(o.path, n.path), 'etc/selinux/') AND coalesce(n.kind, o.kind) <> 'dir'"""
)
def q_regressions(spark: SparkSession, sf: str) -> DataFrame:
    cap = F.create_map(F.lit("security.capability"), F.concat(F.lit("c"), (F.col("o_orderkey") % 2).cast("string")))
    none = F.create_map().cast("map<string,string>")
    e = entries(spark, sf)
    old = e.where("o_orderkey % 10 <> 0").withColumn("xattrs", F.when(F.col("o_orderkey") % 14 == 0, cap).otherwise(none))
    new = e.where("o_orderkey % 10 <> 1").withColumn("mode", F.expr("(mode * 3) % 4096")).withColumn("xattrs", F.when(F.col("o_orderkey") % 7 == 0, cap).otherwise(none))
    s = services(spark, sf)
    findings = rules.seal(rules.prop_findings(props(spark, sf).where("false")))
    side = lambda x, y: {"entries": x, "special": facts.special_files(x), "services": y, "findings": findings}
    return diff.regressions(side(old, s.where("ord % 3 <> 0")), side(new, s.where("ord % 3 <> 1"))).select("image", "rule", "severity", "subject", "key")


@query(
    f"""WITH {_ENTRIES} SELECT image, 'file-capabilities' AS rule, 'info' AS severity, count(*) || ' files with capabilities' AS message FROM entries WHERE o_orderkey % 5 = 0 GROUP BY image"""
)
def q_file_capabilities(spark: SparkSession, sf: str) -> DataFrame:
    cap = F.create_map(F.lit("security.capability"), F.lit("x"))
    e = entries(spark, sf).withColumn("xattrs", F.when(F.col("o_orderkey") % 5 == 0, cap).otherwise(F.create_map().cast("map<string,string>")))
    return rules.file_findings(facts.special_files(e)).where("rule = 'file-capabilities'").select("image", "rule", "severity", "message")


@query(
    """WITH v AS (SELECT s_suppkey AS k, s_suppkey % 6 AS m FROM supplier)
SELECT 'd' || k AS dir, CASE m WHEN 0 THEN 'info' WHEN 1 THEN 'error' WHEN 2 THEN 'warn' WHEN 3 THEN 'warn' ELSE 'info' END AS severity, CASE m WHEN 0 THEN 'verified' WHEN 1 THEN 'signature does not verify' WHEN 2 THEN 'unsigned' WHEN 3 THEN 'algorithm 9 is not checked' WHEN 4 THEN 'could not read vbmeta.img' ELSE 'no vbmeta.img found' END AS outcome FROM v"""
)
def q_avb_signature(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    folders = s.selectExpr("concat('d', s_suppkey) dir")
    meta = s.where("s_suppkey % 6 <> 5").selectExpr("concat('d', s_suppkey) dir", "case s_suppkey % 6 when 0 then 'valid' when 1 then 'invalid' when 2 then 'absent' when 3 then 'unsupported' end signature", "case when s_suppkey % 6 = 3 then 9 when s_suppkey % 6 = 2 then 0 else 1 end algorithm", "case when s_suppkey % 6 = 4 then 'broken' end error")
    return verified_boot.signature_outcomes(folders, meta)


@query(
    """WITH f AS (SELECT event_id, ['info', 'low', 'medium', 'high', 'critical'][CAST(event_id % 5 + 1 AS INTEGER)] AS severity, event_type AS rule, substr(sha256(CAST(event_id AS VARCHAR)), 1, 16) AS fp FROM events)
SELECT event_id, row_number() OVER (ORDER BY CASE severity WHEN 'info' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END DESC, rule, fp) AS place FROM f QUALIFY place <= 200"""
)
def q_report_order(spark: SparkSession, sf: str) -> DataFrame:
    """The first 200 findings of a report, with their places: a top-k report."""
    f = table(spark, sf, "events").selectExpr("event_id", "cast(event_id % 5 as int) sev_rank", "event_type rule", "substr(sha2(cast(event_id as string), 256), 1, 16) fingerprint")
    first = report.ordered(f).limit(200).agg(F.array_sort(F.collect_list(F.struct((-F.col("sev_rank")).alias("s"), "rule", "fingerprint", "event_id"))).alias("r"))
    return first.select(F.posexplode("r").alias("place", "f")).select("f.event_id", (F.col("place") + 1).cast("bigint").alias("place"))


@query(
    """WITH f AS (SELECT event_id, event_type AS rule, ['info', 'low', 'medium', 'high', 'critical'][CAST(event_id % 5 + 1 AS INTEGER)] AS severity FROM events)
SELECT CAST(event_id AS BIGINT) AS scan_ord, rule AS rule_id, CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level, 'found ' || event_id AS text, CASE WHEN event_id % 3 <> 0 THEN 'img/a%20b/' || event_id END AS uri FROM f"""
)
def q_sarif(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "events").selectExpr("event_id scan_ord", "event_type rule", "element_at(array('info', 'low', 'medium', 'high', 'critical'), cast(event_id % 5 + 1 as int)) severity", "concat('found\t', event_id) message", "'img' scope", "concat('./a b/', event_id) subject", "event_id % 3 <> 0 located", "'f' fingerprint")
    f = f.withColumn("uri", X.location_uri(F.col("scope"), F.col("subject"), F.col("located")))
    read = "struct<ruleId: string, level: string, message: struct<text: string>, locations: array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>>>>>"
    r = report.sarif_results(f).select("scan_ord", F.from_json("result", read).alias("r"))
    return r.select("scan_ord", F.col("r.ruleId").alias("rule_id"), "r.level", F.col("r.message.text").alias("text"), F.col("r.locations")[0]["physicalLocation"]["artifactLocation"]["uri"].alias("uri"))


@query("SELECT event_type AS rule FROM events UNION SELECT p_type FROM part")
def q_sarif_rules(spark: SparkSession, sf: str) -> DataFrame:
    return report.sarif_rules(table(spark, sf, "events").selectExpr("event_type rule"), table(spark, sf, "part").selectExpr("p_type rule"))


@query("WITH p AS (SELECT DISTINCT p_brand AS image, p_name || CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'a' END AS path FROM part) SELECT image, path, path AS extracted_as FROM p")
def q_case_allowed(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").selectExpr("p_brand image", "concat(p_name, case when p_partkey % 2 = 0 then 'A' else 'a' end) path").distinct()
    return report.case_collisions(p, "allow")


@query(
    """WITH e AS (SELECT 'i' || (o_custkey % 3) AS image, CASE WHEN o_orderkey % 4 = 0 THEN 'etc/' ELSE '' END || 'n' || o_orderkey AS path, CASE WHEN o_orderkey % 9 = 0 THEN 'dir' ELSE 'file' END AS kind FROM orders),
h AS (SELECT image, path, kind, path AS name, row_number() OVER (PARTITION BY image ORDER BY kind <> 'dir', path) AS n, count(*) OVER (PARTITION BY image) AS total FROM e WHERE NOT contains(path, '/'))
SELECT image, path, kind, name, CAST(greatest(total - 5000, 0) AS BIGINT) AS more FROM h WHERE n <= 5000"""
)
def q_listing(spark: SparkSession, sf: str) -> DataFrame:
    """What an explorer shows of the top folder: a top-k report."""
    e = table(spark, sf, "orders").selectExpr("concat('i', o_custkey % 3) image", "concat(case when o_orderkey % 4 = 0 then 'etc/' else '' end, 'n', o_orderkey) path", "case when o_orderkey % 9 = 0 then 'dir' else 'file' end kind")
    return report.listing(e)


@query("SELECT 'p' || (l_orderkey % 50) AS path, l_returnflag AS partition, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS blob_bytes FROM lineitem GROUP BY ALL")
def q_blob_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return report.blob_bytes(table(spark, sf, "lineitem").selectExpr("concat('p', l_orderkey % 50) path", "l_returnflag partition", "cast(l_quantity as bigint) length", "cast(null as string) error"))


@query("SELECT page_id AS path, CASE WHEN page_id % 3 = 0 THEN 'no key=value entries' WHEN page_id % 7 = 0 THEN 'larger than 1 MiB' END AS error FROM pages WHERE page_id % 3 = 0 OR page_id % 7 = 0")
def q_metadata_errors(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("page_id") % 3 == 0, "no entry").when(F.col("page_id") % 7 == 0, F.concat(F.lit("k="), F.repeat(F.lit("x"), 1 << 20))).otherwise("a=b")
    return tx.metadata_errors(table(spark, sf, "pages").select(F.col("page_id").alias("path"), text.alias("text")))


@query("SELECT page_id AS path, 'k' || (page_id % 4) AS key, 'v' || page_id || '=x' AS value FROM pages UNION ALL SELECT page_id, 'z', '2' FROM pages WHERE page_id % 5 = 0")
def q_ota_metadata(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat(F.lit("noise\n k"), (F.col("page_id") % 4).cast("string"), F.lit(" = v"), F.col("page_id").cast("string"), F.lit("=x \r\n"), F.when(F.col("page_id") % 5 == 0, "z=1\nz=2").otherwise(""))
    return tx.ota_metadata(table(spark, sf, "pages").select(F.col("page_id").alias("path"), line.alias("text")))


@query("SELECT o_orderkey AS path, r.i AS cmd_idx, CASE r.i WHEN 0 THEN 'new' WHEN 1 THEN 'zero' ELSE 'new' END AS cmd, r.b + o_orderkey % 10 AS begin, r.e + o_orderkey % 10 AS \"end\" FROM orders, (VALUES (0, 0, 4), (1, 4, 6), (1, 8, 9), (2, 20, 30)) r(i, b, e)")
def q_transfer_list(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey") % 10
    n = lambda x: (k + x).cast("string")
    text = F.concat(F.lit("4\n17\n0\n0\nnew 2,"), n(0), F.lit(","), n(4), F.lit("\nzero 4,"), n(4), F.lit(","), n(6), F.lit(","), n(8), F.lit(","), n(9), F.lit("\nnew 2,"), n(20), F.lit(","), n(30), F.lit("\n"))
    return tx.transfer_list(table(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), text.alias("text"))).select("path", "cmd_idx", "cmd", "begin", "end")


@query("SELECT o_orderkey AS path, (30 + o_orderkey % 10) * 4096 AS size FROM orders")
def q_image_size(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").selectExpr("o_orderkey path", "explode(array(4 + o_orderkey % 10, 30 + o_orderkey % 10, 9 + o_orderkey % 10)) end")
    return tx.image_size(rows)


@query("SELECT s_suppkey AS path, 'part' || s_suppkey AS label, CASE WHEN s_suppkey % 2 = 0 THEN 'f.img' END AS filename, s_suppkey * 256 AS start, CAST(17 + s_suppkey AS BIGINT) AS size FROM supplier")
def q_scatter(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    text = F.concat(F.lit("# head\npart"), k.cast("string"), F.lit("\t0x"), F.lower(F.hex(k * 256)), F.lit("  "), (k + 17).cast("string"), F.when(k % 2 == 0, " f.img # note").otherwise(" # f"), F.lit("\nshort line\n"))
    return tx.scatter(table(spark, sf, "supplier").select(k.alias("path"), text.alias("text")))
