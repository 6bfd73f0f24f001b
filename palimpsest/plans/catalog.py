"""Every query over the engine's operators, beside SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import codec
from palimpsest.model import MAX_SEQ
from palimpsest.operators import batch, bloom, compaction, manifest, visibility
from palimpsest.plans.logs import events_log, order_files, orders_log, run_of, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_LOG = """log AS (SELECT user_id AS key, event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS op,
    CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value FROM events)"""
_RANKED = _LOG + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log)"
_LIVE = _RANKED + ", live AS (SELECT key, seq, value FROM ranked WHERE rn = 1 AND op = 1)"
_FILES = """files AS (
    SELECT 1 AS level, CAST(floor(o_orderkey / 1000) AS BIGINT) AS num, min(o_orderkey) AS smallest, max(o_orderkey) AS largest, count(*) * 100 AS file_size FROM orders GROUP BY 2
    UNION ALL
    SELECT 2, CAST(floor((o_orderkey + 500) / 2000) AS BIGINT), min(o_orderkey), max(o_orderkey), count(*) * 100 FROM orders GROUP BY 2)"""
_RUNS = _LOG + """, runs AS (SELECT CAST(floor((seq - 1) / 1000) AS BIGINT) AS num, min(key) AS smallest, max(key) AS largest,
    min(seq) AS min_seq, max(seq) AS max_seq, count(*) AS entries FROM log GROUP BY 1)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _filled(df: DataFrame, *columns: str) -> DataFrame:
    """-1 for null, so that whole numbers stay whole in any client."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(-1).cast(df.schema[c].dataType)) for c in columns})


def _keys(spark: SparkSession, values: list[int], name: str = "key") -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} long")


def _values(values: list[int], name: str) -> str:
    return f"{name}s AS (SELECT * FROM (VALUES {', '.join(f'(CAST({v} AS BIGINT))' for v in values)}) AS t({name}))"


# --- reads ---------------------------------------------------------------------------------


@query(f"WITH {_LIVE} SELECT key, seq, value FROM live")
def kv_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibility.live(events_log(spark, sf_dir))


@query(f"WITH {_LIVE} SELECT key, seq, value FROM live")
def kv_live_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibility.latest(events_log(spark, sf_dir), how="window").filter("op = 1").drop("op")


@query(f"""WITH {_LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log WHERE seq <= 5000)
    SELECT key, seq, value FROM r WHERE rn = 1 AND op = 1""")
def kv_live_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibility.live(events_log(spark, sf_dir, upto=5000))


@query(f"WITH {_LIVE}, {_values([7], 'k')} SELECT k AS key, seq, value, seq IS NOT NULL AS found FROM ks LEFT JOIN live ON key = k")
def kv_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = visibility.get(events_log(spark, sf_dir), 7)
    return _keys(spark, [7]).join(hit, "key", "left").withColumn("found", F.col("seq").isNotNull())


@query(f"""WITH {_RANKED}, k AS (SELECT min(key) AS key FROM ranked WHERE rn = 1 AND op = 0)
    SELECT k.key, count(l.seq) FILTER (WHERE l.rn = 1 AND l.op = 1) > 0 AS found FROM k LEFT JOIN ranked l ON l.key = k.key GROUP BY k.key""")
def kv_get_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events_log(spark, sf_dir)
    gone = visibility.tombstones(log).agg(F.min("key").alias("key"))
    return visibility.multi_get(log, gone).select("key", "found")


_WANTED = [1, 5, 5, 42, 77, 149, 100_000]


@query(f"WITH {_LIVE}, {_values(_WANTED, 'k')} SELECT k AS key, coalesce(seq, -1) AS seq, value, seq IS NOT NULL AS found FROM ks LEFT JOIN live ON key = k")
def kv_multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(visibility.multi_get(events_log(spark, sf_dir), _keys(spark, _WANTED)), "seq")


@query(f"WITH {_RANKED} SELECT key, seq, op, value, rn AS version FROM ranked WHERE key >= 20 AND key < 40")
def kv_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibility.history(events_log(spark, sf_dir), 20, 40).withColumn("version", F.col("version").cast("long"))


@query(f"WITH {_LOG} SELECT key, seq, op, value FROM log")
def kv_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibility.entries(events_log(spark, sf_dir))


@query(f"WITH {_LIVE} SELECT key, seq, value FROM live WHERE key >= 30 AND key < 120 ORDER BY key LIMIT 25")
def kv_scan_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibility.scan(events_log(spark, sf_dir), 30, 120, limit=25)


@query(f"WITH {_LIVE} SELECT key, seq, value FROM live WHERE key >= 30 AND key < 120 ORDER BY key DESC LIMIT 25")
def kv_scan_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibility.scan(events_log(spark, sf_dir), 30, 120, reverse=True, limit=25)


_TARGETS = [-5, 0, 17, 18, 60, 149, 150, 100_000]


@query(f"""WITH {_LIVE}, {_values(_TARGETS, 'target')}, f AS (SELECT target, min(key) AS key FROM targets LEFT JOIN live ON key >= target GROUP BY target)
    SELECT f.target, coalesce(f.key, -1) AS key, coalesce(live.seq, -1) AS seq, live.value FROM f LEFT JOIN live ON live.key = f.key""")
def kv_seek_ge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(visibility.seek(events_log(spark, sf_dir), _keys(spark, _TARGETS, "target")), "key", "seq")


@query(f"""WITH {_LIVE}, {_values(_TARGETS, 'target')}, f AS (SELECT target, max(key) AS key FROM targets LEFT JOIN live ON key < target GROUP BY target)
    SELECT f.target, coalesce(f.key, -1) AS key, coalesce(live.seq, -1) AS seq, live.value FROM f LEFT JOIN live ON live.key = f.key""")
def kv_seek_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(visibility.seek(events_log(spark, sf_dir), _keys(spark, _TARGETS, "target"), before=True), "key", "seq")


@query(f"""WITH {_LIVE} SELECT key, seq, value, 'first' AS which FROM live WHERE key = (SELECT min(key) FROM live)
    UNION ALL SELECT key, seq, value, 'last' FROM live WHERE key = (SELECT max(key) FROM live)""")
def kv_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibility.first_last(events_log(spark, sf_dir))


@query(f"WITH {_LIVE} SELECT key, coalesce(lag(key) OVER (ORDER BY key), -1) AS prev_key, coalesce(lead(key) OVER (ORDER BY key), -1) AS next_key FROM live")
def kv_next_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(visibility.neighbours(events_log(spark, sf_dir)), "prev_key", "next_key")


@query(f"WITH {_RANKED} SELECT key, seq FROM ranked WHERE rn = 1 AND op = 0")
def kv_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibility.tombstones(events_log(spark, sf_dir))


@query(f"WITH {_LOG} SELECT key, count(*) FILTER (WHERE op = 1) AS puts, count(*) FILTER (WHERE op = 0) AS deletes FROM log GROUP BY key")
def kv_put_delete_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibility.op_counts(events_log(spark, sf_dir))


@query("""WITH r AS (SELECT o_custkey AS key, o_orderkey AS seq, o_orderstatus, o_totalprice AS value, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders)
    SELECT key, seq, value FROM r WHERE rn = 1 AND o_orderstatus <> 'F'""")
def orders_latest_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibility.live(orders_log(spark, sf_dir))


@query("""WITH r AS (SELECT conv_id AS key, turn AS seq, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)
    SELECT key, seq, role, text FROM r WHERE rn = 1""")
def conversation_last_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return visibility.live(c.select(F.col("conv_id").alias("key"), F.col("turn").alias("seq"), F.lit(1).alias("op"), "role", "text"))


# --- batches -------------------------------------------------------------------------------


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events_log(spark, sf_dir).withColumn("batch_id", F.floor((F.col("seq") - 1) / 8))
    ops = F.transform(F.array_sort(F.collect_list(F.struct("seq", "op", "key", "value"))), lambda o: F.struct(o["op"].alias("op"), o["key"].alias("key"), o["value"].alias("value")))
    return rows.groupBy("batch_id").agg(F.min("seq").alias("base_seq"), ops.alias("ops"))


_EXPLODED = _LOG + ", rows_ AS (SELECT CAST(floor((seq - 1) / 8) AS BIGINT) AS batch_id, (seq - 1) % 8 AS pos, key, seq, op, value FROM log)"


@query(f"WITH {_EXPLODED} SELECT batch_id, CAST(pos AS INTEGER) AS pos, key, seq, op, value FROM rows_")
def batch_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.explode(_batches(spark, sf_dir))


@query(f"""WITH {_EXPLODED}, n AS (SELECT batch_id, count(*) AS found FROM rows_ GROUP BY 1)
    SELECT batch_id, CAST(8 AS BIGINT) AS expected, found, found = 8 AS ok FROM n""")
def batch_count_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = _batches(spark, sf_dir)
    return batch.count_check(batch.explode(batches), batches.select("batch_id", F.lit(8).cast("long").alias("expected")))


@query(f"""WITH {_EXPLODED}, r AS (SELECT *, row_number() OVER (PARTITION BY batch_id, key ORDER BY pos DESC) AS rn FROM rows_)
    SELECT batch_id, key, CAST(pos AS INTEGER) AS pos, op FROM r WHERE rn = 1""")
def batch_last_op_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.last_op_wins(batch.explode(_batches(spark, sf_dir)))


@query(f"WITH {_EXPLODED} SELECT CAST(0 AS BIGINT) AS batch_id, CAST(seq - 1 AS INTEGER) AS pos, key, seq, op, value FROM rows_")
def batch_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.explode(batch.concat(_batches(spark, sf_dir))).withColumn("pos", F.col("pos").cast("int"))


@query("""SELECT batch_id, count(*) AS ops, CAST(sum(bytes) AS BIGINT) AS bytes FROM (
        SELECT CAST(floor(event_id / 8) AS BIGINT) AS batch_id, length(CAST(user_id AS VARCHAR)) + CASE WHEN event_type = 'error' THEN 0 ELSE length(event_type) END AS bytes FROM events)
    GROUP BY batch_id""")
def batch_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("batch_id", F.floor(F.col("event_id") / 8))
    size = F.octet_length(F.col("user_id").cast("string")) + F.when(F.col("event_type") == "error", 0).otherwise(F.octet_length("event_type"))
    return e.groupBy("batch_id").agg(F.count("*").alias("ops"), F.sum(size).alias("bytes"))


# --- encodings -----------------------------------------------------------------------------


@query(f"WITH {_LOG} SELECT key, seq * 256 + op AS tag, seq, op FROM log")
def tag_pack_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = events_log(spark, sf_dir).select("key", codec.tag(F.col("seq"), F.col("op")).alias("tag"))
    return packed.select("key", "tag", codec.seq_of(F.col("tag")).alias("seq"), codec.op_of(F.col("tag")).alias("op"))


def _varint_case(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} < {128**n} THEN {n}" for n in range(1, 9)) + " ELSE 9 END"


@query(f"WITH {_LOG} SELECT seq, {_varint_case('seq')} AS seq_bytes, {_varint_case('(seq * 256 + op)')} AS tag_bytes FROM log")
def varint_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events_log(spark, sf_dir)
    return log.select("seq", codec.varint_length(F.col("seq")).alias("seq_bytes"), codec.varint_length(codec.tag(F.col("seq"), F.col("op"))).alias("tag_bytes"))


@query("""SELECT o_orderkey AS x,
        CASE WHEN o_orderkey < 128 THEN printf('%02X', o_orderkey)
             WHEN o_orderkey < 16384 THEN printf('%02X%02X', o_orderkey % 128 + 128, o_orderkey // 128)
             ELSE printf('%02X%02X%02X', o_orderkey % 128 + 128, (o_orderkey // 128) % 128 + 128, o_orderkey // 16384) END AS varint,
        printf('%02X%02X%02X%02X', o_orderkey % 256, (o_orderkey // 256) % 256, (o_orderkey // 65536) % 256, o_orderkey // 16777216) AS fixed32,
        o_orderkey AS from_varint, o_orderkey AS from_fixed FROM orders""")
def fixed_and_varint(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("x"))
    coded = x.select("x", codec.varint(F.col("x")).alias("v"), codec.fixed(F.col("x"), 4).alias("f"))
    return coded.select("x", F.hex("v").alias("varint"), F.hex("f").alias("fixed32"), codec.read_varint(F.col("v")).alias("from_varint"), codec.read_fixed(F.col("f"), 4).alias("from_fixed"))


@query("SELECT p_partkey AS key, printf('%02X', length(p_name)) || hex(p_name) AS coded FROM part")
def length_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.hex(codec.length_prefixed(F.col("p_name"))).alias("coded"))


@query("""WITH s AS (SELECT c_name AS key, lag(c_name) OVER (ORDER BY c_name) AS prev, row_number() OVER (ORDER BY c_name) - 1 AS i FROM customer),
    n AS (SELECT key, i, CASE WHEN i % 16 = 0 OR prev IS NULL THEN 0 ELSE
        (SELECT count(*) FROM range(1, 1 + least(length(s.key), length(s.prev))) t(j) WHERE left(s.key, CAST(j AS INTEGER)) = left(s.prev, CAST(j AS INTEGER))) END AS shared FROM s)
    SELECT key, CAST(shared AS INTEGER) AS shared, substr(key, CAST(shared AS INTEGER) + 1) AS rest FROM n""")
def prefix_shared_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys as a block stores them: what they share with the key before is left out, but for every 16th."""
    keys = table(spark, sf_dir, "customer").select(F.col("c_name").alias("key"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = keys.repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id())
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"), F.max("key").alias("hi"))
    order = Window.orderBy("part")  # a row per partition
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.lag("hi").over(order).alias("lower"))
    w = Window.partitionBy("part").orderBy("key")
    at = placed.join(F.broadcast(sizes), "part").select("key", (F.row_number().over(w) - 1 + F.col("before")).alias("i"), F.coalesce(F.lag("key").over(w), "lower").alias("prev"))
    shared = F.when(F.col("i") % 16 == 0, 0).otherwise(codec.shared_prefix(F.col("key"), F.col("prev")))
    return at.select("key", shared.cast("int").alias("shared")).withColumn("rest", F.expr("substring(key, shared + 1)"))


@query("""WITH k AS (SELECT DISTINCT p_name AS key FROM part), s AS (SELECT key, lead(key) OVER (ORDER BY key) AS next_key FROM k),
    n AS (SELECT key, next_key, CAST((SELECT count(*) FROM range(1, 1 + least(length(s.key), length(s.next_key))) t(j)
        WHERE left(s.key, CAST(j AS INTEGER)) = left(s.next_key, CAST(j AS INTEGER))) AS INTEGER) AS n FROM s WHERE next_key IS NOT NULL)
    SELECT key, next_key, CASE WHEN n < least(length(key), length(next_key)) AND ascii(substr(key, n + 1, 1)) + 1 < ascii(substr(next_key, n + 1, 1))
        THEN left(key, n) || chr(ascii(substr(key, n + 1, 1)) + 1) ELSE key END AS separator FROM n""")
def index_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an index may store between neighbouring keys instead of the first one."""
    log = table(spark, sf_dir, "part").select(F.col("p_name").alias("key"), F.col("p_partkey").alias("seq"), F.lit(1).alias("op"))
    near = visibility.neighbours(log).filter("next_key is not null")
    return near.select("key", "next_key", codec.shortest_separator(F.col("key"), F.col("next_key")).cast("string").alias("separator"))


_CRC_STEP = "list_reduce([c, 1, 1, 1, 1, 1, 1, 1, 1], lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 2197175160) ELSE x >> 1 END)"


@query(f"""WITH b AS (SELECT p_partkey AS key, list_transform(range(1, length(p_name) + 1), lambda i: CAST(ascii(substr(p_name, CAST(i AS INTEGER), 1)) AS BIGINT)) AS bytes FROM part)
    SELECT key, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda a, b: {_CRC_STEP.replace('[c,', '[xor(a, b),')}), 4294967295) AS crc FROM b""")
def crc32c_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), codec.crc32c(F.col("p_name").cast("binary")).alias("crc"))


# --- runs, files, versions -----------------------------------------------------------------


@query(f"WITH {_RUNS} SELECT num, smallest, largest, min_seq, max_seq, entries FROM runs")
def run_file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.file_stats(events_log(spark, sf_dir).withColumn("num", run_of(F.col("seq"))), ["num"])


@query(f"WITH {_FILES} SELECT a.num AS a_num, b.num AS b_num FROM files a JOIN files b ON a.level = 1 AND b.level = 2 AND a.smallest <= b.largest AND a.largest >= b.smallest")
def run_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = order_files(spark, sf_dir)
    return manifest.overlaps(files.filter("level = 1"), files.filter("level = 2"))


_PRUNED = [0, 999, 1000, 1499, 1500, 5321, 14_999, 900_000]


@query(f"""WITH {_FILES}, {_values(_PRUNED, 'key')} SELECT key, level, num, row_number() OVER (PARTITION BY key ORDER BY level, num DESC) AS turn
    FROM keys JOIN files ON key BETWEEN smallest AND largest""")
def run_prune_for_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.lookup_order(_keys(spark, _PRUNED), order_files(spark, sf_dir)).select("key", "level", "num", F.col("turn").cast("long").alias("turn"))


@query(f"""WITH {_RUNS}, {_values([3, 70, 149, 500], 'key')} SELECT key, num, row_number() OVER (PARTITION BY key ORDER BY num DESC) AS turn
    FROM keys JOIN runs ON key BETWEEN smallest AND largest""")
def l0_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = run_file_stats(spark, sf_dir).withColumn("level", F.lit(0))
    return manifest.lookup_order(_keys(spark, [3, 70, 149, 500]), runs).select("key", "num", F.col("turn").cast("long").alias("turn"))


@query(f"WITH {_LIVE} SELECT key, seq, value FROM live")
def merge_runs_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events_log(spark, sf_dir)
    flushed = compaction.dedup_run(log.filter("seq <= 5000"))
    return visibility.live(compaction.merge([flushed, log.filter("seq > 5000 and seq <= 8000"), log.filter("seq > 8000")]))


@query(f"""WITH {_LOG}, r AS (SELECT *, CAST(floor((seq - 1) / 1000) AS BIGINT) AS run FROM log),
    n AS (SELECT *, row_number() OVER (PARTITION BY run, key ORDER BY seq DESC) AS rn FROM r) SELECT run, key, seq, op, value FROM n WHERE rn = 1""")
def flush_run_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = events_log(spark, sf_dir).withColumn("run", run_of(F.col("seq")))
    rank = F.row_number().over(Window.partitionBy("run", "key").orderBy(F.col("seq").desc()))
    return runs.withColumn("rank", rank).filter("rank = 1").drop("rank")


@query(f"""WITH {_FILES} SELECT level, num, smallest, largest, file_size FROM files f WHERE NOT (level = 1 AND num % 3 = 0)
    UNION ALL SELECT 2, num + 1000, smallest, largest, file_size FROM files WHERE level = 1 AND num % 3 = 0""")
def manifest_apply_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = order_files(spark, sf_dir)
    moved = files.filter("level = 1 and num % 3 = 0")
    return manifest.apply_edit(files, moved.select("level", "num"), moved.withColumn("level", F.lit(2)).withColumn("num", F.col("num") + 1000))


@query(f"WITH {_FILES} SELECT num, smallest, largest FROM files WHERE level = 1 AND num NOT IN (SELECT num FROM files WHERE level = 2)")
def manifest_obsolete(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = order_files(spark, sf_dir)
    return manifest.obsolete(files.filter("level = 1").select("num", "smallest", "largest"), files.filter("level = 2"))


@query(f"WITH {_FILES} SELECT num, smallest, largest FROM files WHERE level = 1 AND num NOT IN (SELECT num FROM files WHERE num % 2 = 0)")
def manifest_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = order_files(spark, sf_dir)
    return manifest.missing(files.filter("level = 1").select("num", "smallest", "largest"), files.filter("num % 2 = 0"))


@query(f"WITH {_FILES} SELECT level, count(*) AS files, CAST(sum(file_size) AS BIGINT) AS bytes FROM files GROUP BY level")
def level_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.level_sizes(order_files(spark, sf_dir))


_SCORES = f"""WITH {_FILES}, {_RUNS}, l AS (SELECT level, file_size FROM files UNION ALL SELECT 0, entries * 32 FROM runs),
    s AS (SELECT level, count(*) AS files, CAST(sum(file_size) AS BIGINT) AS bytes FROM l GROUP BY level),
    scores AS (SELECT level, files, bytes, CASE WHEN level = 0 THEN files / 4.0::DOUBLE ELSE bytes / (10485760.0::DOUBLE * power(10.0::DOUBLE, level - 1)) END AS score FROM s)"""


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = run_file_stats(spark, sf_dir).select(F.lit(0).alias("level"), (F.col("entries") * 32).alias("file_size"))
    return order_files(spark, sf_dir).select("level", "file_size").unionByName(zero)


@query(f"{_SCORES} SELECT level, files, bytes, score FROM scores")
def level_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.level_scores(_levels(spark, sf_dir))


@query(f"{_SCORES} SELECT level, score FROM scores ORDER BY score DESC LIMIT 1")
def level_to_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.fullest_level(_levels(spark, sf_dir))


@query(f"{_SCORES} SELECT coalesce(max(files) FILTER (WHERE level = 0), 0) AS level0, CASE WHEN max(files) FILTER (WHERE level = 0) >= 12 THEN 'stop' WHEN max(files) FILTER (WHERE level = 0) >= 8 THEN 'slow' ELSE 'go' END AS action FROM scores")
def write_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.pressure(_levels(spark, sf_dir))


@query(f"WITH {_FILES} SELECT level, min(smallest) AS smallest, max(largest) AS largest FROM files GROUP BY level")
def key_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.key_range(order_files(spark, sf_dir), "level")


@query(f"""WITH {_FILES}, w AS (SELECT *, lag(largest) OVER (PARTITION BY level ORDER BY smallest, num) AS previous FROM files)
    SELECT level, num, smallest, largest, coalesce(previous, -1) AS previous, coalesce(previous < smallest, TRUE) AS ok FROM w""")
def level_overlap_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(manifest.order_check(order_files(spark, sf_dir)).drop("file_size"), "previous")


@query(f"""WITH {_LOG}, r AS (SELECT CAST(floor((seq - 1) / 1000) AS BIGINT) AS run, key, seq, 24 + seq % 7 AS size FROM log)
    SELECT run, key, seq, CAST(floor(coalesce(sum(size) OVER (PARTITION BY run ORDER BY key, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 4096) AS BIGINT) AS block FROM r""")
def block_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events_log(spark, sf_dir).select(run_of(F.col("seq")).alias("run"), "key", "seq", (24 + F.col("seq") % 7).alias("size"))
    return manifest.cut_by_size(rows, "size", 4096, "run", ["key", "seq"]).drop("size")


# --- compaction and recovery ---------------------------------------------------------------


def _dropped(seq: str) -> str:
    return f"""WITH {_LOG}, s AS (SELECT {seq} AS s FROM log), w AS (SELECT *, coalesce(lag(seq) OVER (PARTITION BY key ORDER BY seq DESC), {MAX_SEQ}) AS newer FROM log)"""


@query(f"{_dropped('max(seq)')} SELECT key, seq, op, value FROM w, s WHERE newer > s AND NOT (op = 0 AND seq <= s)")
def compact_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events_log(spark, sf_dir)
    return compaction.keep_rule(log, log.agg(F.max("seq")).first()[0])


@query(f"{_dropped('5000')} SELECT DISTINCT key, seq, op, value FROM w, s WHERE newer > s AND NOT (op = 0 AND seq <= s)")
def compact_with_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.keep_rule(events_log(spark, sf_dir), 5000)


@query(f"""{_dropped('9000')} SELECT DISTINCT key, seq, op, value FROM w, s WHERE newer > s AND
    NOT (op = 0 AND seq <= s AND NOT (key BETWEEN 20 AND 60 OR key BETWEEN 100 AND 120))""")
def compact_nonbase(spark: SparkSession, sf_dir: str) -> DataFrame:
    deeper = spark.createDataFrame([(20, 60), (100, 120)], "smallest long, largest long")
    return compaction.keep_rule(events_log(spark, sf_dir), 9000, deeper)


@query("SELECT CAST(0 AS BIGINT) AS differences")
def compact_read_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events_log(spark, sf_dir)
    kept = compaction.keep_rule(log, 5000)
    seen = [compaction.read_differences(visibility.live(kept, s), visibility.live(log, s)) for s in (5000, 7000, None)]
    return compaction.merge([d.select("key") for d in seen]).agg(F.count("*").alias("differences"))


@query(f"WITH {_LOG} SELECT key, seq, op, value, max(seq) OVER () AS last_seq FROM log WHERE seq > 9000")
def recover_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events_log(spark, sf_dir).filter("seq > 9000")
    return log.join(F.broadcast(log.agg(F.max("seq").alias("last_seq"))))


@query(f"WITH {_LIVE}, {_values([1, 5, 42, 77, 149, 100000], 'k')} SELECT key, seq, value FROM live WHERE key IN (SELECT k FROM ks)")
def bloom_prefilter_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wanted keys as a filter over the log; what it lets pass wrongly, the exact join takes out."""
    wanted = _keys(spark, [1, 5, 42, 77, 149, 100_000])
    bits, k = bloom.size_for(6, 10), bloom.probes(10)
    log = bloom.may_hold(events_log(spark, sf_dir), bloom.build(wanted, bits, k), bits, k)
    return visibility.live(log.join(wanted, "key", "left_semi"))


@query("SELECT count(DISTINCT user_id) AS keys, CAST(0 AS BIGINT) AS false_negatives FROM events")
def bloom_no_false_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "events").select(F.col("user_id").alias("key")).distinct()
    bits, k = 2048, bloom.probes(10)
    passing = bloom.may_hold(keys, bloom.build(keys, bits, k), bits, k)
    return keys.agg(F.count("*").alias("keys")).join(F.broadcast(passing.agg(F.count("*").alias("n")))).select("keys", (F.col("keys") - F.col("n")).alias("false_negatives"))
