"""Snapshots, retention and eviction over the file table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.operators.ordered import Ordered
from siltstone.sources.tables import documents_as_files, load


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(old, new) file lists with (file_id, path, size): some ids are dropped, renamed, changed or added."""
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.concat(F.lit("/"), "source", F.lit("/doc_"), "doc_id").alias("path"), F.col("n_chars").alias("size"))
    old = d.where("file_id % 19 <> 0")
    new = d.where("file_id % 17 <> 0").select("file_id", F.when(F.col("file_id") % 13 == 0, F.concat("path", F.lit("_moved"))).otherwise(F.col("path")).alias("path"), (F.col("size") + F.when(F.col("file_id") % 11 == 0, 1).otherwise(0)).alias("size"))
    return old, new


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file_id, change, path): full outer join on the path, then lost and new paths of one file_id are a rename."""
    both = old.select("path", F.col("file_id").alias("old_id"), F.col("size").alias("old_size")).join(new.select("path", F.col("file_id").alias("new_id"), F.col("size").alias("new_size")), "path", "full_outer")
    changed = both.where("old_id IS NOT NULL AND new_id IS NOT NULL AND old_size <> new_size").select(F.col("new_id").alias("file_id"), F.lit("modified").alias("change"), "path")
    lost = both.where("new_id IS NULL").select(F.col("old_id").alias("file_id"), F.col("path").alias("old_path"))
    found = both.where("old_id IS NULL").select(F.col("new_id").alias("file_id"), F.col("path").alias("new_path"))
    moved = lost.join(found, "file_id", "full_outer")
    kind = F.when(F.col("old_path").isNull(), "added").when(F.col("new_path").isNull(), "deleted").otherwise("renamed")
    return changed.unionByName(moved.select("file_id", kind.alias("change"), F.coalesce("new_path", "old_path").alias("path")))


def q_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_diff(*snapshots(spark, sf_dir))


def q_reconcile_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file table after the diff: deletions gone, renames moved, changed and new files pending."""
    old, new = snapshots(spark, sf_dir)
    diff = snapshot_diff(old, new).select("file_id", "change")
    rows = new.join(diff, "file_id", "left")
    return rows.select("file_id", "path", "size", F.when(F.col("change").isin("modified", "added"), "Pending").otherwise("Indexed").alias("status"))


def q_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source, newest files first: the first 40 of at most 100,000 characters in all are kept."""
    d = load(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    newest = Window.partitionBy("source").orderBy(F.desc("doc_id")).rowsBetween(Window.unboundedPreceding, 0)  # by rows: each task first keeps its own 40 of a source
    d = d.withColumn("position", F.row_number().over(newest)).withColumn("running", F.sum("n_chars").over(newest))
    return d.where("position <= 40 AND running <= 100000").select("source", "doc_id", "running")


def retention_passes(files: DataFrame, most: int, most_size: int, days: int) -> DataFrame:
    """(log, file_id, removed_by) of files (log, file_id, modified, size): the first of three passes that removes a file.

    count: not among the ``most`` newest of its log; size: the oldest go until the log holds at most
    ``most_size``; age: more than ``days`` before the newest file of all.  Other files have "kept".
    """
    newest = Window.partitionBy("log").orderBy(F.desc("modified"), F.desc("file_id")).rowsBetween(Window.unboundedPreceding, 0)
    last = files.agg(F.max("modified")).scalar()
    f = files.withColumn("position", F.row_number().over(newest)).withColumn("held", F.sum("size").over(newest))
    old = F.col("modified") < last - F.expr(f"INTERVAL {days} DAYS")
    removed = F.when(F.col("position") > most, "count").when(F.col("held") > most_size, "size").when(old, "age").otherwise("kept")
    return f.select("log", "file_id", removed.alias("removed_by"))


def q_retention_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the log files of their customer: seven of at most 1,000,000 in all, not older than 1,000 days."""
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("log"), F.col("o_orderkey").alias("file_id"), F.col("o_orderdate").alias("modified"), F.floor("o_totalprice").cast("long").alias("size"))
    return retention_passes(o, 7, 1_000_000, 1000)


def oldest_to_free(entries: DataFrame, needed: int) -> DataFrame:
    """Entries (event_type, user_id, last_used, size) that go, least recently used first, until ``needed`` is free.

    Running sums of whole days come first, one row a day and label; only the days that start below
    ``needed`` are then summed entry by entry, each day apart, so no label is one task.
    """
    e = entries.withColumn("day", F.to_date("last_used"))
    days = e.groupBy("event_type", "day").agg(F.sum("size").alias("of_day"))
    by_day = Window.partitionBy("event_type").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("event_type", "day", F.coalesce(F.sum("of_day").over(by_day), F.lit(0)).alias("earlier")).where(F.col("earlier") < needed)
    in_day = Window.partitionBy("event_type", "day").orderBy("last_used", "user_id").rowsBetween(Window.unboundedPreceding, -1)
    e = e.join(days, ["event_type", "day"]).withColumn("freed_before", F.col("earlier") + F.coalesce(F.sum("size").over(in_day), F.lit(0)))
    return e.where(F.col("freed_before") < needed).drop("day", "earlier")


def q_lru_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per label the least recently used entries that must go to free 5,000 units."""
    e = load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("last_used"), F.sum(F.round("value", 2).cast("decimal(18,2)")).alias("size"))
    return oldest_to_free(e, 5000).select("event_type", "user_id", "last_used", F.round(F.col("freed_before").cast("double"), 2).alias("freed_before"))


def q_crowded_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories with more than ten files, and how many of their files are too large."""
    d = load(spark, sf_dir, "documents")
    return d.groupBy(F.concat(F.lit("/"), "source", F.lit("/"), "lang").alias("dir")).agg(F.count("*").alias("files"), F.count_if(F.col("n_chars") > 5000).alias("too_large")).where("files > 10")


#: Most files of a directory and most bytes of a file that are looked at.
MOST_FILES, MOST_BYTES = 10_000, 500 * 1024 * 1024


def filtered_files(files: DataFrame, most_files: int = MOST_FILES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``files`` (path, size_bytes, ...) with ``verdict``: TooManyFiles (all files of a directory that itself holds more), TooLarge, or Include.

    The directory is tried first; a null size is no large one.  Only crowded directories are joined, of
    which there are at most a ``most_files``-th of the rows.
    """
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    crowded = files.groupBy(folder.alias("_dir")).agg(F.count("*").alias("_n")).where(F.col("_n") > most_files)
    verdict = F.when(F.col("_n").isNotNull(), "TooManyFiles").when(F.col("size_bytes") > most_bytes, "TooLarge").otherwise("Include")
    return files.withColumn("_dir", folder).join(crowded, "_dir", "left").withColumn("verdict", verdict).drop("_dir", "_n")


def q_filtered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files, under limits of 60 files a directory and 5000 bytes a file."""
    return filtered_files(documents_as_files(spark, sf_dir), 60, 5000).select("doc_id", "verdict")


def pair_renames(events: DataFrame) -> DataFrame:
    """(user_id, from_event, to_event, kind) of events (user_id, event_id, ts, half: From or To).

    A To takes the oldest From that waits, each From once; a To that finds none is a new file.  Without a
    loop: with +1 for From and -1 for To, a To finds none exactly when the running sum falls below all
    sums before it (and 0); the j-th other To takes the j-th From.  Sums run in pieces with a carry.
    """
    one = lambda c: F.when(c, 1).otherwise(0).cast("long")
    is_from = F.col("half") == "From"
    alone = ~is_from & (F.col("sum") < F.least(F.lit(0), F.coalesce("lowest", F.lit(0))))
    e = Ordered(events, ["user_id"], ["ts", "event_id"]).running_sum("sum", F.when(is_from, 1).otherwise(-1).cast("long")).running_min("lowest", F.col("sum"), inclusive=False)
    e = e.running_sum("lost", one(is_from)).running_sum("found", one(~is_from & ~alone)).result()
    e = e.withColumn("alone", alone).withColumn("n", F.when(is_from, F.col("lost")).otherwise(F.col("found")))
    lost = e.where("half = 'From'").select("user_id", "n", F.col("event_id").alias("from_event"))
    found = e.where("half = 'To' AND NOT alone").select("user_id", "n", F.col("event_id").alias("to_event"))
    pairs = found.join(lost, ["user_id", "n"]).select("user_id", "from_event", "to_event", F.lit("Renamed").alias("kind"))
    return pairs.unionByName(e.where("alone").select("user_id", F.lit(None).cast("long").alias("from_event"), F.col("event_id").alias("to_event"), F.lit("Created").alias("kind")))


def q_rename_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups as the old and purchases as the new half of a rename, per user; from_event is -1 for new files."""
    half = F.when(F.col("event_type") == "signup", "From").when(F.col("event_type") == "purchase", "To")
    pairs = pair_renames(load(spark, sf_dir, "events").select("user_id", "event_id", "ts", half.alias("half")).where("half IS NOT NULL"))
    return pairs.withColumn("from_event", F.coalesce("from_event", F.lit(-1)))


_SNAP = """d AS (SELECT doc_id AS file_id, '/' || source || '/doc_' || doc_id AS path, n_chars AS size FROM documents), old AS (SELECT * FROM d WHERE file_id % 19 <> 0),
new AS (SELECT file_id, CASE WHEN file_id % 13 = 0 THEN path || '_moved' ELSE path END AS path, size + CASE WHEN file_id % 11 = 0 THEN 1 ELSE 0 END AS size FROM d WHERE file_id % 17 <> 0),
diff AS (SELECT coalesce(new.file_id, old.file_id) AS file_id, CASE WHEN old.file_id IS NULL THEN 'added' WHEN new.file_id IS NULL THEN 'deleted' WHEN old.path <> new.path THEN 'renamed' ELSE 'modified' END AS change, coalesce(new.path, old.path) AS path
  FROM old FULL OUTER JOIN new ON old.file_id = new.file_id WHERE old.file_id IS NULL OR new.file_id IS NULL OR old.path <> new.path OR old.size <> new.size)"""

QUERIES = {"filtered_files": q_filtered_files, "snapshot_diff": q_snapshot_diff, "reconcile_apply": q_reconcile_apply, "retention_by_size": q_retention, "retention_passes": q_retention_passes, "lru_evict": q_lru_evict, "crowded_dirs": q_crowded_dirs, "rename_pairs": q_rename_pairs}
ORACLE_SQL = {
    "filtered_files": "SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY source, lang) > 60 THEN 'TooManyFiles' WHEN n_chars > 5000 THEN 'TooLarge' ELSE 'Include' END AS verdict FROM documents",
    "snapshot_diff": f"WITH {_SNAP} SELECT * FROM diff",
    "reconcile_apply": f"WITH {_SNAP} SELECT new.file_id, new.path, new.size, CASE WHEN change IN ('modified', 'added') THEN 'Pending' ELSE 'Indexed' END AS status FROM new LEFT JOIN diff USING (file_id)",
    "retention_by_size": "SELECT source, doc_id, CAST(running AS BIGINT) AS running FROM (SELECT *, row_number() OVER w AS position, sum(n_chars) OVER w AS running FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id DESC)) WHERE position <= 40 AND running <= 100000",
    "retention_passes": """WITH f AS (SELECT *, row_number() OVER w AS position, sum(CAST(floor(o_totalprice) AS BIGINT)) OVER w AS held FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT o_custkey AS log, o_orderkey AS file_id, CASE WHEN position > 7 THEN 'count' WHEN held > 1000000 THEN 'size' WHEN o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 1000 DAY THEN 'age' ELSE 'kept' END AS removed_by FROM f""",
    "lru_evict": """WITH e AS (SELECT user_id, event_type, max(ts) AS last_used, sum(CAST(round(value, 2) AS DECIMAL(18, 2))) AS size FROM events GROUP BY 1, 2),
    f AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY event_type ORDER BY last_used, user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS freed_before FROM e)
    SELECT event_type, user_id, last_used, round(freed_before, 2) AS freed_before FROM f WHERE freed_before < 5000""",
    "crowded_dirs": "SELECT '/' || source || '/' || lang AS dir, count(*) AS files, count(*) FILTER (n_chars > 5000) AS too_large FROM documents GROUP BY 1 HAVING count(*) > 10",
    "rename_pairs": """WITH h AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'signup' THEN 1 ELSE -1 END AS d FROM events WHERE event_type IN ('signup', 'purchase')),
    a AS (SELECT *, sum(d) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM h),
    b AS (SELECT *, d < 0 AND s < least(0, coalesce(min(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS alone FROM a),
    c AS (SELECT *, row_number() OVER (PARTITION BY user_id, d, alone ORDER BY ts, event_id) AS n FROM b)
    SELECT t.user_id, f.event_id AS from_event, t.event_id AS to_event, 'Renamed' AS kind FROM c t JOIN c f ON f.user_id = t.user_id AND f.n = t.n AND f.d = 1 WHERE t.d = -1 AND NOT t.alone
    UNION ALL SELECT user_id, -1, event_id, 'Created' FROM c WHERE alone""",
}
