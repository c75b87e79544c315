"""Queries over versions of a table."""

from pyspark.sql import functions as F

from layover.operators import versions as vs
from layover.registry import part, query

part(
    "d_commits",
    """SELECT DISTINCT snapshot_id, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' DAY * snapshot_id AS committed_at
FROM (SELECT added_snapshot AS snapshot_id FROM v_order_versions
 UNION ALL SELECT removed_snapshot FROM v_order_versions WHERE removed_snapshot IS NOT NULL)""",
)


def commits(t):
    """The commit log the test table's snapshots belong to: one commit a day."""
    ids = t.order_versions.select(F.explode(F.array("added_snapshot", "removed_snapshot")).alias("snapshot_id"))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return (
        ids.filter("snapshot_id IS NOT NULL")
        .distinct()
        .withColumn("committed_at", start + F.make_dt_interval(F.col("snapshot_id")))
    )


def seen(snapshot: str) -> str:
    return f"added_snapshot <= {snapshot} AND (removed_snapshot IS NULL OR removed_snapshot > {snapshot})"


ROWS = "order_id, line_id, amount, committed_at"
FIFTH = "(SELECT max(snapshot_id) FROM d_commits WHERE committed_at <= TIMESTAMP '2024-01-06 18:00:00')"

query(
    "snapshot_log",
    """SELECT c.snapshot_id, c.committed_at, coalesce(a.n, 0) AS added_rows, coalesce(r.n, 0) AS removed_rows,
 CASE WHEN coalesce(a.n, 0) > 0 AND coalesce(r.n, 0) > 0 THEN 'overwrite' WHEN coalesce(r.n, 0) > 0 THEN 'delete' ELSE 'append' END AS operation
FROM d_commits c
LEFT JOIN (SELECT added_snapshot AS s, count(*) AS n FROM v_order_versions GROUP BY 1) a ON a.s = c.snapshot_id
LEFT JOIN (SELECT removed_snapshot AS s, count(*) AS n FROM v_order_versions GROUP BY 1) r ON r.s = c.snapshot_id""",
)(lambda t: vs.snapshot_log(t.order_versions, commits(t)))

query(
    "snapshot_history",
    """SELECT committed_at AS made_current_at, snapshot_id,
 lag(snapshot_id) OVER (ORDER BY committed_at, snapshot_id) AS parent_id FROM d_commits""",
)(lambda t: vs.snapshot_history(commits(t)))

query(
    "first_snapshot",
    "SELECT snapshot_id, committed_at FROM d_commits ORDER BY committed_at, snapshot_id LIMIT 1",
)(lambda t: vs.first_snapshot(commits(t)))

query("read_snapshot", f"SELECT {ROWS} FROM v_order_versions WHERE {seen('3')}")(
    lambda t: vs.read_snapshot(t.order_versions, 3)
)
query("read_current", f"SELECT {ROWS} FROM v_order_versions WHERE removed_snapshot IS NULL ORDER BY order_id")(
    lambda t: vs.read_current(t.order_versions).orderBy("order_id", "line_id", "amount")
)
query("read_as_of", f"SELECT {ROWS} FROM v_order_versions WHERE {seen(FIFTH)}")(
    lambda t: vs.read_as_of(t.order_versions, commits(t), "2024-01-06 18:00:00")
)
query("read_as_of_text", f"SELECT {ROWS} FROM v_order_versions WHERE {seen(FIFTH)}")(
    lambda t: vs.read_as_of_text(t.order_versions, commits(t), "Sat, 06 Jan 2024 18:00:00 GMT")
)
query("read_as_of_millis", f"SELECT {ROWS} FROM v_order_versions WHERE {seen(FIFTH)}")(
    lambda t: vs.read_as_of_millis(t.order_versions, commits(t), 1704564000000)
)
query(
    "snapshot_compare",
    f"""SELECT now_rows AS current_rows, then_rows AS past_rows, now_rows - then_rows AS rows_added FROM (
 SELECT count(*) FILTER (WHERE removed_snapshot IS NULL) AS now_rows, count(*) FILTER (WHERE {seen('3')}) AS then_rows FROM v_order_versions)""",
)(lambda t: vs.compare(t.order_versions, 3))
