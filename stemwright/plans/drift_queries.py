"""Queries over the two flags-file tables whose schema drifts (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemwright.operators import drift
from stemwright.session import table

_COLUMNS = ["line_id", "run", "file_name", "written_at", "line_no", "record"]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "flags_pilot2").select(*_COLUMNS)
    return first.unionByName(table(spark, sf_dir, "flags_pilot3_position").select(*_COLUMNS))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.schema_changes(_lines(spark, sf_dir)).select("file_name", "field_name", "change_kind").distinct()


def p2_path_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = drift.path_stats(drift.path_values(drift.parsed_lines(_lines(spark, sf_dir))))
    return stats.select("file_name", "field_name", "n_values", F.concat_ws(",", "kinds").alias("kinds"))


def p2_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.consistent_table(_lines(spark, sf_dir))[0]


def p2_failed_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.consistent_table(_lines(spark, sf_dir))[1]


QUERIES = {"p2_found": p2_found, "p2_path_stats": p2_path_stats, "p2_table": p2_table, "p2_failed_casts": p2_failed_casts}

_VALUES = """
WITH raw AS (SELECT * FROM flags_pilot2 UNION ALL SELECT * FROM flags_pilot3_position),
ok AS (SELECT run, file_name, written_at, line_no, record::JSON AS j FROM raw
       WHERE json_valid(record) AND json_type(record) = 'OBJECT'),
keyed AS (SELECT run, file_name, line_no, j, unnest(json_keys(j)) AS field_name FROM ok),
typed AS (SELECT run, file_name, line_no, lower(trim(j->>'job_id')) AS job, field_name,
            json_type(j->('$."' || field_name || '"')) AS jt, j->>('$."' || field_name || '"') AS txt FROM keyed),
vals AS (SELECT run, file_name, line_no, job, field_name, txt,
            CASE WHEN jt = 'VARCHAR' THEN 'string' WHEN jt = 'BOOLEAN' THEN 'boolean' WHEN jt = 'ARRAY' THEN 'array'
                 WHEN jt = 'OBJECT' THEN 'object' ELSE 'number' END AS kind FROM typed WHERE jt <> 'NULL')
"""

ORACLE = {
    "p2_path_stats": _VALUES
    + """SELECT file_name, field_name, count(*)::BIGINT AS n_values,
    array_to_string(list_sort(list_distinct(list(kind))), ',') AS kinds FROM vals GROUP BY run, file_name, field_name""",
    "p2_found": _VALUES
    + """,
files AS (SELECT run, file_name, min(written_at) AS wa FROM raw GROUP BY ALL),
steps AS (SELECT run, file_name, lag(file_name) OVER (PARTITION BY run ORDER BY wa, file_name) AS prev_file FROM files),
st AS (SELECT run, file_name, field_name, list_sort(list_distinct(list(kind))) AS kinds FROM vals GROUP BY ALL),
old AS (SELECT s.run, s.file_name AS step, t.field_name, t.kinds FROM steps s JOIN st t ON t.run = s.run AND t.file_name = s.prev_file),
new AS (SELECT s.run, s.file_name AS step, t.field_name, t.kinds FROM steps s JOIN st t ON t.run = s.run AND t.file_name = s.file_name
        WHERE s.prev_file IS NOT NULL),
gone AS (SELECT run, step, field_name FROM old ANTI JOIN new USING (run, step, field_name)),
came AS (SELECT run, step, field_name FROM new ANTI JOIN old USING (run, step, field_name)),
jobs AS (SELECT DISTINCT run, file_name, job FROM vals WHERE job IS NOT NULL),
firsts AS (SELECT run, file_name, field_name, job, arg_min(txt, line_no) AS txt FROM vals WHERE job IS NOT NULL GROUP BY ALL),
shared AS (SELECT s.run, s.file_name AS step, s.prev_file, a.job FROM steps s JOIN jobs a ON a.run = s.run AND a.file_name = s.file_name
           JOIN jobs b ON b.run = s.run AND b.file_name = s.prev_file AND b.job = a.job),
o AS (SELECT h.run, h.step, h.job, g.field_name, f.txt FROM gone g JOIN shared h USING (run, step)
      LEFT JOIN firsts f ON f.run = h.run AND f.file_name = h.prev_file AND f.job = h.job AND f.field_name = g.field_name),
n AS (SELECT h.run, h.step, h.job, c.field_name, f.txt FROM came c JOIN shared h USING (run, step)
      LEFT JOIN firsts f ON f.run = h.run AND f.file_name = h.step AND f.job = h.job AND f.field_name = c.field_name),
ren AS (SELECT o.run, o.step, o.field_name AS old_name, n.field_name FROM o JOIN n ON o.run = n.run AND o.step = n.step AND o.job = n.job
        GROUP BY ALL HAVING bool_and(o.txt IS NOT DISTINCT FROM n.txt) AND count(o.txt) > 0)
SELECT step AS file_name, field_name, 'renamed' AS change_kind FROM ren
UNION SELECT step, field_name, 'removed' FROM gone ANTI JOIN (SELECT run, step, old_name AS field_name FROM ren) r USING (run, step, field_name)
UNION SELECT step, field_name, 'added' FROM came ANTI JOIN ren USING (run, step, field_name)
UNION SELECT step, field_name, 'retyped' FROM old JOIN new USING (run, step, field_name) WHERE old.kinds <> new.kinds""",
}
