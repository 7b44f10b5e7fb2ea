"""A deterministic encoding of `events` as instructions, the same text for Spark and the SQL oracle.

A user is a method. signup becomes an invoke of a source API and a move-result, view a move, click a constant,
purchase an invoke of a sink API, error a branch (goto, return-void or if-eqz by k mod 5). Offsets are even.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SOURCES = ("android.content.Intent.getStringExtra", "android.widget.EditText.getText", "android.location.LocationManager.getLastLocation")
SINKS = ("android.database.SQLiteDatabase.rawQuery", "android.util.Log.d", "android.webkit.WebView.loadUrl", "android.app.Activity.startActivity")


def _pick(names: tuple[str, ...]) -> str:
    return "CASE k % " + str(len(names)) + " " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


_TEMPLATE = f"""
ev AS (SELECT user_id AS m, event_id, event_type AS t, coalesce(CAST(@K AS BIGINT), 0) AS k FROM events),
raw AS (SELECT m, event_id, 0 AS sub, t, k, CASE t WHEN 'signup' THEN 'invoke-virtual' WHEN 'view' THEN 'move' WHEN 'click' THEN 'const/4' WHEN 'purchase' THEN 'invoke-virtual'
               ELSE CASE k % 5 WHEN 0 THEN 'goto' WHEN 1 THEN 'return-void' ELSE 'if-eqz' END END AS mnemonic FROM ev
        UNION ALL SELECT m, event_id, 1 AS sub, t, k, 'move-result-object' AS mnemonic FROM ev WHERE t = 'signup'),
num AS (SELECT m, event_id, sub, t, k, mnemonic, CAST(row_number() OVER (PARTITION BY m ORDER BY event_id, sub) - 1 AS BIGINT) AS idx, CAST(count(*) OVER (PARTITION BY m) AS BIGINT) AS n,
               'v' || CAST(k % 4 AS VARCHAR(9)) AS a, 'v' || CAST(CAST(floor(k / 4.0) AS BIGINT) % 4 AS VARCHAR(9)) AS b FROM raw),
ins AS (SELECT m AS method_uid, idx, 2 * idx AS off, mnemonic,
               CASE WHEN mnemonic = 'move' THEN a || ', ' || b WHEN mnemonic = 'const/4' THEN a || ', ' || CAST(k AS VARCHAR(9)) WHEN mnemonic = 'move-result-object' THEN a
                    WHEN mnemonic = 'goto' THEN CAST(2 * ((k * 7 + idx) % n) AS VARCHAR(20)) WHEN mnemonic = 'if-eqz' THEN a || ', ' || CAST(2 * ((k * 7 + idx) % n) AS VARCHAR(20))
                    WHEN mnemonic = 'return-void' THEN '' WHEN t = 'signup' THEN b || ', ' || {_pick(SOURCES)} ELSE a || ', ' || b || ', ' || {_pick(SINKS)} END AS operands,
               2 * n AS code_end FROM num)"""

#: Common table expressions ending in ins(method_uid, idx, off, mnemonic, operands, code_end).
SPARK_CTE = _TEMPLATE.replace("@K", "get_json_object(props, '$.k')")
DUCK_CTE = _TEMPLATE.replace("@K", "json_extract_string(props, '$.k')")


def instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(f"WITH {SPARK_CTE.replace('FROM events', 'FROM {events}')} SELECT * FROM ins", events=events)
