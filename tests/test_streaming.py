"""Instructions that arrive as files."""

from bytelens.streaming import scans


def test_scan_of_arrivals(spark, tmp_path):
    kind = "method_uid long, off long, mnemonic string, operands string, arrived timestamp"
    rows = [(1, 0, "invoke-virtual", "v0, v1, android.webkit.WebView.addJavascriptInterface(a)"), (1, 0, "invoke-virtual", "v0, v1, android.webkit.WebView.addJavascriptInterface(a)"), (2, 4, "invoke-direct", "v0, dalvik.system.DexClassLoader.<init>()"), (2, 8, "move", "v0, v1")]
    spark.sql("SELECT 1").collect()
    t = spark.createDataFrame(rows, "method_uid long, off long, mnemonic string, operands string").selectExpr("*", "timestamp'2024-01-01 00:00:00' AS arrived")
    t.coalesce(1).write.parquet(f"{tmp_path}/in")
    found = scans.invoke_findings(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"))
    for _ in range(2):  # a second run finds nothing new
        scans.write_findings(found, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r.category, r.method_uid, r.sink_off) for r in got) == [("rce_dynamic_loading", 2, 4), ("webview_javascript_interface", 1, 0)]
