from chronoloom.plans import catalog


def test_written_months_and_fiscal_years_come_out(spark, tmp_path):
    rows = [("a", "Signed March 11, 2026, shipped 2026-04, budget of FY26"), ("b", "on 2026-04-02")]
    df = spark.createDataFrame(rows, "id string, content string").selectExpr("*", "timestamp'2026-05-01' AS recorded_at")
    df.write.parquet(f"{tmp_path}/episodes.parquet")
    got = catalog.QUERIES["dates_in_episodes"](spark, str(tmp_path)).collect()
    assert {(r.id, r.label) for r in got} == {("a", "March 11, 2026"), ("a", "2026-04"), ("a", "FY26"), ("b", "2026-04-02")}
    assert all(r.n == 1 and r.start_day for r in got)
