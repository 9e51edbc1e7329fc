import pytest
from pyspark.sql import functions as F

from checks.registered import apart
from tests.helpers import lake_of, one, sale, star_of, values
from tillstream.functions.columns import price_band, rfm_segment
from tillstream.operators import lookup, star
from tillstream.operators.checks import _repeated, check_constraints
from tillstream.operators.keys import dense_key, place_rows
from tillstream.operators.lookup import lookup_key
from tillstream.session import new_folder


@pytest.mark.parametrize("price, band", [(1.99, "LOW"), (2.0, "MID"), (9.99, "MID"), (10.0, "HIGH")])
def test_price_band_edges(spark, price, band):
    assert spark.range(1).select(price_band(F.lit(price))).first()[0] == band


@pytest.mark.parametrize("score, segment", [(0.3299, "LOW"), (0.33, "MID"), (0.66, "HIGH")])
def test_segment_edges(spark, score, segment):
    assert spark.range(1).select(rfm_segment(F.lit(score))).first()[0] == segment


def test_constant_measures_count_one_half(spark):
    rows = [sale("1", customer="a"), sale("2", customer="b")]
    scores = star.customer_scores(lake_of(spark, rows))
    assert values(scores, "rfm_score") == [(0.5,), (0.5,)]


def test_missing_ids_are_one_guest(spark):
    rows = [sale("1", customer=""), sale("2", customer=None), sale("3", customer="nan"), sale("4")]
    made = star_of(spark, rows)
    guest = made.dim_customer.where("customer_id = 'GUEST'").first()
    assert guest["customer_key"] == 2 and guest["first_seen"] is None
    assert guest["country"] == "Unknown" and guest["customer_segment"] == "LOW"
    assert made.fact_sales.where(f"customer_key = {guest['customer_key']}").count() == 3
    assert made.dim_customer.count() == 2


def test_guest_row_without_guests(spark):
    assert one(star_of(spark, [sale()]).dim_customer, "customer_id = 'GUEST'", "customer_key") == 2


def test_latest_sale_describes_the_product(spark):
    rows = [
        sale("2", description="new", price=12.0, when="2020-03-01 00:00:00"),
        sale("1", description="old", price=1.0, when="2020-01-01 00:00:00"),
    ]
    product = star_of(spark, rows).dim_product.first()
    assert (product["description"], product["price_band"]) == ("new", "HIGH")


def test_latest_sale_among_several_at_one_time(spark):
    """Equal times are settled by invoice, then description; a country counts only where there is one."""
    rows = [
        sale("5", description="cup", customer="a", country="Spain"), sale("7", description="mug", customer="a", country="Italy"),
        sale("7", description="bowl", customer="a", country="Italy"),
        sale("9", customer="a", country=None, code="B", when="2021-01-01 00:00:00"), sale("8", customer="b", country=None),
    ]
    made = star_of(spark, rows)
    assert one(made.dim_product, "stock_code = 'A'", "description") == "thing"  # invoice 8 is the largest
    assert {c: k for c, k in values(made.dim_customer, "customer_id", "country")} == {"a": "Italy", "b": None, "GUEST": "Unknown"}
    scores = {r["customer_id"]: r for r in star.customer_scores(lake_of(spark, rows)).collect()}
    assert (scores["a"]["frequency"], scores["a"]["monetary"], scores["a"][star.WEIGHT]) == (3, 20.0, 4)


def test_no_dimension_sorts_the_sales(spark):
    """Sort aggregates see the rows of the newest times only, behind the join; those over the sales hash."""
    sales = lake_of(spark, [sale("1"), sale("2", code="B", customer=None)])
    newest = sales.groupBy("StockCode").agg(F.max("InvoiceDate").alias("newest"))
    for rows in (newest, star._customer_measures(sales)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        for number, line in enumerate(plan.splitlines()):
            below = plan.splitlines()[number + 1 :]
            if "SortAggregate" in line:
                assert any("Join" in other for other in below)
        assert "HashAggregate" in plan and "ObjectHashAggregate" not in plan


def test_null_country_keeps_the_sale(spark):
    made = star_of(spark, [sale("1", country=None), sale("2", country="Japan")])
    assert sorted(values(made.fact_sales, "invoice", "geo_key")) == [("1", None), ("2", 1)]
    assert values(made.dim_geography, "country", "region") == [("Japan", "Asia-Pacific")]


def test_unknown_country_is_other(spark):
    assert values(star_of(spark, [sale(country="Atlantis")]).dim_geography, "region") == [("Other",)]


def test_daily_aggregate_counts_invoices(spark):
    rows = [sale("1", quantity=2), sale("1", quantity=3), sale("2"), sale("2", code="B")]
    daily = star_of(spark, rows).agg_daily_sales
    assert sorted(values(daily, "product_key", "total_quantity", "total_revenue", "num_orders")) == [
        (1, 6, 30.0, 2), (2, 1, 5.0, 1),
    ]


def test_constraints_hold_and_find_violations(spark):
    made = star_of(spark, [sale("1"), sale("2", code="B", country="Spain")])
    assert {r["violations"] for r in check_constraints(made).collect()} == {0}
    broken = star.Star(**{
        **made.tables(),
        "dim_product": made.dim_product.where("stock_code = 'A'").unionByName(
            made.dim_product.where("stock_code = 'A'")
        ),
    })
    found = {(r["table_name"], r["rule"], r["columns"]): r["violations"]
             for r in check_constraints(broken).collect()}
    assert found["dim_product", "unique", "stock_code"] == 1
    assert found["fact_sales", "reference", "product_key"] == 1


def test_sales_without_date_or_product_are_found(spark):
    made = star_of(spark, [sale("1"), sale("2", code="B"), sale("3")])
    first, last = F.col("sale_id") == 1, F.col("sale_id") > 1
    fact = made.fact_sales.withColumns({
        "date_key": F.when(~first, F.col("date_key")), "product_key": F.when(~last, F.col("product_key")),
    })
    found = {(r["table_name"], r["rule"], r["columns"]): r["violations"]
             for r in check_constraints(star.Star(**{**made.tables(), "fact_sales": fact})).collect()}
    assert found["fact_sales", "not_null", "date_key"] == 1 and found["fact_sales", "not_null", "product_key"] == 2


@pytest.mark.parametrize("planted", [[], [5], [5, 5, 64, 127, 128], [-1, -64, -65, -65], [None], [None, None, 2**62, 2**62]])
def test_repeated_numbers_inside_and_across_files(spark, planted):
    """Doubles beside their first and in another file, negative and very large numbers, missing ones."""
    path = new_folder(spark, "numbers")
    spark.range(1000).repartitionByRange(4, "id").write.parquet(path)
    spark.createDataFrame([(v,) for v in planted], "id long").coalesce(1).write.mode("append").parquet(path)
    rows = spark.read.parquet(path)
    ids = [*range(1000), *planted]
    assert _repeated("t", rows, ["id"]).first()["violations"] == len(ids) - len(set(ids))
    plain = rows.select(F.col("id").cast("string").alias("id"))
    assert _repeated("t", plain, ["id"]).first()["violations"] == len(ids) - len(set(ids))


def test_unique_numbers_are_handed_on_by_words(spark):
    """A 64th of the rows leaves the tasks where numbers lie together."""
    path = new_folder(spark, "numbers")
    spark.range(64_000).repartitionByRange(4, "id").write.parquet(path)
    words = spark.read.parquet(path).select(F.spark_partition_id().alias("task"), F.shiftright("id", 6).alias("word"))
    assert words.distinct().count() <= 1000 + 8
    plan = _repeated("t", spark.read.parquet(path), ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortAggregate" not in plan


def test_dense_key_over_many_equal_rows(spark):
    """A third of the rows are copies of one; they spread over the tasks and get all numbers."""
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(F.col("id").cast("string")).alias("v"),
        "id",
    )
    numbered = dense_key(rows.repartition(8), ["v", "id"], "n")
    ordered = [r["v"] for r in numbered.orderBy("n").collect()]
    assert ordered == sorted(ordered)
    summary = numbered.agg(F.min("n"), F.max("n"), F.count_distinct("n")).first()
    assert tuple(summary) == (1, 30_000, 30_000)

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = place_rows(rows.repartition(8), ["v", "id"], "n").where("v = 'same'")
        sizes = [r["count"] for r in placed.groupBy("_part").count().collect()]
        assert len(sizes) > 1 and max(sizes) < 10_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_dense_key_of_nothing(spark):
    assert dense_key(spark.range(0).toDF("a"), ["a"], "n").collect() == []


def test_lookup_with_hot_and_missing_keys(spark):
    rows = spark.range(3000).select(
        "id",
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, None)
        .otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("code"),
    )
    dim = rows.where("code IS NOT NULL").groupBy("code").agg(F.count("*").alias("n"))
    dim = dense_key(dim, ["code"], "key").where("code <> 'k2'")
    got = lookup_key(rows, dim, "code", "key", "n", rows.count())
    want = rows.join(dim.select("code", "key"), "code", "left")
    assert got.count() == 3000 and got.columns == ["id", "code", "key"]
    assert got.exceptAll(want.select("id", "code", "key")).isEmpty()


def test_hot_key_rows_leave_the_shuffle_balanced(spark):
    """Beyond the broadcast limit the rows of a hot key do not meet in one task."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(80_000).select(
            F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("code"),
            "id",
        )
        dim = rows.groupBy("code").agg(F.count("*").alias("n"), F.min("id").alias("key"))
        got = lookup_key(rows, dim, "code", "key", "n", rows.count())
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 80_000 and max(sizes) < 2 * min(sizes)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_newest_country_is_found_among_invoices_not_in_the_lake(spark):
    """The newest known country, of the largest invoice at that time, without a second read of the sales."""
    rows = [sale("1", when="2020-01-02 10:00:00", country="Spain"), sale("1", when="2020-01-02 10:00:00", country="Italy"),
            sale("2", when="2020-01-02 10:00:00", country="France"), sale("2", when="2020-01-01 09:00:00", country="Spain"),
            sale("3", when="2020-01-03 10:00:00", country=None)]
    found = star._customer_measures(lake_of(spark, rows))
    row = found.first()
    assert (row["country"], row["frequency"], row["_rows"], found.count()) == ("France", 3, 5, 1)
    assert all("test-lake" not in name for name in found.inputFiles())


def test_columns_that_serve_the_order_only_are_not_stored(spark):
    rows = spark.range(50).select((F.col("id") % 7).alias("v"), "id", F.lit("x").alias("kept"))
    numbered = dense_key(rows, ["v", "id"], "n", ["id"], 4)
    assert numbered.columns == ["n", "v", "kept"] and numbered.count() == 50
    want = sorted((i % 7, i) for i in range(50))
    assert [r["v"] for r in numbered.orderBy("n").collect()] == [v for v, _ in want]
    placed = place_rows(rows, ["v", "id"], "n", ["id"], 4)
    assert placed.select("_part").distinct().count() == placed.select(F.spark_partition_id()).distinct().count() == 4


def test_small_dimensions_are_broadcast_and_large_ones_joined_alike(spark, monkeypatch):
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("c", 4), ("a", 5)], "code string, id long")
    dim = spark.createDataFrame([("a", 10, 2), ("b", 20, 1), ("b", 21, 1)], "code string, key long, n long")
    want = [("a", 1, 10), ("a", 5, 10), ("b", 2, 20), ("b", 2, 21), ("c", 4, None), (None, 3, None)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        whole = lookup_key(rows, dim, "code", "key", "n", 5)
        assert "Exchange hashpartitioning" not in whole._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(lookup, "MOST_BROADCAST", 0)
        for got in (whole, lookup_key(rows, dim, "code", "key", "n", 5)):
            assert sorted(values(got, "code", "id", "key"), key=str) == sorted(want, key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")


def test_large_lookup_leaves_the_hot_rows_spread(spark, monkeypatch):
    """The fact is the same with dimensions beyond the broadcast limit, and lies by its numbers."""
    rows = [sale(str(i), code=f"P{i % 3}", when=f"2020-0{1 + i // 9}-01 10:00:0{i % 9}", customer=[None, "7", "8"][i % 3])
            for i in range(27)]
    first = star_of(spark, rows).fact_sales
    monkeypatch.setattr(lookup, "MOST_BROADCAST", 0)
    second = star_of(spark, rows).fact_sales
    assert first.count() == 27 and first.exceptAll(second).isEmpty()
    in_order = first.orderBy("invoice_date", "invoice")
    assert [r["sale_id"] for r in in_order.collect()] == list(range(1, 28))
    assert values(in_order.limit(3), "product_key", "customer_key") == [(1, 3), (2, 1), (3, 2)]


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_daily_figures_are_dealt_once(spark, monkeypatch, most):
    """One shuffle of the sales where no day is large; large days and months give the same figures."""
    rows = [sale(str(i % 7), code="ABC"[i % 3], when=f"2020-0{1 + i % 2}-{1 + i % 5:02} 10:00:00", price=1 + i / 4) for i in range(40)]
    fact = star_of(spark, rows).fact_sales
    monkeypatch.setattr(star, "MOST_OF_DAY", most)
    got = star.build_agg_daily_by_month(fact)
    want = star.with_sale_month(star.build_agg_daily(fact))
    assert want.count() > 20 and got.select(want.columns).exceptAll(want).isEmpty() and want.exceptAll(got.select(want.columns)).isEmpty()
    if most == 1000:
        assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_rows_apart_are_counted(spark):
    """Rows without a counterpart on the other side, nulls and repeats included."""
    left = [(1, "a"), (None, "a"), (2, None), (2, "b"), (2, "b"), (3, "c")]
    right = [(1, "a"), (1, None), (2, None), (2, "b"), (4, "c")]
    made = [spark.createDataFrame(rows, "n int, s string").withColumn("side", F.lit(side)) for rows, side in ((left, 1), (right, -1))]
    got = apart(made[0].unionByName(made[1]), ["n", "s"]).first()
    assert (got["num_rows"], got["differing"]) == (6, 5)
    same = apart(made[0].unionByName(made[0].withColumn("side", F.lit(-1))), ["n", "s"])
    assert (same.first()["num_rows"], same.first()["differing"]) == (6, 0)
