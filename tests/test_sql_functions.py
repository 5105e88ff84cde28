"""SQL functions give what the column functions give."""

from pyspark.sql import functions as F

from labelaudit.functions import sql
from labelaudit.functions import text as T

TEXTS = ["Net Quantity: 1,200 gms", "MRP ₹ 14.00", "Unit Sale Price Rs 0.20 / g", "Tel 1800-123-4567, care@tasty.in", "  6\t pcs ", "nothing", "", None]


def test_same_as_columns(spark):
    assert len(sql.register(spark)) == len(sql.definitions())
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").withColumn("n", T.squash(F.col("t")))
    n = F.col("n")
    pairs = {
        "label_quantity": T.quantity(n)["value"], "label_quantity_unit": T.quantity(n)["raw_unit"], "label_money": T.money(n), "label_unit_price": T.unit_price(n)["value"],
        "label_prohibited_unit": T.first_prohibited(n), "label_phone": T.phone(n), "label_email": T.email(n),
    }
    for r in df.selectExpr("n", "label_text(t) AS m").collect():
        assert r["n"] == r["m"]
    for name, column in pairs.items():
        rows = df.select(F.expr(f"{name}(n)").alias("a"), column.alias("b")).collect()
        assert [r["a"] for r in rows] == [r["b"] for r in rows], name
        plan = df.select(F.expr(f"{name}(n)"))._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan
