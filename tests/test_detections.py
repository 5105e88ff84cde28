"""Images of the derived detections stay small as the table grows."""

from labelaudit.plans import queries


def test_images_grow_with_the_table(spark, tmp_path):
    rows = [(k, [0.1] * 16) for k in range(6000)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    sizes = [r["count"] for r in queries.detections(spark, str(tmp_path)).groupBy("image_id").count().collect()]
    assert len(sizes) == 120 and max(sizes) == 50
