import json

from pricebridge.streaming.follow import follow_products


def test_new_documents_only(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    row = {"productId": 1, "drugCode": 2, "genericName": "Aspirin Tablets 75 mg", "unitSize": "10's", "mrp": 3.5, "status": 1}
    args = (spark, str(folder), str(tmp_path / "out"), str(tmp_path / "at"), "now")
    (folder / "a.json").write_text(json.dumps([row, {**row, "status": 0}]))
    follow_products(*args).awaitTermination()
    (folder / "b.json").write_text(json.dumps({"responseBody": {"newProductResponsesList": [{**row, "productId": 7}]}}))
    follow_products(*args).awaitTermination()
    kept = spark.read.parquet(str(tmp_path / "out" / "products"))
    assert sorted((r["product_id"], r["batch"]) for r in kept.collect()) == [(1, 0), (7, 1)]
    assert [r["reason"] for r in spark.read.parquet(str(tmp_path / "out" / "rejects")).collect()] == ["inactive_product"]
