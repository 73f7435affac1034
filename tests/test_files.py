from lodestone.sources import files


def test_metadata_by_base_name_and_blank_values(spark):
    rows = spark.createDataFrame([("a.txt",), ("dir/b.txt",), ("c.txt",)], "document_name string")
    metadata = spark.createDataFrame([("/in/a.txt", "Ann", 3), ("b.txt", " ", 4)], "filename string, author string, pages long")
    got = {r["document_name"]: (r["author"], r["pages"]) for r in files.with_metadata(rows, metadata).collect()}
    assert got == {"a.txt": ("Ann", 3), "dir/b.txt": (None, 4), "c.txt": (None, None)}


def test_batches_in_the_order_of_paths(spark):
    paths = [f"/in/{i:03d}.txt" for i in range(50)]
    rows = spark.createDataFrame([(p,) for p in reversed(paths)], "path string").repartition(7)
    got = {r["path"]: r["batch_no"] for r in files.batches(rows, 16).collect()}
    assert got == {p: i // 16 for i, p in enumerate(paths)}
    assert files.batches(rows.limit(0), 16).count() == 0
