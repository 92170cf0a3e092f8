"""Project documents: versions, broken files, casts and precedence."""

from tessera.sources import project

DOCS = [
    ("a", '{"version": 1, "global": {"brightness": "200", "time_range": {"start": "0:10", "end": null}}, "files": {"x.mkv": {"crop": {"x": "1.9", "y": "2", "width": "30", "height": "bad"}, "skipped": "True"}, "y.mp4": {"brightness": "180", "time_ranges": []}}}'),
    ("b", '{"version": 9, "files": {}}'),
    ("c", "{broken"),
    ("d", "{}"),
]


def test_status_and_rows(spark):
    docs = project.parsed(spark.createDataFrame(DOCS, "path string, value string"))
    assert {r.path: r.status for r in docs.collect()} == {"a": "ok", "b": "unknown", "c": "corrupt", "d": "ok"}
    rows = {r.name: r for r in project.file_rows(docs).collect()}
    x, y = rows["x.mkv"], rows["y.mp4"]
    assert (x.crop.x, x.crop.height, x.brightness, x.skipped, x.width, x.review) == (1, None, 200, True, 0, "pending")
    assert x.time_ranges[0].start == "0:10" and y.time_ranges == [] and y.crop is None and y.brightness == 180


def test_files(spark, tmp_path):
    (tmp_path / "p.json").write_text(DOCS[0][1])
    docs = project.read(spark, str(tmp_path))
    project.write(project.file_rows(docs), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    paths = spark.createDataFrame([("a/B.MKV",), ("c.mp4",), ("d.txt",)], "path string")
    assert project.videos(paths).count() == 2
