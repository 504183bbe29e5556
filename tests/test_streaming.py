"""Files are landed once, however often the stream is started."""

from goldvein.streaming.incremental import land_files


def test_each_file_once(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    run = lambda: land_files(spark, str(folder), "id string, n string", f"{tmp_path}/log", lambda df, _: seen.extend(r.id for r in df.collect())).awaitTermination()
    (folder / "a.csv").write_text("id,n\n1,x\n2,y\n")
    run()
    (folder / "b.csv").write_text("id,n\n3,z\n")
    run()
    run()
    assert sorted(seen) == ["1", "2", "3"]
