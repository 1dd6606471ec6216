from texelarium.sources import containers as C
from texelarium.streaming import stream_surfaces


def test_files_become_surfaces(spark, tmp_path):
    t = C.Texture("R8_UNORM", 4, 4, [[bytes(16), bytes(4), bytes(1)]])
    (tmp_path / "a.ktx2").write_bytes(C.write_ktx2(t))
    (tmp_path / "b.dds").write_bytes(C.write_dds(t))
    q = stream_surfaces(spark, str(tmp_path)).writeStream.format("memory").queryName("surfaces").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("surfaces").count() == 6
