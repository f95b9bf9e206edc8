from pathlib import Path
from types import SimpleNamespace

import pytest

from corpusloom import workspace


def test_a_path_without_a_scheme_is_on_the_default_file_system(spark, tmp_path, monkeypatch):
    conf = spark._jsc.hadoopConfiguration()
    default = conf.get("fs.defaultFS")
    (tmp_path / "box").mkdir()
    named = lambda path: monkeypatch.setattr(workspace, "_configured", lambda s: path)
    try:
        named(f"file://{tmp_path}/local/")
        assert workspace.shared_dir(spark) == f"file://{tmp_path}/local"
        named(f"{tmp_path}/plain")
        assert workspace.shared_dir(spark) == f"file://{tmp_path}/plain"
        conf.set("fs.viewfs.mounttable.box.link./data", f"file://{tmp_path}/box")
        conf.set("fs.defaultFS", "viewfs://box/")
        named("/data/ck")
        assert workspace.shared_dir(spark) == "viewfs://box/data/ck"
        assert workspace.materialise(spark.range(5), "t").count() == 5 and any((tmp_path / "box").rglob("*.parquet"))
    finally:
        conf.set("fs.defaultFS", default)


def test_tables_are_dropped_and_shuffle_files_follow_the_write(spark):
    before = spark.conf.get(workspace._CLEANUP)
    with workspace.made() as paths:
        df, path = workspace.written(spark.range(100).repartition(3, "id"), "t")
    assert paths == [path] and df.count() == 100 and spark.conf.get(workspace._CLEANUP) == before
    folder = Path(path.removeprefix("file://"))
    assert folder.exists()
    workspace.drop(spark, path, path)
    assert not folder.parent.exists()


def test_a_cluster_needs_a_shared_folder():
    none = SimpleNamespace(get=lambda *a: None)
    cluster = SimpleNamespace(conf=none, sparkContext=SimpleNamespace(getConf=lambda: none, master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        workspace.shared_dir(cluster)
