from types import SimpleNamespace

from ledgerloom.llm import common


def session(master, **conf):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d)), sparkContext=SimpleNamespace(master=master))


def test_scratch_is_shared_on_clusters():
    warehouse = {"spark.sql.warehouse.dir": "hdfs://x/w/"}
    assert common.scratch_folder(session("yarn", **{"spark.checkpoint.dir": "hdfs://x/c/"})) == "hdfs://x/c"
    for master in ("yarn", "spark://h:7077", "local-cluster[3,2,1024]", "k8s://h"):
        assert common.scratch_folder(session(master, **warehouse)) == "hdfs://x/w/.ledgerloom"
    for master in ("local", "local[8]", "local[*]"):
        assert "ledgerloom-" in common.scratch_folder(session(master, **warehouse))
