"""The entry point without the training-data folders, shipped code, and stored
tables that follow their input files."""

import os
import shutil
import subprocess
import sys

from crx.operators.code import dispatch as DS
from crx.operators.code import nodes as N

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _run(code, cwd, path):
    env = {**os.environ, "PYTHONPATH": path}
    return subprocess.run([sys.executable, "-c", code], cwd=cwd, env=env, capture_output=True, text=True, timeout=280)


def test_entry_without_training_data_folders(tmp_path):
    shutil.copytree(f"{REPO}/crx", tmp_path / "crx", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{REPO}/__spark_entry__.py", tmp_path)
    done = _run("import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') for k in q), set(e.oracle_sql()) <= set(q))",
                tmp_path, str(tmp_path))
    assert done.stdout.split()[1:] == ["False", "True"], done.stderr[-500:]


def test_entry_with_broken_training_data_folder(tmp_path):
    """A folder that is there but can't be imported takes no other query along."""
    shutil.copytree(f"{REPO}/crx", tmp_path / "crx", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "crx" / "llm").mkdir()
    (tmp_path / "crx" / "llm" / "__init__.py").write_text("")
    (tmp_path / "crx" / "llm" / "queries.py").write_text("import no_such_module_here")
    (tmp_path / "corpus_pipeline.py").write_text("raise RuntimeError('broken')")
    shutil.copy(f"{REPO}/__spark_entry__.py", tmp_path)
    done = _run("import __spark_entry__ as e; q = e.queries(); print(len(q) > 100, any(k.startswith('op') or k == 'pipeline' for k in q))", tmp_path, str(tmp_path))
    assert done.stdout.split() == ["True", "False"] and "no_such_module_here" in done.stderr, done.stderr[-500:]


def test_stamp_follows_files_without_a_call_for_each(spark, tmp_path):
    from crx.plans.materialize import input_stamp
    path = f"{tmp_path}/t"
    spark.range(50).repartition(20).write.parquet(path)

    def frame():
        return spark.read.parquet(path).filter("id > 3")
    first = input_stamp(frame())
    assert first == input_stamp(frame()) and first is not None
    assert input_stamp(spark.read.parquet(path).filter("id > 4")) != first
    assert input_stamp(frame().union(spark.createDataFrame([(1,)], "id long"))) is None and input_stamp(spark.range(3).toDF("id")) is None
    spark.range(1).write.mode("append").parquet(path)
    assert input_stamp(frame()) != first


def test_code_reaches_workers_from_another_folder(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as e
sys.path.remove({REPO!r})
print("ROWS", e.queries()["parse_status"](spark, "/root/testdata/sf0.001").count() > 0)
"""
    done = _run(code, tmp_path, "")
    assert "ROWS True" in done.stdout, done.stderr[-800:]


def test_rewritten_sources_give_new_findings(spark, tmp_path):
    def findings(text):
        rows = [(1, "a.py", text)]
        spark.createDataFrame(rows, "file_id long, path string, content string").write.mode("overwrite").parquet(f"{tmp_path}/src")
        reg = {"python": DS.REGISTRY["python"]}
        return DS.analyzer_dispatch(spark.read.parquet(f"{tmp_path}/src"), reg).count()
    assert findings("eval(x)\n") == 1
    assert findings("print(x)\n") == 0
    assert findings("eval(x)\neval(y)\n") == 2


def test_hard_files_fail_alone(spark):
    rows = [(1, "deep.py", "+".join(["a"] * 20_000)), (2, "minus.py", "x = " + "-" * 100_000 + "1"), (3, "odd.py", 's = "\\ud800"\nt = "ok"\n'),
            (4, "good.py", "eval(x)\n"), (5, "bad.py", "def (:\n"), (6, "null.py", None)]
    df = spark.createDataFrame(rows, "file_id long, path string, content string")
    status = {r.file_id: r for r in N.parse_status(df).collect()}
    assert not status[1].success or status[1].error_message is None
    assert [status[i].success for i in (2, 3, 4, 5, 6)] == [False, True, True, False, True]
    values = [r.str_value for r in N.code_nodes(df).filter("file_id = 3 AND kind = 'Constant'").collect()]
    assert values == ["?", "ok"]


def test_cluster_settings_bound_the_parts_of_a_shuffle(spark):
    """24 MB of rows that don't compress come in parts of at most some 8 MB."""
    from crx.plans.session import CLUSTER_SETTINGS
    given = {k: CLUSTER_SETTINGS[k] for k in ("spark.sql.adaptive.enabled", "spark.sql.adaptive.advisoryPartitionSizeInBytes")} | {
        "spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k, None) for k in given}
    for k, v in given.items():
        spark.conf.set(k, v)
    try:
        dealt = spark.range(3_000_000).selectExpr("xxhash64(id) AS h", "id % 7 AS g").repartition("h")
        parts = dealt.groupBy("h").count().rdd.getNumPartitions()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert 3 <= parts <= 16


def test_shuffle_files_of_an_intermediate_go_when_it_is_written(spark):
    """A job of several steps doesn't hold the shuffles of all of them on disk; the session's
    own setting stays, and the table can be read and written from again."""
    import time

    from crx.llm.common import shared_table
    from crx.plans.session import SHUFFLE_CLEANUP
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled() -> set[str]:
        blocks = disk.getAllBlocks()
        return {b for b in (blocks.apply(i).name() for i in range(blocks.size())) if b.startswith("shuffle_")}
    before, setting = shuffled(), spark.conf.get(SHUFFLE_CLEANUP, None)
    rows = spark.range(1_000).selectExpr("id % 100 AS k", "id").repartition("k")  # held: nothing of it is garbage
    table = shared_table(rows.groupBy("k").sum("id"), "cleanup-test")
    for _ in range(50):
        if not (left := shuffled() - before):
            break
        time.sleep(0.2)
    assert not left and spark.conf.get(SHUFFLE_CLEANUP, None) == setting
    assert table.count() == 100 and shared_table(rows.groupBy("k").count(), "cleanup-test").filter("count = 10").count() == 100
