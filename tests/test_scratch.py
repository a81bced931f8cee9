"""Scratch tables on a session that names no shared folder, as a process of its own with no configuration folder."""

import os
import subprocess
import sys

CODE = """
import os
from pyspark.sql import SparkSession
from emberlattice.scratch import OWN, Scratch, shared_folder, written
from emberlattice.plans.queries import QUERIES

spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.session.timeZone", "UTC").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
assert spark.conf.get("spark.checkpoint.dir", None) is None
folder = shared_folder(spark)
assert folder == shared_folder(spark) and os.path.isdir(folder.removeprefix("file://"))
assert sorted(r.id for r in written(spark.range(5), "five").collect()) == [0, 1, 2, 3, 4]
job = Scratch(spark, "job")
job.keep(spark.range(3), "first")
job.drop("first")
assert not os.path.exists(f"{job.folder}/first".removeprefix("file://"))
assert QUERIES["win_1_temperature_rank"](spark, "/root/testdata/sf0.001").count() > 0
print("KEPT", folder)
"""


def test_a_session_without_a_shared_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("SPARK_HOME", "PYSPARK_SUBMIT_ARGS")} | {"SPARK_CONF_DIR": str(tmp_path)}
    said = subprocess.run([sys.executable, "-c", CODE], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=240)
    assert said.returncode == 0, said.stderr[-2000:]
    folder = next(x for x in said.stdout.splitlines() if x.startswith("KEPT")).split("file://")[1]
    assert not os.path.exists(folder)
