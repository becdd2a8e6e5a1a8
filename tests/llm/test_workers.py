"""Every query of the subpackage runs on workers that have no copy of the package."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[2]
RUN = """
import sys
sys.path.insert(0, {repo!r})  # the driver's path only
from pyspark.sql import SparkSession, functions as F
spark = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "3g")
         .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", {folder!r}).config("spark.ui.showConsoleProgress", "false").getOrCreate())
spark.sparkContext.setLogLevel("OFF")

@F.udf("string")
def seen(_):
    import importlib.util
    return str(importlib.util.find_spec("loomtrace"))

assert spark.range(1).select(seen("id")).first()[0] == "None", "workers see the package"
import __spark_entry__
for name, query in __spark_entry__.queries().items():
    if name.startswith("op") or name == "pipeline":
        query(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
        print("ran", name, flush=True)
"""


def test_workers_need_no_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    script = tmp_path / "run.py"
    script.write_text(RUN.format(repo=str(REPO), folder=str(tmp_path / "shared")))
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    assert done.returncode == 0, done.stderr[-3000:]
    ran = [line.split()[1] for line in done.stdout.splitlines() if line.startswith("ran ")]
    assert len(ran) == 14 and "pipeline" in ran
