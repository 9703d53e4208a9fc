"""Workers have no copy of the package: what they need travels with the functions."""

import os
import subprocess
import sys
import textwrap

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run_away(tmp_path, body, shared=True):
    """Runs body in a process that alone has the repository on its path, with a session `spark` in another folder; without a
    shared folder if so asked."""
    folder = f'.config("spark.checkpoint.dir", {str(tmp_path / "shared")!r})' if shared else ""
    start = f"""
        import sys, tempfile
        sys.path.insert(0, {ROOT!r})
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
                 {folder}.getOrCreate())
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    if not shared:  # nor one from the settings of this machine
        (tmp_path / "conf").mkdir()
        env["SPARK_CONF_DIR"] = str(tmp_path / "conf")
    found = subprocess.run([sys.executable, "-c", textwrap.dedent(start) + textwrap.dedent(body)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert found.returncode == 0, found.stderr[-3000:]
