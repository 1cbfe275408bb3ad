"""The entry point with and without the training-data subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_subpackage(tmp_path, pipeline):
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *[] if pipeline else ["corpus_pipeline.py"]))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q); print(sorted(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env=env, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    assert "check_rules_union" in said.stdout and "op1_" not in said.stdout and "'pipeline'" not in said.stdout


def test_checkpoints_need_a_shared_folder_off_the_driver(spark):
    from waterlens.session import shared_dir

    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")

    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: "spark://far:7077" if key == "spark.master" else default)

        class sparkContext:  # noqa: N801
            getCheckpointDir = staticmethod(lambda: Cluster.folder)

        folder = "hdfs://shared/work/"

    assert shared_dir(Cluster) == "hdfs://shared/work"  # set on the context alone
    Cluster.folder = None
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Cluster)
