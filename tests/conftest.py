import atexit
import os
import shutil
import sys
import tempfile
from pathlib import Path

import pyspark
import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Executors of a local cluster work in a folder in Spark's home; where that can't be written, a home of links can.
HOME = Path(pyspark.__file__).parent
if "SPARK_HOME" not in os.environ and not os.access(HOME / "work" if (HOME / "work").exists() else HOME, os.W_OK):
    os.environ |= {"SPARK_HOME": tempfile.mkdtemp(prefix="spark-home-"), "SPARK_SCALA_VERSION": "2.13"}
    atexit.register(shutil.rmtree, os.environ["SPARK_HOME"], True)
    for part in HOME.iterdir():
        if part.name != "work":
            Path(os.environ["SPARK_HOME"], part.name).symlink_to(part)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tarnwick.session import session

    s = session("local[8]", 8, {"spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")), "spark.ui.enabled": "false", "spark.driver.memory": "6g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.01"
