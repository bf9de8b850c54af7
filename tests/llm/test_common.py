import os
import re
import threading

import pytest

from gondola.llm import common


def files(spark):
    return set(os.listdir(common.shared_dir(spark).removeprefix("file://")))


def test_scratch_of_two_threads_is_apart(spark):
    begun, ended, kept = threading.Event(), threading.Event(), {}

    def outer():
        with common.scratch(spark):
            kept["df"] = common.saved(spark.range(5), "outer")
            begun.set()
            ended.wait(60)
            kept["n"] = kept["df"].count()

    t = threading.Thread(target=outer)
    t.start()
    begun.wait(60)
    with common.scratch(spark):
        common.saved(spark.range(3), "inner")
    ended.set()
    t.join()
    assert kept["n"] == 5


def test_scratch_goes_and_kept_tables_stay_until_released(spark):
    before = files(spark)
    with common.scratch(spark):
        common.saved(spark.range(3), "gone")
        stays = common.saved(spark.range(4), "stays", keep=True)
    assert len(files(spark) - before) == 1 and stays.count() == 4
    common.release(spark)
    assert not files(spark) - before


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(RuntimeError, match=re.escape("spark.checkpoint.dir")):
        common.shared_dir(Session)
