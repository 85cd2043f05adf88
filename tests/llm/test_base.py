"""Shared helpers."""

import glob
import os
import tempfile
import time

from cardwatch.llm import base


def shuffle_files(lm):
    folder = lm.sparkContext.getConf().get("spark.local.dir", os.environ.get("SPARK_LOCAL_DIRS", tempfile.gettempdir()))
    found = [f for one in folder.split(",") for f in glob.glob(f"{one}/**/blockmgr-*/*/shuffle_*.data", recursive=True)]
    return {f for f in found if os.path.getsize(f)}


def test_a_stash_leaves_no_shuffle_files(lm):
    before = shuffle_files(lm)
    kept = base.stash(lm.range(50_000).selectExpr("id % 40000 as k", "id as v").groupBy("k").max("v"), "grouped")
    until = time.monotonic() + 5
    while (left := shuffle_files(lm) - before) and time.monotonic() < until:
        time.sleep(0.1)
    assert not left
    assert lm.conf.get(base.CLEANUP, None) is None
    assert kept.selectExpr("count(*)", "sum(`max(v)`)").first() == (40_000, sum(range(10_000, 50_000)))
