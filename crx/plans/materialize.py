"""Materialise shared intermediates once per session in the shared
checkpoint folder (`spark.checkpoint.dir`), then read them back.

Used for the syntax-node table, which every rule and structure query reads:
parsing happens once, later queries scan parquet with pushdown and pruning.
A lost executor only costs re-reading files, never re-parsing sources."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession

from crx.plans.session import ensure_checkpoint_dir, write_table

_STORED: dict[tuple[str, str], str] = {}


def input_stamp(df: DataFrame) -> str | None:
    """The files a frame reads with their change times and sizes, and its plan: equal
    only while both stay as they are. None if it reads anything but files. The files are
    those Spark listed when the frame was made: one call per scan, none per file."""
    analysed = df._jdf.queryExecution().analyzed()
    leaves = analysed.collectLeaves()
    listed = set()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        kind = leaf.getClass().getSimpleName()
        if kind in ("LogicalRDD", "LocalRelation"):
            return None
        if kind == "LogicalRelation":
            listed.add(leaf.relation().location().allFiles().mkString("\n"))
    if not any(listed):
        return None
    return analysed.canonicalized().toString() + "\n" + hashlib.sha1("\n".join(sorted(listed)).encode()).hexdigest()


def stored(spark: SparkSession, name: str, key: str | None, build) -> DataFrame:
    """Return table `name` for `key`, writing `build()` to parquet on first use
    in this application (the write is the lineage cut: later readers and
    retried tasks read files, not the plan that built them). Without a key the
    table is written anew each time."""
    sk = (spark.sparkContext.applicationId, f"{name}:{key if key is not None else uuid.uuid4().hex}")
    path = _STORED.get(sk)
    if path is None:
        base = ensure_checkpoint_dir(spark).rstrip("/")
        tag = hashlib.sha1(sk[1].encode()).hexdigest()[:12]
        path = f"{base}/tables/{name}-{tag}-{uuid.uuid4().hex[:8]}"
        write_table(build(), path)
        _STORED[sk] = path
    return spark.read.parquet(path)
