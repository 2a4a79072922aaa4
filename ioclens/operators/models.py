"""Fitted-model store (A24): a pipeline is fitted once per (data, name),
saved under the shared checkpoint folder with ``PipelineModel.save`` and
loaded by every scoring job that needs it (the serving pattern: train once,
score many)."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import SparkSession

from ..session import checkpoint_dir

_PATHS: dict[tuple, str] = {}


def key_name(key: tuple) -> str:
    """A folder name for a key, the same in every process."""
    return hashlib.sha256(repr(key).encode()).hexdigest()[:16]


def fitted(spark: SparkSession, key: tuple, fit: Callable[[], PipelineModel]) -> PipelineModel:
    """The model saved for ``key`` in this application, else ``fit()``,
    saved.  Always the saved one is returned: a freshly fitted classifier
    holds its training summary and through it the session, which cannot go to
    the tasks that score."""
    k = (spark.sparkContext.applicationId, *key)
    if k not in _PATHS:
        _PATHS[k] = f"{checkpoint_dir(spark).rstrip('/')}/models/{key_name(k)}"
        reloaded(fit(), _PATHS[k])
    return PipelineModel.load(_PATHS[k])


def reloaded(model: PipelineModel, path: str) -> PipelineModel:
    """The model saved to ``path`` and read back, without training summaries."""
    model.write().overwrite().save(path)
    return PipelineModel.load(path)


def cut_tree(nodes: dict, depth: int) -> list[dict]:
    """The nodes (by id, the root is 0) of a saved tree down to ``depth``, in
    order and numbered anew: what stands there becomes a leaf, and as after a
    fit two leaves of one prediction fall together."""
    out: list[dict] = []

    def leaf(at: int) -> dict:
        del out[at + 1:]
        out[at] |= {"gain": -1.0, "leftChild": -1, "rightChild": -1,
                    "split": {"featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1}}
        return out[at]

    def visit(node: dict, level: int) -> dict:
        at = len(out)
        out.append(node | {"id": at})
        if node["leftChild"] < 0 or level == depth:
            return leaf(at)
        left = visit(nodes[node["leftChild"]], level + 1)
        right = visit(nodes[node["rightChild"]], level + 1)
        if left["leftChild"] < 0 and right["leftChild"] < 0 and left["prediction"] == right["prediction"]:
            return leaf(at)
        out[at] |= {"leftChild": left["id"], "rightChild": right["id"]}
        return out[at]
    visit(nodes[0], 0)
    return out


def shallower(spark: SparkSession, model: RandomForestClassificationModel, depths: list[int],
              path: str) -> list[RandomForestClassificationModel]:
    """The forest cut at each of ``depths``, from its saved nodes (their number
    is bounded by the trees and their depth, not by the rows fitted on)."""
    model.write().overwrite().save(path)
    saved = spark.read.parquet(f"{path}/data")
    trees: dict[int, dict] = {}
    for r in saved.collect():
        trees.setdefault(r.treeID, {})[r.nodeData.id] = r.nodeData.asDict(True)
    about, named = spark.read.parquet(f"{path}/treesMetadata"), json.loads(spark.read.text(f"{path}/metadata").first()[0])
    found = []
    for depth in depths:
        to = f"{path}-{depth}"
        rows = [(tree, node) for tree, nodes in sorted(trees.items()) for node in cut_tree(nodes, depth)]
        spark.createDataFrame(rows, saved.schema).coalesce(1).write.parquet(f"{to}/data")
        about.write.parquet(f"{to}/treesMetadata")
        named["paramMap"]["maxDepth"] = depth
        spark.createDataFrame([(json.dumps(named),)], "value string").coalesce(1).write.text(f"{to}/metadata")
        found.append(RandomForestClassificationModel.load(to))
    return found


_TABLES: dict[tuple, str] = {}


def materialized(spark: SparkSession, key: tuple, build):
    """A derived table computed once per application and key, written to
    the shared checkpoint folder and read back by every query that needs
    it (e.g. component labels used by profiles and member lists)."""
    k = (spark.sparkContext.applicationId, *key)
    path = _TABLES.get(k)
    if path is None:
        path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{key_name(k)}"
        build().write.mode("overwrite").parquet(path)
        _TABLES[k] = path
    return spark.read.parquet(path)


_ROWS: dict[tuple, object] = {}


def checkpointed(spark: SparkSession, key: tuple, build):
    """Rows computed once per application and key and checkpointed, so that
    the passes of an estimator read them in the partitions they were built
    in: what a forest draws depends on those."""
    k = (spark.sparkContext.applicationId, *key)
    if k not in _ROWS:
        checkpoint_dir(spark)
        _ROWS[k] = build().checkpoint(eager=True)
    return _ROWS[k]
