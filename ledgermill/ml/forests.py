"""Random forests in blocks of trees: the driver holds one block, never the whole forest.

Spark grows a forest on the driver and sends it whole to the tasks. Deep trees grow with the
rows, so a forest beyond NODES nodes is fitted, saved, loaded and applied block by block.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources import files

NODES = 400_000  # nodes of the trees grown at once, at most while a leaf keeps its smallest size


def trees_at_once(rows: int, smallest_leaf: int) -> int:
    """Trees that stay below NODES together, however deep: a tree has at most
    2 * rows / smallest_leaf nodes."""
    return max(1, NODES * smallest_leaf // max(2 * rows, 1))


def fit_forest(estimator: RandomForestClassifier, train: DataFrame, rows: int, folder: str) -> PipelineModel:
    """The whole forest, in one fit if it is sure to stay small, else in blocks of trees.

    The first block is as small as the rows demand; later ones go by the largest tree of the
    blocks before, half of NODES so that a larger tree finds room. Each block has a seed of its own.
    """
    trees, seed = estimator.getNumTrees(), estimator.getSeed()
    size = trees_at_once(rows, estimator.getMinInstancesPerNode())
    if size >= trees:
        return Pipeline(stages=[estimator]).fit(train)
    spark, done, blocks, largest = train.sparkSession, 0, 0, 1
    parts = None
    while done < trees:
        now = min(size, trees - done)
        block = estimator.copy({estimator.numTrees: now, estimator.seed: seed + 1_000_003 * blocks, estimator.cacheNodeIds: True})
        model = block.fit(train)
        model.write().overwrite().save(f"{folder}/block_{blocks:04d}")
        largest = max(largest, _largest_tree(spark, f"{folder}/block_{blocks:04d}"))
        share = model.featureImportances.toArray() * now
        parts = share if parts is None else parts + share
        done, blocks = done + now, blocks + 1
        size = max(1, NODES // (2 * largest))
    importances = parts / parts.sum() if parts.sum() else parts
    return PipelineModel([BlockForest(folder, blocks, importances)])


def _largest_tree(spark: SparkSession, path: str) -> int:
    """Nodes of the largest tree of a saved block."""
    nodes = spark.read.parquet(f"{path}/data").groupBy("treeID").agg(F.count("*").alias("n"))
    return nodes.agg(F.max("n")).first()[0]


class BlockForest(Transformer, MLWritable, MLReadable):
    """A fitted forest whose blocks of trees lie in a folder all executors and the driver reach."""

    def __init__(self, folder: str, blocks: int, importances):
        super().__init__()
        self.folder, self.blocks = folder, blocks
        self.featureImportances = DenseVector(np.asarray(importances))

    def _block(self, number: int) -> RandomForestClassificationModel:
        return RandomForestClassificationModel.load(f"{self.folder}/block_{number:04d}")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Votes of all trees, added up in one written pass per block."""
        spark = dataset.sparkSession
        work = f"{shared_folder(spark)}/votes-{uuid.uuid4().hex}"
        kept, rows = dataset.columns, dataset
        for number in range(self.blocks):
            votes = vector_to_array("rawPrediction")
            if number:
                votes = F.zip_with("_votes", votes, lambda a, b: a + b)
            voted = self._block(number).transform(rows).select(*kept, votes.alias("_votes"))
            voted.write.parquet(f"{work}/{number}")
            if number:
                files.delete(spark, f"{work}/{number - 1}")
            rows = spark.read.schema(voted.schema).parquet(f"{work}/{number}")
        total = F.aggregate("_votes", F.lit(0.0), lambda a, b: a + b)
        place = F.array_position("_votes", F.array_max("_votes")) - 1
        return rows.select(
            *kept,
            array_to_vector(F.col("_votes")).alias("rawPrediction"),
            array_to_vector(F.transform("_votes", lambda v: F.when(total > 0, v / total).otherwise(v))).alias("probability"),
            place.cast("double").alias("prediction"),
        )

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader()


class _ForestWriter(MLWriter):
    def __init__(self, forest: BlockForest):
        super().__init__()
        self.forest = forest

    def saveImpl(self, path: str) -> None:
        forest = self.forest
        DefaultParamsWriter.saveMetadata(
            forest, path, self.sparkSession, {"blocks": forest.blocks, "importances": forest.featureImportances.toArray().tolist()}
        )
        for number in range(forest.blocks):
            forest._block(number).write().overwrite().save(f"{path}/block_{number:04d}")


class _ForestReader(MLReader):
    def load(self, path: str) -> BlockForest:
        found = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        return BlockForest(path, found["blocks"], found["importances"])
