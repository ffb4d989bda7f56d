"""Whitening of embeddings with distributed block matrices.

Distinct vectors are centred and indexed as rows of a BlockMatrix; its transpose times itself is
the scatter matrix, whose eigenvectors are found on the driver (one number a pair of dimensions).
The rows of all vectors, in a BlockMatrix of their own, times the whitening matrix are the
whitened coordinates. Everything else is column expressions; no row reaches Python.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import materialize, shielded
from lectern.sources.files import numbered

#: Whole units a coordinate is cut into.
UNITS = 256
#: Rows and columns of a block; most dimensions of a vector (the driver holds a number a pair of them).
ROWS, COLUMNS, DIMENSIONS = 1024, 1024, 4096
#: Components returned, and blocks of a product's inner side that meet in one task.
COMPONENTS, MEETING = 4, 8
#: Eigenvalues below this share of the largest are taken as zero.
ZERO = 1e-12

EMPTY = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whole(vector: Column, units: int = UNITS) -> Column:
    """A vector as whole numbers, floor(units * c); null if it is null or has a null or non-finite entry.

    Entries beyond the range of a long after scaling are no vector either.
    """
    entries = F.transform(vector.cast("array<double>"), lambda c: F.floor(c * units).cast("long"))
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c * units) >= 2.0**62)
    return F.when(~F.exists(vector.cast("array<double>"), lambda c: F.coalesce(bad(c), F.lit(True))), entries)


def indexed(df: DataFrame, label: str) -> DataFrame:
    """df with the column index: its rows numbered from 0, in any order, whatever they hold."""
    rows = materialize(df, label).withColumn("__place", F.monotonically_increasing_id())  # as written, so the same each time
    return materialize(numbered(rows, "__place", "index").drop("__place"), f"{label}-indexed")


def block_matrix(rows: DataFrame, n: int, size: int) -> BlockMatrix:
    """A BlockMatrix of rows (index: long from 0, row: array<double>)."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("row").alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, size).toBlockMatrix(ROWS, COLUMNS)


def product(left: BlockMatrix, right: BlockMatrix, inner: int) -> BlockMatrix:
    """left times right; the blocks of the inner side are dealt out to tasks, MEETING a task, and their products added up."""
    made = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, max(1, -(-inner // (COLUMNS * MEETING))))
    return BlockMatrix(made, left.rowsPerBlock, right.colsPerBlock)


def local_blocks(spark, matrix: np.ndarray) -> BlockMatrix:
    """A small matrix of the driver as a BlockMatrix."""
    blocks = []
    for i in range(0, matrix.shape[0], COLUMNS):
        for j in range(0, matrix.shape[1], COLUMNS):
            part = matrix[i : i + COLUMNS, j : j + COLUMNS]
            blocks.append(((i // COLUMNS, j // COLUMNS), Matrices.dense(*part.shape, part.ravel("F"))))
    return BlockMatrix(spark.sparkContext.parallelize(blocks), COLUMNS, COLUMNS, *matrix.shape)


def scatter(rows: BlockMatrix, n: int) -> np.ndarray:
    """The transpose of rows times rows."""
    return product(rows.transpose(), rows, n).toLocalMatrix().toArray()


def principal(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues above zero, falling, and their unit eigenvectors as columns."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    some = values > ZERO * max(values[0], 0) if len(values) else np.zeros(0, bool)
    return values[some], vectors[:, some]


def whiten(df: DataFrame, embedding: str = "embedding", components: int = COMPONENTS, units: int = UNITS) -> DataFrame:
    """df's rows for each component: component, n, deviation, whitened, explained, identity_error beside df's columns.

    Each entry c of a vector becomes x = floor(units * c). The n distinct x with sums S are the
    fit list; V is their covariance (divisor n). component counts from 1 by falling eigenvalue e
    of V, deviation is the sum of (n * x - S)**2, whitened the projection of x - S / n over
    sqrt(e), explained e over V's trace, identity_error the largest entry of the fit list's
    whitened covariance less the identity.

    Defined cases: rows whose vector is null, empty, has null or non-finite entries (or some so
    large that units * c passes 2**62) go; vectors of another length than most have (ties: the
    longer) have no place in the covariance and go too; components whose eigenvalue is zero have
    no rows, so a single distinct vector gives none; equal vectors count once in the fit and are
    all returned; null and repeated ids are kept; df's columns of the names returned are replaced.
    Equal eigenvalues leave the choice of their vectors open. More than 4,096 dimensions are an error.
    """
    spark = df.sparkSession
    new = [c.split()[0] for c in EMPTY.split(", ")]
    plain, called = shielded(df)
    keep = [c for c in df.columns if c not in new]
    kept = [called[c] for c in keep]
    rows = plain.select(*kept, whole(F.col(called[embedding]), units).alias("x"))
    rows = indexed(rows.where(F.size("x") > 0), "vectors")
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    none = rows.where(F.lit(False)).select(*kept, *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in EMPTY.split(", ")]).toDF(*keep, *new)
    if not sizes:
        return none
    d = sizes[0].d
    if d > DIMENSIONS:
        raise ValueError(f"vectors of {d} dimensions; the covariance of more than {DIMENSIONS} is not held on the driver")
    fits = F.size("x") == d
    distinct = indexed(rows.where(fits).select("x").distinct(), "distinct-vectors")
    n = distinct.count()
    facts = distinct.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.max(F.abs("v")).alias("m")).orderBy("k").collect()  # one row a dimension
    sums, reach = [int(r.s) for r in facts], max(int(r.m) for r in facts)
    far = n * reach + max(map(abs, sums))
    kind = "long" if d * far * far < 1 << 63 else "decimal(38,0)"  # the same numbers: no sum can pass 64 bits
    total = F.array(*[F.lit(s).cast(kind) for s in sums])
    away = F.zip_with(F.col("x"), total, lambda x, s: (F.lit(n).cast(kind) * x.cast(kind) - s).cast(kind))
    centred = F.transform(away, lambda v: v.cast("double") / n)
    fitted = block_matrix(distinct.select("index", centred.alias("row")), n, d)
    covariance = scatter(fitted, n) / n
    values, vectors = principal(covariance, components)
    if not len(values):
        return none
    turn = local_blocks(spark, vectors / np.sqrt(values))
    mine = product(fitted, turn, d)
    spread = scatter(mine, n) / n
    error = float(np.abs(spread - np.eye(len(values))).max())
    count = rows.count()
    chosen = rows.where(fits)
    turned = product(block_matrix(chosen.select("index", centred.alias("row")), count, d), turn, d).toIndexedRowMatrix()
    turned = callMLlibFunc("getIndexedRows", turned._java_matrix_wrapper._java_model).select("index", vector_to_array("vector").alias("whitened"))
    square = F.aggregate(away, F.lit(0).cast("decimal(38,0)"), lambda t, v: (t + (v * v).cast("decimal(38,0)")).cast("decimal(38,0)"))
    explained = F.array(*[F.lit(float(e / np.trace(covariance))) for e in values])
    out = chosen.join(turned, "index").select(*kept, square.alias("deviation"), F.posexplode("whitened").alias("k", "whitened"))
    result = out.select(*kept, (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"))
    return result.toDF(*keep, *new)
