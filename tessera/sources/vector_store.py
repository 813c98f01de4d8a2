"""A paged vector store as a Spark data source.

A store is a folder of pages and a manifest. A page is a JSON object with
``embedding_dim``, ``data`` (a list of rows with ``__id__`` and payload) and
``matrix`` (base64 of the rows' float32 values, row after row). Writing tasks write
pages of a bounded number of rows; the manifest with every page's rows is written
last, so a store without it is not there. Reading plans one partition for a range of
pages; a page is decoded as one matrix and must agree with its rows, the expected
dimension and the manifest.

Pages are opened by PyArrow's file systems, which know local, HDFS and object
stores by their address; workers need access to it.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "id string, payload string, vector array<float>"
MANIFEST = "_manifest.json"
PAGE_ROWS, PAGES_PER_PARTITION = 500, 8


class StoreError(ValueError):
    """The store does not hold what it says."""


def folder(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def encoded(ids: list[str], payloads: list[str | None], vectors: np.ndarray) -> bytes:
    """A page of rows and their matrix."""
    rows = [{**json.loads(p or "{}"), "__id__": i} for i, p in zip(ids, payloads, strict=True)]
    return json.dumps({"embedding_dim": vectors.shape[1], "data": rows, "matrix": base64.b64encode(np.ascontiguousarray(vectors, np.float32).tobytes()).decode()}, ensure_ascii=False).encode()


def decoded(page: bytes, dim: int | None = None) -> tuple[list[str], list[str], np.ndarray]:
    """(ids, payloads, matrix) of a page; its matrix must have one row of ``embedding_dim`` values for each row."""
    held = json.loads(page)
    size, rows = held["embedding_dim"], held["data"]
    if dim is not None and rows and size != dim:
        raise StoreError(f"vectors have {size} dimensions, not {dim}")
    flat = np.frombuffer(base64.b64decode(held["matrix"]), np.float32)
    if len(flat) != len(rows) * size:
        raise StoreError(f"matrix holds {len(flat)} values for {len(rows)} rows of {size}")
    return [r["__id__"] for r in rows], [json.dumps({k: v for k, v in r.items() if k != "__id__"}, sort_keys=True, ensure_ascii=False) for r in rows], flat.reshape(len(rows), size)


@dataclass
class Pages(InputPartition):
    names: list[tuple[str, int]]


@dataclass
class Written(WriterCommitMessage):
    pages: list[tuple[str, int]]
    dim: int | None


class StoreReader(DataSourceReader):
    def __init__(self, path: str, dim: int | None, pages: int):
        self.path, self.dim, self.pages = path, dim, pages

    def partitions(self) -> list[Pages]:
        files, at = folder(self.path)
        with files.open_input_stream(f"{at}/{MANIFEST}") as f:
            manifest = json.loads(f.read())
        if self.dim is not None and manifest["embedding_dim"] not in (None, self.dim):
            raise StoreError(f"vectors have {manifest['embedding_dim']} dimensions, not {self.dim}")
        names = [tuple(p) for p in manifest["pages"]]
        if sum(n for _, n in names) != manifest["rows"]:
            raise StoreError(f"pages have {sum(n for _, n in names)} rows, the store {manifest['rows']}")
        return [Pages(names[i : i + self.pages]) for i in range(0, len(names), self.pages)] or [Pages([])]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        files, at = folder(self.path)
        for name, n in partition.names:
            with files.open_input_stream(f"{at}/{name}") as f:
                ids, payloads, matrix = decoded(f.read(), self.dim)
            if len(ids) != n:
                raise StoreError(f"{name} has {len(ids)} rows, not {n}")
            lists = pa.ListArray.from_arrays(np.arange(0, matrix.size + 1, matrix.shape[1] or 1, dtype=np.int32)[: n + 1], pa.array(matrix.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(payloads, pa.string()), lists], ["id", "payload", "vector"])


class StoreWriter(DataSourceArrowWriter):
    def __init__(self, path: str, dim: int | None, rows: int):
        self.path, self.dim, self.rows = path, dim, rows

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, at = folder(self.path)
        files.create_dir(at, recursive=True)
        # a task that is run again writes pages of its own; only those of the committed attempt are in the manifest
        stem = f"page-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}"
        pages, dim = [], None
        for batch in iterator:
            for low in range(0, batch.num_rows, self.rows):
                part = batch.slice(low, self.rows)
                vectors = part["vector"]
                sizes = set(vectors.value_lengths().to_pylist())
                if len(sizes | {dim} - {None}) != 1 or None in sizes:
                    raise StoreError(f"vectors of different dimensions: {sorted(sizes | {dim} - {None}, key=str)}")
                dim = sizes.pop()
                if self.dim is not None and dim != self.dim:
                    raise StoreError(f"vectors have {dim} dimensions, not {self.dim}")
                name = f"{stem}-{len(pages):06d}.json"
                with files.open_output_stream(f"{at}/{name}") as f:
                    f.write(encoded(part["id"].to_pylist(), part["payload"].to_pylist(), vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)))
                pages.append((name, part.num_rows))
        return Written(pages, dim)

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None]
        dims = {m.dim for m in done} - {None}
        if len(dims) > 1:
            raise StoreError(f"vectors of different dimensions: {sorted(dims)}")
        pages = sorted(p for m in done for p in m.pages)
        files, at = folder(self.path)
        files.create_dir(at, recursive=True)
        with files.open_output_stream(f"{at}/{MANIFEST}") as f:
            f.write(json.dumps({"embedding_dim": next(iter(dims), None), "rows": sum(n for _, n in pages), "pages": pages}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        files, at = folder(self.path)
        for name, _ in (p for m in messages if m is not None for p in m.pages):
            files.delete_file(f"{at}/{name}")


class VectorPages(DataSource):
    """``spark.read.format("vector_pages")`` with options path, dim, pages (a partition) and rows (a page)."""

    @classmethod
    def name(cls) -> str:
        return "vector_pages"

    def schema(self) -> str:
        return SCHEMA

    def _dim(self) -> int | None:
        return int(self.options["dim"]) if "dim" in self.options else None

    def reader(self, schema) -> StoreReader:
        return StoreReader(self.options["path"], self._dim(), int(self.options.get("pages", PAGES_PER_PARTITION)))

    def writer(self, schema, overwrite: bool) -> StoreWriter:
        return StoreWriter(self.options["path"], self._dim(), int(self.options.get("rows", PAGE_ROWS)))


def write_store(vectors: DataFrame, path: str, dim: int | None = None, rows: int = PAGE_ROWS) -> None:
    """Rows (id, payload as JSON, vector) as a new store; all vectors have one dimension."""
    vectors.sparkSession.dataSource.register(VectorPages)
    kept = vectors.select(F.col("id").cast("string").alias("id"), F.col("payload").cast("string").alias("payload"), F.col("vector").cast("array<float>").alias("vector"))
    writer = kept.write.format("vector_pages").mode("append").option("rows", rows)
    (writer if dim is None else writer.option("dim", dim)).save(path)


def read_store(spark: SparkSession, path: str, dim: int | None = None, pages: int = PAGES_PER_PARTITION) -> DataFrame:
    """Id, payload and vector of all rows."""
    spark.dataSource.register(VectorPages)
    reader = spark.read.format("vector_pages").option("pages", pages)
    return (reader if dim is None else reader.option("dim", dim)).load(path)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Dimension and rows of a store as its rows show them."""
    return read_store(spark, path).groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n"))


def round_trip(source: DataFrame, stored: DataFrame, most: int = 20) -> DataFrame:
    """N, least and greatest cosine of ``most`` ids of ``source`` with what is stored; a missing id raises.

    The sample is the ids of the least hashes, the same in every run; both sides have id and vector.
    """
    from tessera.operators.search import cosine

    sample = source.groupBy("id").agg(F.min_by("vector", F.xxhash64("vector")).alias("given")).orderBy(F.xxhash64("id"), "id").limit(most)
    met = sample.join(stored.select("id", "vector"), "id", "left")
    there = F.assert_true(F.col("vector").isNotNull(), F.concat(F.lit("not stored: "), "id"))
    score = F.round(F.when(there.isNull(), cosine(F.col("given"), F.col("vector"))), 6)
    return met.agg(F.count("*").alias("n"), F.min(score).alias("least"), F.max(score).alias("most"))
