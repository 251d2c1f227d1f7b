"""Helpers shared by the training-data operators.

Conventions that hold for every operator here:

* ``docs`` needs the columns ``doc_id`` and ``text`` only. Other columns are ignored, so their names can't clash.
* A null text counts as an empty text. A null ``doc_id`` is carried through.
* Repeated rows give repeated result rows. An empty table gives an empty result with the full schema.
* Texts are processed whole.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.checkpoints import kept as stored  # noqa: F401
from codeloom.checkpoints import shared_dir  # noqa: F401

_LOWER_ASCII = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ALNUM = bytes((c + 32 if 65 <= c <= 90 else c) if (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128) else 32 for c in range(256))


def space_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER_ASCII).split() if text else []


def alnum_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_ALNUM).split() if text else []


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of plans that nobody holds any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Return what this process has freed to the system; the allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU library
        trim(0)


def tidy(run: Callable, forget: Callable[[], None] | None = None) -> Callable:
    """run, a function for mapInArrow, that leaves its worker small: Spark keeps idle workers beside the tasks of later plans.

    forget drops what run has kept in its worker.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            if forget:
                forget()
            give_back()

    return tidied


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two longs that identify a row by its content; equal rows share them. 128 bits together."""
    return [F.xxhash64(F.col(doc_id)).alias("k1"), F.xxhash64(F.col(text), F.col(doc_id), F.lit(7)).alias("k2")]


def id_text(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("string").alias("text"))


def id_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def int_lists(lists, kind=None) -> pa.Array:
    """A list array from many numpy arrays or lists of numbers, built without boxing each number."""
    import numpy as np

    kind = kind or np.int32
    sizes = np.fromiter((len(x) for x in lists), dtype=np.int64, count=len(lists))
    offsets = np.zeros(len(lists) + 1, dtype=np.int32)
    np.cumsum(sizes, out=offsets[1:])
    flat = np.concatenate([np.asarray(x, dtype=kind) for x in lists]) if len(lists) else np.zeros(0, dtype=kind)
    return pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.array(flat))


def put_file(folder: str, name: str, content: bytes) -> str:
    """Write one file into a folder given as a URI that driver and executors share, whole or not at all; returns its URI."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    store.create_dir(root, recursive=True)
    part = f"{root}/_{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(part) as f:
        f.write(content)
    store.move(part, f"{root}/{name}")
    return f"{folder.rstrip('/')}/{name}"
