"""What the operators share: the shared folder, lineage cuts, broadcasts of a checked size, word caches."""

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.storage import cut, remove, shared_dir

__all__ = ["BROADCAST_BYTES", "BROADCAST_ROWS", "WORD_JAVA", "WordCache", "cut", "give_back", "packed", "remove", "shared_dir", "small_side"]

#: Rows, and bytes of their values, of a table that may be broadcast; both are counted first.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 48 << 20

#: Words as ``[^\x20\x09-\x0D]+``. On UTF-8 bytes, ``bytes.split()`` gives the same words.
WORD_JAVA = r"[^\x20\x09-\x0D]+"


def _width(value: Column, kind: T.DataType) -> Column:
    """Bytes of a value, about."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 8
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.size(value), F.lit(0)) * 8 + 8
    if isinstance(kind, T.StructType):
        return sum((_width(value[f.name], f.dataType) for f in kind.fields), F.lit(8))
    return F.lit(8)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a table for broadcast if its counted rows and bytes allow it; else Spark joins by shuffle. df should be cut already."""
    if df.limit(rows + 1).count() > rows:
        return df
    width = sum((_width(F.col(f.name), f.dataType) for f in df.schema.fields), F.lit(16))
    return F.broadcast(df) if (df.agg(F.sum(width.cast("bigint"))).first()[0] or 0) <= most else df


def packed(docs: DataFrame) -> Column:
    """A row's own columns as one struct, so that no name which an operator adds can meet them; ``row.*`` gives them back."""
    return F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")


def give_back() -> None:
    """Returns a worker's free memory to the system at a task's end; Spark keeps the worker, and others may then need the room."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


class WordCache(dict):
    """word -> make(word). Two generations: once ``limit`` words are held they become the older one, from which words in use come
    back; so memory is bounded by twice the limit and frequent words stay."""

    def __init__(self, make, limit: int = 150_000, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest, self.older = make, limit, longest, {}

    def __missing__(self, word):
        value = self.older.get(word)
        if value is None:
            value = self.make(word)
        if len(word) <= self.longest:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[word] = value
        return value

    def forget(self) -> None:
        self.clear()
        self.older = {}
