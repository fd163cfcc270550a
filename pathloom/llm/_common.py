"""Shared plumbing of the text operators: table access, scratch folders, safe text splitting."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters with the Unicode property White_Space, as a regex class body.
WHITE_SPACE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_NEAR_SPACE = re.compile(f"^ | $| [{WHITE_SPACE}]|[{WHITE_SPACE}] ")
_SAFE_CUT = re.compile(f"(?<=[^{WHITE_SPACE}]) (?=[^{WHITE_SPACE}])")

#: Entries that one generation of a worker's cache may hold, and the longest key that is kept: together they bound its bytes.
CACHE_ENTRIES, LONGEST_KEY = 500_000, 64


class Cache:
    """A bounded cache in two generations: a full one ages, and what is asked for again moves back to the young one.

    What belongs to a key over LONGEST_KEY characters is made anew each time."""

    def __init__(self, make, entries: int = CACHE_ENTRIES):
        self.make, self.entries, self.young, self.old = make, entries, {}, {}

    def age(self) -> None:
        """To be called between batches."""
        if len(self.young) > self.entries:
            self.old, self.young = self.young, {}

    def miss(self, key):
        if len(key) > LONGEST_KEY:
            return self.make(key)
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.young[key] = value
        return value


#: Texts may be long, so few rows and bytes go to Python at once: both sides of the pipe hold a batch.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches have BATCH_ROWS rows and BATCH_BYTES bytes at most (the settings stay, as plans read them when they run)."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        conf.set(key, most)
    return df


def gives_back(run):
    """run for mapInArrow, after which its worker returns freed memory: workers live on between tasks and stages."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and whole text, null text as empty; any other column (whatever its name) is left behind."""
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def whole_rows(docs: DataFrame) -> Column:
    """All columns of docs as one struct, so that no name of theirs can meet another."""
    return F.struct(*(docs[quoted(c)].alias(c) for c in docs.columns))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session. Only a session on one machine (as in tests) may have none set: it gets one under /tmp."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"/tmp/checkpoints/{uuid.uuid4().hex}"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def words_after_spaces(text: str) -> list[str]:
    """Splits text at single spaces that stand between two non-space characters.

    Joined by one space the parts give the text again. No pre-token of a byte-level pattern that allows a
    space only at a token's start can cross such a space, so " " + part can be encoded alone."""
    if _NEAR_SPACE.search(text):
        return _SAFE_CUT.split(text)
    return text.split(" ")
