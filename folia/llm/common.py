"""What the operators share: scratch tables, byte views of Arrow text, seeded order keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes that separate words: [\x20\x09-\x0D].
SPACES = b" \t\n\x0b\x0c\r"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True

SEED = 42
#: Rows of one key that an ordinary join may bring to one task.
HEAVY_ROWS = 1_000_000
#: Groups whose counts are summed up in one window; the sums of these are summed up in turn.
BLOCK = 4_096


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Only a session on one machine may do without, with a folder of its own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.folia.scratch", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="folia-")
        spark.conf.set("spark.folia.scratch", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_folder = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of materialize that nothing reads any more; others are left alone."""
    for df in tables:
        path = vars(df).get("scratch_folder")
        if path:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def maybe_broadcast(df: DataFrame, rows: int = 100_000, size: int = 32 << 20) -> DataFrame:
    """df marked for broadcast if it has no more than so many rows, and so many bytes of text in them, else df: then an ordinary join."""
    texts = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary")]
    n, held = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(sum(texts, F.lit(0)))).first()
    return F.broadcast(df) if n <= rows and (held or 0) <= size else df


def join_groups(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """rows joined with the table groups (of, n, ...) where key = of; n rows have that key.

    The groups of over HEAVY_ROWS rows, of which there are few, are broadcast: no task gets one whole.
    """
    heavy = groups.filter(F.col("n") > HEAVY_ROWS)
    if not heavy.limit(1).count():
        return rows.join(groups, F.col(key) == F.col("of")).drop("of", "n")
    few = maybe_broadcast(heavy)
    rest = rows.join(maybe_broadcast(heavy.select("of")), F.col(key) == F.col("of"), "left_anti").join(groups.filter(F.col("n") <= HEAVY_ROWS), F.col(key) == F.col("of"))
    return rows.join(few, F.col(key) == F.col("of")).unionByName(rest).drop("of", "n")


def before_groups(counts: DataFrame, keys: list[str], group: str) -> DataFrame:
    """keys, group, and how many rows the groups before it have, of the rows (keys, group, c); in two steps, so that no task sums all groups."""
    counts = counts.withColumn("block", F.floor(F.col(group) / BLOCK))
    in_block = Window.partitionBy(*keys, "block").orderBy(group)
    counts = counts.withColumn("inside", F.sum("c").over(in_block) - F.col("c"))
    blocks = counts.groupBy(*[F.col(k).alias(f"b_{k}") for k in keys], F.col("block").alias("b_block")).agg(F.sum("c").alias("s"))
    blocks = blocks.withColumn("start", F.sum("s").over(Window.partitionBy(*[f"b_{k}" for k in keys]).orderBy("b_block")) - F.col("s"))
    same = F.col("block") == F.col("b_block")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"b_{k}"))
    return counts.join(maybe_broadcast(blocks), same).select(*keys, group, "c", (F.col("start") + F.col("inside")).alias("before"))


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, out of the way of any other name."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def odd_ids(df: DataFrame, id_col: str) -> bool:
    """Whether any id is repeated or null."""
    return df.groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or id is null").limit(1).count() > 0


def data_partitions(df: DataFrame, grow: float = 1.0, target: int = 128 << 20) -> int:
    """Partitions for a shuffle of grow times the bytes of df, as its files say: `target` bytes each, or the session's number if that is more.

    Tasks that gather a partition hold about that much, however large the input. A frame that is
    not read from files, whose size Spark does not know, gets the session's number.
    """
    size, least = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-int(size * grow) // target)) if size < 1 << 55 else least


def order_key(seed: int, *cols: Column) -> Column:
    """A seeded pseudo-random order: 32 hex digits that any engine with MD5 can repeat."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]))


def unit(key: Column) -> Column:
    """The first 13 hex digits of an order key as a double in [0, 1), monotone in the key."""
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the len + 1 offsets into them; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_slices(batch: pa.RecordBatch, column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose text has about `most` bytes, one row at least: bounds working memory."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def word_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of [^\x20\x09-\x0D]+ in each text."""
    if not len(data):
        return np.zeros(len(offsets) - 1, np.int64)
    word = ~IS_SPACE[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    first = offsets[:-1][offsets[1:] > offsets[:-1]]
    start[first] = word[first]
    return np.diff(np.searchsorted(np.flatnonzero(start), offsets)).astype(np.int64)


def with_word_counts(df: DataFrame, text: str, out: str, keep: list[str]) -> DataFrame:
    """The columns of keep and the word count of `text` as long column `out`; null has 0 words."""
    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*keep).dtypes)

    def count(batches):
        for whole in batches:
            for b in row_slices(whole):
                n = word_counts(*bytes_of(b.column("text")))
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], pa.array(n)], names=[*keep, out])

    return df.select(*keep, F.col(text).alias("text") if text not in keep else F.col(text)).mapInArrow(count, f"{schema}, `{out}` bigint")
