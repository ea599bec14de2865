"""What the corpus operators share: scratch tables in the cluster's shared folder and row maps over Arrow batches."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# workers need no copy of this package: its functions travel with the tasks
cloudpickle.register_pickle_by_value(sys.modules[__name__.partition(".")[0]])

#: Words of the contracts: runs of anything but the ASCII blanks. bytes.split() cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a scratch table that are worth a task and a file of their own, where few are known to come.
FEW_ROWS = 10_000
#: Bytes of a batch that become Python objects at a time.
BATCH_BYTES = 8 << 20
#: bytes.translate table that lower-cases A-Z and leaves the rest.
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(text: str | None) -> bytes:
    """The text's bytes; null is empty. Lone surrogates, which Spark itself cannot hold, are replaced."""
    return (text or "").encode("utf-8", "replace")


class Scratch:
    """Tables written once and reread, so that lineage is cut and a lost executor costs a reread only.

    They lie under spark.checkpoint.dir, which driver and executors share. Where that is unset, a local master, as in
    tests, has them in a folder that goes with the process; a cluster must name one."""

    own: str | None = None

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            if Scratch.own is None:
                Scratch.own = tempfile.mkdtemp(prefix="readloom-")
                atexit.register(shutil.rmtree, Scratch.own, ignore_errors=True)
            base = Scratch.own
        self.root = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, most: int | None = None) -> DataFrame:
        """most: the rows that can come, where that is known. A few go to few files, whatever the number of shuffle
        partitions: the driver plans, commits, lists and remembers each, and Hadoop starts a process for each it makes."""
        if most is not None:
            df = df.coalesce(max(1, -(-most // FEW_ROWS)))
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Deletes tables that no later job reads."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def pieces(batches: Iterator[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut into slices of at most `most` bytes or one row, so that few texts are Python objects at once."""
    for b in batches:
        if b.nbytes > most and b.num_rows > 1:
            half = b.num_rows // 2
            yield from pieces((b.slice(0, half), b.slice(half)), most)
        else:
            yield b


def map_rows(df: DataFrame, schema: T.StructType | str, rows: Callable[[Iterator[dict]], Iterator[tuple]], batch: int = 2000) -> DataFrame:
    """mapInArrow with columns as Python lists in and tuples out. rows gets each batch as a dict of lists and
    yields tuples; it sees the batches of a partition in order, so it may stream over sorted rows."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out, arrow = [], to_arrow_schema(schema)
        for row in rows(b.to_pydict() for b in pieces(batches)):
            out.append(row)
            if len(out) >= batch:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, columns: list[str], mask: Callable[[dict], list[bool]]) -> DataFrame:
    """Rows for which mask, called with lists of the named columns, says true; all columns stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            yield b.filter(pa.array(mask(b.select(columns).to_pydict()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores after it as it takes to differ from every column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def masked(docs: DataFrame) -> DataFrame:
    """docs with every column but doc_id and text renamed by its place, so that no name of an operator's own clashes;
    toDF(*docs.columns) names them again."""
    return docs.toDF(*[c if c in ("doc_id", "text") else f"_c{i}" for i, c in enumerate(docs.columns)])


def crc_mod(doc_id, n: int):
    """crc32(doc_id as text) mod n, a column; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n
