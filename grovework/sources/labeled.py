"""A Spark data source of labelled image records: `labeled_records`, in shards that are committed together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = "labeled_records"
POINTS = "array<struct<label:int,i:int,j:int>>"
#: A record: its key, an image of height x width x bands, and labelled points of it.
RECORD = f"key string, height int, width int, bands int, pixels binary, points {POINTS}"
#: Of reads with option rejects: how many records of a shard were turned down, and why.
REJECTS = "shard string, reason string, n long"
#: Records of a shard; bytes of shards that one partition reads.
SHARD_RECORDS, PARTITION_BYTES = 100, 64 << 20


def labeled_source() -> type:
    """The data source's class, made here so that it travels to workers as it is.

    Options: path (any file system that pyarrow knows by URI), rejects (true:
    counts of records turned down in place of records), shard (records in one).
    Shards are Arrow files.  A write leaves its shards under names of their own,
    and a manifest names them once all tasks are through: readers see committed
    shards only, and what an aborted or repeated task has left is never read.
    """
    import uuid
    from collections.abc import Iterator

    import pyarrow as pa
    from pyarrow import fs, ipc
    from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
    from pyspark.sql.types import StructType

    points = pa.list_(pa.struct([(n, pa.int32()) for n in ("label", "i", "j")]))
    record = pa.schema([("key", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("bands", pa.int32()), ("pixels", pa.binary()), ("points", points)])
    turned_down = pa.schema([("shard", pa.string()), ("reason", pa.string()), ("n", pa.int64())])

    def opened(path: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")

    class Part(InputPartition):
        def __init__(self, shards: list[str]):
            self.shards = shards

    class Written(WriterCommitMessage):
        def __init__(self, shards: list[str]):
            self.shards = shards

    def reason(key: object, h: object, w: object, bands: object, pixels: object) -> str | None:
        """Why a record isn't one; null for those that are."""
        if not isinstance(key, str):
            return "null" if key is None else "type"
        if not key.strip():
            return "empty"
        if None in (h, w, bands, pixels) or len(pixels) != h * w * bands:
            return "shape"
        return None

    class Reader(DataSourceReader):
        def __init__(self, path: str, rejects: bool):
            self.path, self.rejects = path, rejects

        def partitions(self) -> list[Part]:
            system, root = opened(self.path)
            manifests = [f.path for f in system.get_file_info(fs.FileSelector(root)) if f.path.rpartition("/")[2].startswith("_committed-")]
            shards = sorted(f"{root}/{s}" for m in manifests for s in system.open_input_file(m).read().decode().split())
            out, size = [Part([])], 0
            for shard in shards:
                more = system.get_file_info(shard).size
                if out[-1].shards and size + more > PARTITION_BYTES:
                    out.append(Part([]))
                    size = 0
                out[-1].shards.append(shard)
                size += more
            return out

        def read(self, part: Part) -> Iterator[pa.RecordBatch]:
            system, _ = opened(self.path)
            kind = turned_down if self.rejects else record
            for shard in part.shards:
                counts: dict[str, int] = {}
                with system.open_input_file(shard) as source:
                    for batch in ipc.open_file(source).read_all().to_batches():
                        why = [reason(*row) for row in zip(*(batch.column(n).to_pylist() for n in ("key", "height", "width", "bands", "pixels")), strict=True)]
                        for w in why:
                            if w:
                                counts[w] = counts.get(w, 0) + 1
                        if not self.rejects:
                            good = batch.filter(pa.array([w is None for w in why], pa.bool_()))
                            yield pa.RecordBatch.from_arrays([good.column(f.name).cast(f.type) for f in kind], schema=kind)
                if self.rejects and counts:
                    name = shard.rpartition("/")[2]
                    yield pa.RecordBatch.from_pylist([{"shard": name, "reason": k, "n": n} for k, n in sorted(counts.items())], schema=kind)

    class Writer(DataSourceArrowWriter):
        def __init__(self, path: str, records: int, overwrite: bool):
            self.path, self.records, self.overwrite = path, records, overwrite

        def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
            system, root = opened(self.path)
            system.create_dir(root)
            shards, left = [], None

            def put(table: pa.Table) -> None:
                shards.append(f"shard-{uuid.uuid4().hex}.arrow")
                with system.open_output_stream(f"{root}/{shards[-1]}") as sink, ipc.new_file(sink, table.schema) as out:
                    out.write_table(table)

            for batch in batches:
                rows = pa.Table.from_batches([batch])
                left = rows if left is None or not left.num_rows else pa.concat_tables([left, rows])
                while left.num_rows >= self.records:
                    put(left.slice(0, self.records))
                    left = left.slice(self.records)
            if left is not None and left.num_rows:
                put(left)
            return Written(shards)

        def commit(self, messages: list[Written | None]) -> None:
            system, root = opened(self.path)
            system.create_dir(root)
            before = [f.path for f in system.get_file_info(fs.FileSelector(root))] if self.overwrite else []
            shards = [s for m in messages if m for s in m.shards]
            with system.open_output_stream(f"{root}/_committed-{uuid.uuid4().hex}") as sink:
                sink.write("\n".join(shards).encode())
            own = {f"{root}/{s}" for s in shards}
            for path in sorted(before, key=lambda p: "/_committed-" not in p):  # manifests go first
                if path not in own:
                    system.delete_file(path)

        def abort(self, messages: list[Written | None]) -> None:
            system, root = opened(self.path)
            for m in messages:
                for s in m.shards if m else []:
                    system.delete_file(f"{root}/{s}")

    class LabeledRecords(DataSource):
        @classmethod
        def name(cls) -> str:
            return NAME

        def _rejects(self) -> bool:
            return str(self.options.get("rejects", "false")).lower() == "true"

        def schema(self) -> str:
            return REJECTS if self._rejects() else RECORD

        def reader(self, schema: StructType) -> Reader:
            return Reader(self.options["path"], self._rejects())

        def writer(self, schema: StructType, overwrite: bool) -> Writer:
            return Writer(self.options["path"], int(self.options.get("shard", SHARD_RECORDS)), overwrite)

    return LabeledRecords


def register(spark: SparkSession) -> None:
    """Make spark.read.format("labeled_records") and df.write.format("labeled_records") known to the session."""
    spark.dataSource.register(labeled_source())


def write_records(records: DataFrame, path: str, shard: int = SHARD_RECORDS) -> None:
    """Records (RECORD; keys of any type, so that bad ones can be told later) in shards, added to what is at `path`."""
    register(records.sparkSession)
    names = [f.split()[0] for f in RECORD.split(", ")]
    records.select(*names).write.format(NAME).mode("append").option("shard", shard).save(path)


def read_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The good records at `path`, and how many were turned down (reason, n): no key, a blank one, no string, or pixels that don't fill the image."""
    register(spark)
    source = spark.read.format(NAME)
    rejects = source.option("rejects", "true").load(path).groupBy("reason").agg(F.sum("n").alias("n"))
    return spark.read.format(NAME).load(path), rejects
