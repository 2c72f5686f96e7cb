"""Indexed archive containers for very many tiny files.

The original bytes of the files go, one after another, into blocks, the blocks
into large containers. An archive is a folder (`write_archive`): its `blocks` are
Parquet files, one a container and one row group a block, so that a reader takes
single blocks and many read in parallel; its `index`, sorted by path, keeps of
each file its path, container, block, offset, length and checksum. `lookup` finds
paths in the index and reads their blocks alone; every file comes back byte by
byte. Bytes that came before in the same block, under whatever name, are stored
once and indexed again. A block is closed by its bytes or by its number of
files, so very many empty or equal files do not make one large row.

Beside them the point records inside the files are read, in any of their text
forms, and kept exactly once.

Defined cases: null content is a file of zero bytes, kept in the index with
length -1; a null tile id is the id within the path; a file without records has
an empty record set, which equals no other; a file row that came more than once
counts once; ids may be of any type; extra columns are ignored; an archive is
never written over another.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.session import checkpoint_dir, cut
from quadrille.sources.tables import tile_of_path

#: Bytes of a container, and of a block, the unit that one row holds and one read fetches.
CONTAINER, BLOCK = 128 << 20, 4 << 20
#: Files that the index of a block holds at most; paths that a lookup looks up by pushed filters, more are joined.
ENTRIES, FILTERED = 4096, 1000

_NUMBER = r"([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"
_LINE = rf"^\s*{_NUMBER}\s*[,;\t|]\s*{_NUMBER}\s*[,;\t|]\s*{_NUMBER}\s*$"


def _fields(line: Column) -> Column:
    """[point_idx, x, y] of a line as text, an empty array where it is no record."""
    json = [F.regexp_extract(line, rf'"{name}"\s*:\s*"?{_NUMBER}', 1) for name in ("point_idx", "x", "y")]
    plain = F.when(line.rlike(_LINE), F.split(F.trim(line), r"\s*[,;\t|]\s*")).otherwise(F.array().cast("array<string>"))
    return F.when(line.contains("{"), F.array(*json)).otherwise(plain)


def records(content: Column) -> Column:
    """array<struct<point_idx bigint, x double, y double>>: the distinct records of a file in order, from CSV, semicolon, tab or JSON lines."""
    lines = F.split(F.coalesce(content, F.lit("")), r"[\r\n]+")
    number = lambda p, k: F.trim(F.try_element_at(p, F.lit(k))).try_cast("double")
    read = F.transform(F.transform(lines, _fields), lambda p: F.struct(number(p, 1).cast("bigint").alias("point_idx"), number(p, 2).alias("x"), number(p, 3).alias("y")))
    whole = F.filter(read, lambda r: r["point_idx"].isNotNull() & r["x"].isNotNull() & r["y"].isNotNull())
    return F.array_sort(F.array_distinct(whole))


def distinct_files(files: DataFrame) -> DataFrame:
    """file_id, path, tile_id, content, each file once, with the tile id from the path where it is missing."""
    tile = F.coalesce("tile_id", tile_of_path(F.col("path")))
    return files.where(F.col("file_id").isNotNull()).select("file_id", "path", tile.alias("tile_id"), "content").distinct()


def pack(files: DataFrame, container: int = CONTAINER, block: int = BLOCK) -> DataFrame:
    """Blocks of containers: container_id, block_no, bytes, and entries (the index of the block's files).

    One task writes whole containers: tasks are cut by the total of bytes, rows
    by tile and path, so neighbours of a tile lie together and a reader of a
    tile touches few blocks. A file larger than a block gets a block of its own.
    """
    if not 0 < block <= container:
        raise ValueError("block must be positive and at most container")
    one = distinct_files(files)
    total, rows = one.agg(F.sum(F.octet_length(F.coalesce("content", F.lit("")))), F.count("*")).first()
    tasks = max(1, -(-(total or 0) // container), -(-rows // (ENTRIES * -(-container // block))))
    laid = one.repartitionByRange(tasks, "tile_id", "path", "file_id").sortWithinPartitions("tile_id", "path", "file_id")
    laid = laid.select("*", F.spark_partition_id().alias("part"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buffer, entries, spans, used, number, made, part = bytearray(), [], {}, 0, 0, 0, 0

        def full() -> pd.DataFrame:
            row = pd.DataFrame({"container_id": [f"{part:06d}-{made:04d}"], "block_no": [number], "bytes": [bytes(buffer)], "entries": [list(entries)]})
            buffer.clear(), entries.clear(), spans.clear()
            return row

        for b in batches:
            for fid, path, tile, content, part in b.itertuples(index=False):  # noqa: B007
                data = b"" if content is None else content.encode("utf-8", "surrogatepass")
                digest = hashlib.sha256(data).hexdigest()
                if entries and (len(entries) >= ENTRIES or len(buffer) + len(data) > block and digest not in spans):
                    used += len(buffer)
                    yield full()
                    number += 1
                    if used >= container:
                        used, number, made = 0, 0, made + 1
                if digest not in spans:
                    spans[digest] = len(buffer)
                    buffer += data
                entries.append({"file_id": fid, "path": path, "tile_id": tile, "offset": spans[digest], "length": -1 if content is None else len(data), "checksum": digest})
        if entries:
            yield full()

    kind = files.schema["file_id"].dataType.simpleString()
    return laid.mapInPandas(
        write,
        f"container_id string, block_no int, bytes binary, entries array<struct<file_id:{kind},path:string,tile_id:string,offset:int,length:int,checksum:string>>",
    )


def write_archive(files: DataFrame, folder: str, container: int = CONTAINER, block: int = BLOCK) -> DataFrame:
    """Write the archive of the files to a folder that does not hold one yet, and give its blocks."""
    # A row group a block: a reader seeks to the blocks it needs.
    pack(files, container, block).write.option("parquet.block.row.count.limit", 1).parquet(f"{folder}/blocks")
    blocks = files.sparkSession.read.parquet(f"{folder}/blocks")
    index(blocks).repartitionByRange("path").sortWithinPartitions("path", "file_id").write.parquet(f"{folder}/index")
    return blocks


def scratch_archive(files: DataFrame) -> DataFrame:
    """The blocks of an archive in the shared folder for tables between steps."""
    return write_archive(files, f"{checkpoint_dir(files.sparkSession)}/{uuid.uuid4().hex}")


def lookup(spark: SparkSession, folder: str, paths: list[str]) -> DataFrame:
    """file_id, path, tile_id, content, checksum_ok of the files with these paths. Reads the index's parts and the blocks that hold them."""
    where = spark.read.parquet(f"{folder}/index")
    blocks = spark.read.parquet(f"{folder}/blocks")
    if len(paths) > FILTERED:
        wanted = spark.createDataFrame([(p,) for p in sorted(set(paths))], "path string")
        return _cut_out(where.join(wanted, "path"), blocks)
    hits = cut(where.where(F.col("path").isin(sorted(set(paths)))))
    at = hits.select("container_id", "block_no").distinct().limit(FILTERED + 1).collect()
    if len(at) <= FILTERED:
        blocks = blocks.where(F.col("container_id").isin(sorted({r["container_id"] for r in at})) & F.col("block_no").isin(sorted({r["block_no"] for r in at})))
    return _cut_out(hits, blocks)


def _cut_out(entries: DataFrame, blocks: DataFrame) -> DataFrame:
    held = entries.join(blocks.select("container_id", "block_no", "bytes"), ["container_id", "block_no"])
    part = F.substring("bytes", F.col("offset") + 1, F.greatest("length", F.lit(0)))
    text = F.when(F.col("length") >= 0, F.decode(part, "UTF-8"))
    return held.select("file_id", "path", "tile_id", text.alias("content"), (F.sha2(part, 256) == F.col("checksum")).alias("checksum_ok"))


def index(blocks: DataFrame) -> DataFrame:
    """One row per file: where it lies and what it must hash to."""
    return blocks.select("container_id", "block_no", F.inline("entries"))


def read_back(blocks: DataFrame) -> DataFrame:
    """file_id, path, tile_id, content, checksum_ok: every file cut out of its block again."""
    kind = dict(blocks.select(F.inline("entries")).dtypes)["file_id"]

    def cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data, entries in zip(b["bytes"], b["entries"]):
                rows = []
                for e in entries:
                    part = data[e["offset"] : e["offset"] + max(0, e["length"])]
                    text = None if e["length"] < 0 else part.decode("utf-8", "surrogatepass")
                    rows.append((e["file_id"], e["path"], e["tile_id"], text, hashlib.sha256(part).hexdigest() == e["checksum"]))
                yield pd.DataFrame(rows, columns=["file_id", "path", "tile_id", "content", "checksum_ok"])

    return blocks.select("bytes", "entries").mapInPandas(cut_out, f"file_id {kind}, path string, tile_id string, content string, checksum_ok boolean")


def record_sets(archive: DataFrame) -> DataFrame:
    """file_id, tile_id, recs, fingerprint of every archived file with at least one record."""
    out = read_back(archive).select("file_id", "tile_id", records(F.col("content")).alias("recs")).where(F.size("recs") > 0)
    return out.withColumn("fingerprint", F.sha2(F.to_json("recs"), 256))


def same_records(archive: DataFrame, group: int = 4096) -> DataFrame:
    """Distinct (file_a, file_b), file_a < file_b, of one tile with the same non-empty set of records, as numbers.

    Groups of copies are salted when large: a group's rows are dealt over tasks
    on one side and sent to each of them on the other. Equal fingerprints are
    equal sets; the numbers themselves went into them.
    """
    s = cut(record_sets(archive).where(F.col("tile_id").isNotNull()).select("file_id", "tile_id", "fingerprint"))
    sizes = s.groupBy("tile_id", "fingerprint").count().where(F.col("count") > 1)
    s = s.join(sizes.select("tile_id", "fingerprint", F.ceil(F.col("count") / group).alias("salts")), ["tile_id", "fingerprint"])
    a = s.select("tile_id", "fingerprint", F.col("file_id").alias("file_a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    b = s.select("tile_id", "fingerprint", F.col("file_id").alias("file_b"), F.pmod(F.xxhash64("file_id"), "salts").alias("salt"))
    return a.join(b, ["tile_id", "fingerprint", "salt"]).where("file_a < file_b").select("file_a", "file_b").distinct()


def consolidated(archive: DataFrame) -> DataFrame:
    """tile_id, point_idx, x, y: each record of the archive exactly once.

    Whole copies of a file fall away by fingerprint before their records are
    unfolded; records that different files share fall away in the last step.
    """
    one = record_sets(archive).groupBy("tile_id", "fingerprint").agg(F.first("recs").alias("recs"))
    return one.select("tile_id", F.inline("recs")).distinct()
