"""Token files: frequency-ranked ids in byte-aligned variable-length code with separate control bytes.

A file holds whole documents in ascending id order: a header, the table rank -> token id, the documents' ids and
lengths, then all control bytes and all data bytes. A control byte names the lengths (1 to 4 bytes) of four ranks;
decoding looks the control bytes up in a table of 256 rows and gathers the data bytes with numpy.

Defined results: a null text is an empty text (only the end id); a null doc_id sorts first and comes back as null;
rows with one doc_id are separate documents, ordered by their ids; an empty table gives no file and no row; further
columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.llm import common, encode

MAGIC = b"RANKVB01"
#: Tokens that a file holds about (2 bytes or less each).
FILE_TOKENS = 8_000_000
#: Stands for a null doc_id inside a file.
NO_ID = -(2**63)
#: Lengths of the four codes that a control byte names.
LENGTHS = ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3) + 1


def pack(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of ranks (below 2**32)."""
    ranks = ranks.astype("<u4")
    codes = ((ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)).astype(np.uint8)
    padded = np.zeros(-(-len(codes) // 4) * 4, dtype=np.uint8)
    padded[: len(codes)] = codes
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= codes[:, None]]
    return control, data


def unpack(control: np.ndarray, data: np.ndarray, count: int) -> np.ndarray:
    lengths = LENGTHS[control].reshape(-1)[:count]
    ends = np.cumsum(lengths)
    starts = ends - lengths
    ranks = data[starts].astype(np.uint32)
    for place in range(1, 4):
        longer = np.flatnonzero(lengths > place)
        ranks[longer] |= data[starts[longer] + place].astype(np.uint32) << np.uint32(8 * place)
    return ranks


def to_file(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, rank_of: np.ndarray, id_of: np.ndarray) -> bytes:
    control, data = pack(rank_of[ids])
    head = np.array([len(id_of), len(doc_ids), len(ids), len(control), len(data)], dtype="<u8")
    parts = (id_of.astype("<u4"), doc_ids.astype("<i8"), counts.astype("<u8"), control, data)
    return b"".join([MAGIC, head.tobytes(), *(x.tobytes() for x in parts)])


def from_file(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents' ids, token counts and all token ids of a file."""
    if content[:8] != MAGIC:
        raise ValueError("no token file")
    n_ranks, n_docs, n_ids, n_control, n_data = np.frombuffer(content, "<u8", 5, 8).tolist()
    at, found = 48, []
    for kind, size in (("<u4", n_ranks), ("<i8", n_docs), ("<u8", n_docs), ("u1", n_control), ("u1", n_data)):
        found.append(np.frombuffer(content, kind, size, at))
        at += found[-1].nbytes
    id_of, doc_ids, counts, control, data = found
    return doc_ids, counts.astype(np.int64), id_of[unpack(control, data, n_ids)]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenize(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id and its token ids (two bytes each, end id included), stored once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], dtype="<u2").tobytes()
        for batch in common.slices(batches):
            bounds, ids = encode.encoder(path).encode(batch["text"])
            coded = [ids[a:b].tobytes() + end for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            counts = pa.array(np.diff(bounds) + 1, pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], counts, pa.array(coded, pa.binary())], ["doc_id", "n_tokens", "ids"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return common.store(narrow.mapInArrow(run, "doc_id long, n_tokens long, ids binary"), "tokens")


def ranks(tokens: DataFrame) -> np.ndarray:
    """Token ids from the most to the least frequent over all documents; at most 65,536, whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(65536, dtype=np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch["ids"].to_pylist()), "<u2"), minlength=65536)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["id", "n"])

    counted = tokens.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return np.array([r.id for r in counted.orderBy(F.desc("n"), "id").collect()], dtype=np.int64)


def _file_system(folder: str):
    from pyarrow import fs

    if "://" not in folder:
        folder = "file://" + folder.removeprefix("file:")
    return fs.FileSystem.from_uri(folder)


def write_files(tokens: DataFrame, folder: str, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write token files in ascending doc_id order; a row (file, n_tokens) for each. A task that runs twice writes the same file."""
    id_of = ranks(tokens)
    rank_of = np.zeros(65536, dtype=np.uint32)
    rank_of[id_of] = np.arange(len(id_of))
    system, root = _file_system(folder)
    system.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _file_system(folder)
        task = TaskContext.get()
        doc_ids, counts, ids = [], [], []
        for batch in batches:
            doc_ids.append(batch["doc_id"].fill_null(NO_ID).to_numpy())
            counts.append(batch["n_tokens"].to_numpy())
            ids.extend(np.frombuffer(x.as_buffer(), "<u2") for x in batch["ids"])
        if not ids:
            return
        ids = np.concatenate(ids)
        content = to_file(np.concatenate(doc_ids), np.concatenate(counts), ids, rank_of, id_of)
        name = f"{root}/part-{task.partitionId():08d}"
        with system.open_output_stream(f"{name}.try-{task.taskAttemptId()}") as out:
            out.write(content)
        system.move(f"{name}.try-{task.taskAttemptId()}", f"{name}.tok")
        yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int64()), pa.array([len(ids)], pa.int64())], ["file", "n_tokens"])

    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    spark = tokens.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // file_tokens))
    dealt = tokens.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "n_tokens", "ids")
    return common.store(dealt.mapInArrow(write, "file long, n_tokens long"), "token-files")


def read_files(spark, folder: str) -> DataFrame:
    """A row per document of the token files: file, doc_id, start within the file, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, content in zip(batch["file"].to_pylist(), batch["content"], strict=True):
                doc_ids, counts, ids = from_file(content.as_buffer().to_pybytes())
                ends = np.cumsum(counts)
                crcs = [_crc(ids[b - n : b]) for n, b in zip(counts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(doc_ids), number), pa.int64()),
                        pa.array(doc_ids, pa.int64(), mask=doc_ids == NO_ID),
                        pa.array(ends - counts, pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array(crcs, pa.int64()),
                    ],
                    ["file", "doc_id", "in_file", "n_tokens", "ids_crc32"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder)
    numbered = files.select(F.regexp_extract("path", r"part-(\d+)\.tok$", 1).cast("long").alias("file"), "content")
    return numbered.mapInArrow(read, "file long, doc_id long, in_file long, n_tokens long, ids_crc32 long")


def export(docs: DataFrame, folder: str, *, path: str | None = None, end_id: int = 1, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Tokenize, write the files, read them back: doc_id, start, n_tokens, ids_crc32, file."""
    spark = docs.sparkSession
    common.prepare(spark)
    tokens = tokenize(docs, path or encode.tokenizer_file(encode.WORD_FILE), end_id)
    written = write_files(tokens, folder, file_tokens)
    # one row per file of millions of tokens; the running sum over files is all that is kept in order
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = written.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("file_start"))
    found = read_files(spark, folder).join(starts, "file")
    return found.select("doc_id", (F.col("file_start") + F.col("in_file")).alias("start"), "n_tokens", "ids_crc32", "file")
