"""Token ids, flat token files, and token counts from a scan for separators."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from candor.llm.runtime import fresh_path, lean, materialize, text_of
from candor.llm.textkit import pieces

VOCABULARY = "byte_bpe_50k"
END_OF_DOCUMENT = 50256


@lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY):
    """Encoder of a byte-level BPE vocabulary file, with the added tokens that the ``.json`` file of that name lists, if there is one.

    The rank file holds the same vocabulary as the ``.json`` file and gives the same ids (tests compare them); this reader of it
    takes about a quarter of the time.
    """
    import base64
    import json
    import os

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    added = {}
    if os.path.exists(described := f"{os.path.dirname(f.name)}/{vocabulary}.json"):
        with open(described, encoding="utf-8") as f:
            added = {t["content"]: t["id"] for t in json.load(f).get("added_tokens", [])}
    return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def encode(text: str | None, vocabulary: str = VOCABULARY, added: bool = False) -> np.ndarray:
    """Ids of a whole text as unsigned 32-bit integers; null or empty: none.

    With ``added``, the strings of added tokens in a text get their ids, as the tokenizer file has it; without, they are ordinary
    text, so no text can forge a separator.
    """
    if not text:
        return np.zeros(0, np.uint32)
    return encoder(vocabulary).encode_to_numpy(text, allowed_special="all" if added else set(), disallowed_special=()).astype(np.uint32, copy=False)


def write_token_files(docs: DataFrame, directory: str, separator: int = END_OF_DOCUMENT, vocabulary: str = VOCABULARY) -> DataFrame:
    """Write each partition of ``docs(doc_id, text)`` as one flat file of little-endian 16-bit ids, ``separator`` after each text.

    Returns ``path, ordinal, doc_id``: which document is the how-manieth of which file. ``directory`` must be reachable from all
    executors. A file is named by its task attempt, and only attempts whose rows are kept are named in the result, so a repeated
    or speculative task does no harm. The files hold no index.
    """
    if max(separator, encoder(vocabulary).n_vocab - 1) > 0xFFFF:
        raise ValueError("the files hold 16-bit ids")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, base = pafs.FileSystem.from_uri(directory)
        path = f"{base}/ids-{task.partitionId():06d}-{task.taskAttemptId()}.bin"
        sink, ordinal = None, 0
        end = np.array([separator], "<u2").tobytes()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in pieces(texts):
                if sink is None:
                    fs.create_dir(base, recursive=True)
                    sink = fs.open_output_stream(path)
                for text in texts.slice(a, b - a).to_pylist():
                    sink.write(encode(text, vocabulary).astype("<u2").tobytes() + end)
                n = b - a
                yield pa.record_batch([pa.array([f"{directory.rstrip('/')}/{path.rpartition('/')[2]}"] * n), pa.array(np.arange(ordinal, ordinal + n)), ids.slice(a, n)], ["path", "ordinal", "doc_id"])
                ordinal += n
        if sink is not None:
            sink.close()

    return docs.select(F.col("doc_id").cast("long"), text_of()).mapInArrow(run, "path string, ordinal long, doc_id long")


def scan_token_files(paths: DataFrame, separator: int = END_OF_DOCUMENT, block_ids: int = 1 << 20) -> DataFrame:
    """Documents in flat files of 16-bit ids: ``path, ordinal, start, n_tokens, terminated`` (without the separator).

    ``paths(path)`` names the files. Each is read in blocks of ``block_ids`` ids by as many tasks as there are blocks. A block
    reports where its separators stand, found by one vectorised comparison; a document that crosses blocks gets its start from a
    prefix scan over blocks (count and last separator so far). An empty file has no documents. Ids after the last separator are
    one more document with ``terminated`` false; an odd last byte is an error.
    """

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        for batch in batches:
            rows: list[tuple[str, int, int]] = []
            for path in batch.column(0).to_pylist():
                fs, p = pafs.FileSystem.from_uri(path)
                n, odd = divmod(fs.get_file_info(p).size, 2)
                if odd:
                    raise ValueError(f"{path}: not a whole number of ids")
                rows += [(path, k, n) for k in range(-(-n // block_ids))]
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(list(zip(*rows, strict=True)) or [[], [], []], (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "block", "n_ids"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        for batch in batches:
            for path, block, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, p = pafs.FileSystem.from_uri(path)
                first, last = block * block_ids, min(n, (block + 1) * block_ids)
                with fs.open_input_file(p) as f:
                    got = np.frombuffer(f.read_at(2 * (last - first), 2 * first), "<u2")
                ends = np.flatnonzero(got == separator) + first
                closed = np.ones(len(ends), bool)
                if last == n and (not len(got) or got[-1] != separator):
                    ends, closed = np.append(ends, n), np.append(closed, False)
                if len(ends):
                    starts = pa.array(np.concatenate([[0], ends[:-1] + 1]), mask=np.arange(len(ends)) == 0)
                    yield pa.record_batch([pa.array([path] * len(ends)), pa.array(np.full(len(ends), block)), pa.array(np.arange(len(ends))), starts, pa.array(ends), pa.array(closed)], ["path", "block", "nth", "from_id", "end", "terminated"])

    blocks = paths.select("path").distinct().mapInArrow(sizes, "path string, block long, n_ids long")
    found = blocks.repartition("path", "block").mapInArrow(scan, "path string, block long, nth long, from_id long, end long, terminated boolean")
    found = materialize(found, "separators")
    so_far = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitch = found.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"), F.max("end").alias("last"))
    stitch = stitch.select("path", "block", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("base"), F.coalesce(F.max("last").over(so_far) + 1, F.lit(0)).alias("carry"))
    start = F.coalesce("from_id", "carry")
    return found.join(stitch, ["path", "block"]).select("path", (F.col("base") + F.col("nth")).alias("ordinal"), start.alias("start"), (F.col("end") - start).alias("n_tokens"), "terminated")


def token_counts(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``doc_id, n_tokens`` of each row of ``docs``: written as flat files, counted by scanning them.

    Null and empty texts have 0 tokens; a repeated row is counted once more; other columns are not read.
    """
    index = materialize(write_token_files(docs, fresh_path(spark, "token-files")), "token-index")
    counted = scan_token_files(index.select("path"))
    return index.join(counted, ["path", "ordinal"]).select("doc_id", "n_tokens")
