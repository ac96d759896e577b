"""Token counts by a separator scan over flat token files.

The files hold nothing but token ids of one width, end to end, with the end-of-document id after each document: no index. They are
read in blocks, in any order, by any task. A block is searched for the separator in one vector operation; what it yields is
the length of each document that ends in it and the tokens it leaves open. A document may cross any number of
blocks, so an exclusive prefix scan over the blocks of a file carries the open tokens on, restarting where a block
holds a separator. The carry is a segmented sum: it goes over one small row a block, not over tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.taskcontext import TaskContext

from .common import table, written

BLOCK_TOKENS = 1 << 18
#: The id that ends a document, free in the vocabulary, and the width of the ids on file.
EOD, WIDTH = 50256, "<u2"
VOCABULARY = "byte_bpe_50k.tiktoken"


def encoder(path: str | None = None) -> tiktoken.Encoding:
    """The public byte-level vocabulary at `path` (by default where the tokenizer package keeps it)."""
    import public_tokenizers

    with open(path or public_tokenizers.path(VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pack(batches: Iterator[pd.DataFrame], path: str | None, block: int) -> Iterator[pd.DataFrame]:
    """doc_id, text -> blocks (file, block, tokens, doc_ids): one flat file a task, cut every `block` tokens wherever that falls.

    doc_ids lists the documents that end in the block, in order: names only, no places.
    """
    encoding, context = encoder(path), TaskContext.get()
    file, number = context.partitionId() if context else 0, 0
    open_parts: list[np.ndarray] = []
    held, ends, ids = 0, [], []

    def cut(size: int) -> pd.DataFrame:
        nonlocal open_parts, held, ends, ids, number
        flat = np.concatenate(open_parts) if open_parts else np.empty(0, WIDTH)
        done = sum(e < size for e in ends)
        row = pd.DataFrame({"file": [file], "block": [number], "tokens": [flat[:size].tobytes()], "doc_ids": [ids[:done]]})
        open_parts, held, number = [flat[size:]], len(flat) - size, number + 1
        ends, ids = [e - size for e in ends[done:]], ids[done:]
        return row

    for batch in batches:
        for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
            found = np.array([*encoding.encode_ordinary(text or ""), EOD], WIDTH)
            open_parts.append(found)
            held += len(found)
            ends.append(held - 1)
            ids.append(None if pd.isna(doc) else int(doc))
            while held >= block:
                yield cut(block)
    if held:
        yield cut(held)


def scan(batches: Iterator[pd.DataFrame], eod: int, width: str) -> Iterator[pd.DataFrame]:
    """Per block: lengths of the documents that end in it (the first without what earlier blocks hold) and the tokens left open."""
    for batch in batches:
        lengths, left = [], []
        for raw in batch["tokens"]:
            tokens = np.frombuffer(raw, width)
            at = np.flatnonzero(tokens == eod)
            lengths.append(np.diff(at, prepend=-1) - 1)
            left.append(len(tokens) - 1 - at[-1] if len(at) else len(tokens))
        yield pd.DataFrame({"file": batch["file"], "block": batch["block"], "lengths": lengths, "open": left, "doc_ids": batch["doc_ids"]})


def counts(blocks: DataFrame, eod: int = EOD, width: str = WIDTH) -> DataFrame:
    """Token count of each document of flat files given as blocks (file, block, tokens, doc_ids).

    Returns file, ordinal (from 0 in each file), doc_id, n_tokens, and how many blocks the document touches. Empty documents count 0.
    Tokens after the last separator of a file belong to no document and are left out.
    """
    made = "file long, block long, lengths array<long>, open long, doc_ids array<long>"
    found = written(blocks.select("file", "block", "tokens", "doc_ids").mapInPandas(lambda b: scan(b, eod, width), made))
    by_file = Window.partitionBy("file").orderBy("block")
    upto, before = by_file.rowsBetween(Window.unboundedPreceding, Window.currentRow), by_file.rowsBetween(Window.unboundedPreceding, -1)
    light = found.select("file", "block", F.size("lengths").cast("long").alias("n"), "open", F.lag("open").over(by_file).alias("was_open"), F.lag(F.size("lengths")).over(by_file).alias("had"))
    # a segment starts after each block with a separator: its first carry is what that block left open
    light = light.withColumn("start", (F.coalesce(F.col("had"), F.lit(1)) > 0).cast("long"))
    light = light.withColumn("segment", F.sum("start").over(upto)).withColumn("ordinal0", F.coalesce(F.sum("n").over(before), F.lit(0)))
    in_segment = Window.partitionBy("file", "segment").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = light.withColumn("carry", F.sum(F.coalesce("was_open", F.lit(0))).over(in_segment)).withColumn("crossed", F.row_number().over(Window.partitionBy("file", "segment").orderBy("block")))
    met = found.select("file", "block", "lengths", "doc_ids").join(carried.select("file", "block", "carry", "ordinal0", "crossed"), ["file", "block"])
    each = met.select("file", "carry", "ordinal0", "crossed", "doc_ids", F.posexplode("lengths").alias("i", "own"))
    first = F.col("i") == 0
    return each.select(
        "file", (F.col("ordinal0") + F.col("i")).alias("ordinal"), F.get("doc_ids", F.col("i")).alias("doc_id"),
        (F.col("own") + F.when(first, F.col("carry")).otherwise(0)).alias("n_tokens"),
        F.when(first & (F.col("carry") > 0), F.col("crossed")).otherwise(1).cast("long").alias("n_blocks"),
    )


def pack_documents(docs: DataFrame, path: str | None = None, block: int = BLOCK_TOKENS) -> DataFrame:
    """Flat token files of doc_id, text, as blocks kept in the shared checkpoint folder. Null texts are empty documents."""
    held = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return written(held.mapInPandas(lambda b: pack(b, path, block), "file long, block long, tokens binary, doc_ids array<long>"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, found in the flat files that hold the whole table."""
    return counts(pack_documents(table(spark, sf_dir, "documents"))).select("doc_id", "n_tokens", "file", "ordinal", "n_blocks")
