"""Blocks of documents and shards of keys: how operators look up corpus-wide facts without a row for each word.

A block is a bounded set of documents, chosen by a hash of their ids. A task that holds a block sums up what it has
and sends each shard of the key space one small binary; a task that holds a shard merges what all blocks have sent and
answers each with one binary, in the order that the block can work out again. So a key that occurs in every document
costs one entry for each block, however many documents have it, and no task sees more than one block or one shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_BLOCKS, MAX_BLOCKS = 32, 1 << 15


def text_size(docs: DataFrame, text: str = "text") -> int:
    """Characters in all texts: one pass that reads this column only."""
    return docs.agg(F.sum(F.length(text)).alias("n")).first()["n"] or 0


def block_count(chars: int, block_chars: int) -> int:
    """Blocks of about block_chars characters; beyond MAX_BLOCKS blocks grow instead."""
    return max(MIN_BLOCKS, min(MAX_BLOCKS, -(-chars // block_chars)))


def in_blocks(docs: DataFrame, blocks: int, key: str, text: str) -> DataFrame:
    """(block, key, text), dealt by block: by key and text, so that rows without a key or with the same one spread."""
    block = F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(blocks)).cast("int")
    return docs.select(block.alias("block"), F.col(key).alias("key"), F.col(text).alias("text")).repartition("block")
