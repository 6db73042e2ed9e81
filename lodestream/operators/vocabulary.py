"""Vocabularies by frequency, encoding with a given vocabulary, and windows of a token stream."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions import text as X
from lodestream.operators.ordered import cumulative_frequencies
from lodestream.scratch import written

# The special tokens and their ids.
SPECIAL = {"<pad>": 0, "<bos>": 1, "<eos>": 2, "<unk>": 3}

#: How a text becomes tokens, by name.
SPLITTERS = {"char": X.characters, "word": X.tokens}


def splitter(name: str, lowercase: bool = False):
    """A function from a text column to its tokens, of the text in lower case if asked for. An unknown name is an error; ``bpe`` needs a
    given tokenizer file and is :func:`given_encoded`."""
    if name not in SPLITTERS:
        raise ValueError(f"unknown tokenizer {name!r}; there are {sorted(SPLITTERS)}")
    return (lambda text: SPLITTERS[name](F.lower(text))) if lowercase else SPLITTERS[name]


def given_encoded(df: DataFrame, key: str, text: str, tokenizer: str, lowercase: bool = False) -> DataFrame:
    """``key, ids`` by the tokenizer in ``tokenizer``, the content of a public tokenizer's JSON file (merges, vocabulary, normaliser).

    The file is read by the driver and sent to the tasks, so it is bounded by the vocabulary; texts are encoded a batch at a time, whole.
    Strings of special tokens are ordinary text. A null text has null ids, an empty one none. Nothing is trained.
    """
    kind = df.schema[key].dataType.simpleString()
    given = F.lower(text) if lowercase else F.col(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        coder = Tokenizer.from_str(tokenizer)
        coder.encode_special_tokens = True
        for b in batches:
            texts = b.column("text").to_pylist()
            found = iter(coder.encode_batch([t for t in texts if t is not None], add_special_tokens=False))
            ids = [None if t is None else next(found).ids for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    return df.select(key, given.alias("text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def given_decoded(df: DataFrame, key: str, ids: str, tokenizer: str) -> DataFrame:
    """``key, text``: the texts of the ids of :func:`given_encoded`; null for null."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        coder = Tokenizer.from_str(tokenizer)
        for b in batches:
            lists = b.column("ids").to_pylist()
            found = iter(coder.decode_batch([x for x in lists if x is not None], skip_special_tokens=False))
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array([None if x is None else next(found) for x in lists], pa.string())], names=[key, "text"])

    return df.select(key, F.col(ids).alias("ids")).mapInArrow(run, f"`{key}` {kind}, text string")


def frequent(df: DataFrame, key: str, tokens: Column, size: int) -> DataFrame:
    """``id, token, n``: the ``size`` - 4 most frequent tokens with ids from 4 on; of equally frequent ones the one that is seen first.

    A report of the top ``size``: counts are combined before the shuffle, the order is a top-k.
    """
    rows = df.select(F.col(key).alias("_k"), F.posexplode(tokens).alias("_p", "token"))
    counts = rows.groupBy("token").agg(F.count("*").alias("n"), F.min(F.struct("_k", "_p")).alias("_first"))
    top = counts.orderBy(F.col("n").desc(), "_first").limit(max(0, size - len(SPECIAL)))
    order = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("a"), "_first", "token", "n")))  # at most `size` entries
    return top.agg(order.alias("_l")).select(F.posexplode("_l").alias("_i", "_r")).select((F.col("_i") + len(SPECIAL)).alias("id"), "_r.token", "_r.n")


def encoded(df: DataFrame, key: str, tokens: Column, vocabulary: DataFrame, ends: bool = True) -> DataFrame:
    """``key, ids``: each token's id, 3 for unknown ones, between 1 and 2 if ``ends``. Null tokens give no ids.

    ``vocabulary`` (``id, token``) is read by the driver and sent to the tasks: it is bounded by the size it was made with.
    """
    rows = sorted((r["id"], r["token"]) for r in vocabulary.select("id", "token").collect())
    known, ids = pa.array([t for _, t in rows], pa.string()), np.array([i for i, _ in rows], np.int32)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("tokens")
            flat = pc.fill_null(pc.index_in(lists.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False)
            values = np.where(flat < 0, SPECIAL["<unk>"], ids[np.maximum(flat, 0)] if len(ids) else SPECIAL["<unk>"]).astype(np.int32)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            if ends:
                at = np.concatenate([[0], np.cumsum(sizes)])
                values = np.insert(values, np.stack([at[:-1], at[1:]], 1).ravel(), np.tile([SPECIAL["<bos>"], SPECIAL["<eos>"]], len(sizes)))
                sizes = sizes + 2
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=[key, "ids"])

    return df.select(key, tokens.alias("tokens")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decoded(df: DataFrame, key: str, ids: str, vocabulary: DataFrame) -> DataFrame:
    """``key, tokens``: the tokens of the ids; specials are dropped, and so is what the vocabulary doesn't have."""
    rows = df.select(F.col(key), F.posexplode(ids).alias("_p", "_i")).join(F.broadcast(vocabulary.select(F.col("id").alias("_i"), "token")), "_i")  # as large as the vocabulary
    found = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_p", "token"))).alias("_l"))  # one text's tokens
    out = df.select(key).join(found, key, "left")
    return out.select(key, F.coalesce(F.transform("_l", lambda x: x["token"]), F.array().cast("array<string>")).alias("tokens"))


def windows(df: DataFrame, key: str, ids: str, length: int) -> DataFrame:
    """``window, x, y``: the texts' ids in key order as one stream, cut every ``length``; ``y`` is ``x`` one token on. Only full windows.

    Offsets of the texts come from running totals of the distributed sort; a list holds ``length`` + 1 ids.
    """
    rows = written(df.select(F.col(key).alias("_k"), F.col(ids).alias("_ids"), F.size(ids).alias("_n")), "ids")
    offsets = cumulative_frequencies(rows, [], "_k", weight="_n").select("_k", "before")
    each = rows.join(offsets, "_k").select("before", F.posexplode("_ids").alias("_p", "_id"))
    at = F.col("before") + F.col("_p")
    whole = F.floor(at / length)
    mine = F.when((at % length == 0) & (at > 0), F.array(whole - 1, whole)).otherwise(F.array(whole))
    grouped = each.select(at.alias("_at"), "_id", F.explode(mine).alias("window")).groupBy("window").agg(F.sort_array(F.collect_list(F.struct("_at", "_id"))).alias("_l"))
    ids_ = F.transform("_l", lambda x: x["_id"])
    return grouped.where(F.size("_l") == length + 1).select("window", F.slice(ids_, 1, length).alias("x"), F.slice(ids_, 2, length).alias("y"))


def save(vocabulary: DataFrame, path: str, name: str, config: dict) -> None:
    """A vocabulary as parquet with its settings beside it."""
    vocabulary.write.mode("overwrite").parquet(f"{path}/tokens")
    vocabulary.sparkSession.createDataFrame([(json.dumps({"name": name, "config": config}),)], "value string").write.mode("overwrite").text(f"{path}/settings")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/tokens"), json.loads(spark.read.text(f"{path}/settings", wholetext=True).first()[0])
