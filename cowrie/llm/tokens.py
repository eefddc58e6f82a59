"""Problem 8: encoding a corpus with a public byte-level BPE tokenizer.

Method: overlapping chunk encoding. Texts longer than `chunk` are cut into overlapping chunks that are
pre-tokenised in parallel. From a pre-token boundary on, pre-tokens depend only on the text that follows, so
the first boundary that two neighbouring chunks share in their overlap is a true one: the chunks are stitched
there, and where none is shared the piece goes on into the next chunk. The pieces between the stitches are
encoded on their own. Decoding concatenates the tokens' raw bytes.

Scale: chunks of a long text are spread over all tasks, pre-tokenised there, and only the lists of boundaries within
overlaps come together by text; the pieces are spread again, by text and piece, and encoded in as many tasks. Texts up
to `chunk` are encoded where they are read, without a shuffle.

Defined results: null and empty texts give an empty list of ids; whitespace is text; strings of special tokens
are ordinary text; every row of the input gives one row, repeated keys included; further columns are dropped.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cowrie.functions.tokenizer import FOLDER, PATTERN, VOCABULARY, encoder, token_count
from cowrie.session import cut, partitions, slots, spread

@functools.lru_cache(maxsize=1)
def _pattern():
    import regex

    return regex.compile(PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def encode(text: str | None, path: str) -> list[int]:
    """Ids of one text; empty for null and empty."""
    return encoder(path).encode_ordinary(text) if text else []


def decode(ids: list[int], path: str) -> str:
    """The text of ids: the tokens' bytes in a row, read as UTF-8."""
    one = encoder(path)
    return b"".join(one.decode_single_token_bytes(int(i)) for i in ids).decode("utf-8", errors="replace")


def boundaries(text: str, final: bool) -> list[int]:
    """Offsets at which pre-tokens end and a piece may end: not after a blank, as how a run of blanks splits
    depends on what follows it. Unless the text ends here, those that its end may have made are left out: the
    last pre-token's, and the one before it, whose look-ahead may have met the end."""
    ends = [m.end() for m in _pattern().finditer(text)]
    return [b for b in (ends if final else ends[:-2]) if not text[b - 1].isspace()]


def _ids_udf(path: str):
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = encoder(path)
        for texts in parts:
            yield pd.Series([np.asarray(one.encode_ordinary(t), dtype=np.int32) if t else np.zeros(0, np.int32) for t in texts], index=texts.index, dtype=object)

    return ids


def _chunks(df: DataFrame, text: str, keys: list[str], chunk: int, overlap: int) -> DataFrame:
    """(keys..., _no, _last, _part): overlapping chunks of df's texts, each once, spread over tasks by row and number."""
    flat = df.select(*keys, F.col(text).alias("_text"))
    schema = T.StructType([*flat.schema.fields[:-1], T.StructField("_no", T.IntegerType()), T.StructField("_last", T.BooleanType()), T.StructField("_part", T.StringType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for i in range(len(pdf)):
                row = pdf.iloc[[i]]
                body = row["_text"].iloc[0]
                starts = range(0, len(body), chunk)
                for at in range(0, len(starts), 256):  # a text's chunks leave in bounded batches
                    some = starts[at : at + 256]
                    out = row[keys].loc[row.index.repeat(len(some))].reset_index(drop=True)
                    yield out.assign(_no=np.arange(at, at + len(some), dtype=np.int32), _last=[s + chunk >= len(body) for s in some], _part=[body[s : s + chunk + overlap] for s in some])

    return flat.mapInPandas(run, schema).repartition(partitions(df, slots(df.sparkSession)), keys[-1], "_no")


def pieces(df: DataFrame, text: str, keys: list[str], chunk: int, overlap: int) -> DataFrame:
    """(keys..., piece, text): texts cut at true pre-token boundaries, about `chunk` characters each, spread over tasks
    by text and piece. The last of keys is a number of its own for each row and not null."""
    row = keys[-1]
    chunks = cut(_chunks(df, text, keys, chunk, overlap), "chunks")

    @F.pandas_udf("head array<int>, tail array<int>, sure array<int>, length int")
    def ends(parts: pd.Series, last: pd.Series) -> pd.DataFrame:
        heads, tails, sure = [], [], []
        for part, final in zip(parts, last, strict=True):
            at = np.asarray(boundaries(part, final), dtype=np.int64)
            heads.append(at[at < overlap].astype(np.int32))
            tail = (at[(at >= chunk) & (at < chunk + overlap)] - chunk).astype(np.int32)
            tails.append(tail)
            sure.append([int(b) for b in tail if chunk + b < len(part) and part[chunk + b].isspace()])
        return pd.DataFrame({"head": heads, "tail": tails, "sure": sure, "length": [len(p) for p in parts]})

    # offsets within an overlap, counted from the start of the later chunk, in both lists; the texts stay where they are
    lists = chunks.select(row, "_no", "_last", ends("_part", "_last").alias("_ends")).select(row, "_no", "_last", "_ends.*")
    order = Window.partitionBy(row).orderBy("_no")

    def shared(tail: str) -> Column:
        return F.when(F.col("_no") == 0, 0).otherwise(F.array_min(F.array_intersect(F.lag(tail).over(order), F.col("head"))))

    # A shared boundary is true if the earlier chunk is itself in step. Where a chain of steps breaks in a text,
    # only ends of words before a blank are used there: they are boundaries in any reading.
    lists = lists.withColumns({"_sync": shared("tail"), "_sure": shared("sure")})
    broken = F.max(F.col("_sync").isNull()).over(Window.partitionBy(row))
    lists = lists.withColumn("_sync", F.when(broken, F.col("_sure")).otherwise(F.col("_sync")))
    lists = lists.withColumn("_next", F.lead("_sync").over(order)).withColumn("piece", F.last(F.when(F.col("_sync").isNotNull(), F.col("_no")), ignorenulls=True).over(order))
    begin = F.coalesce("_sync", F.lit(0))
    end = F.when(F.col("_last"), F.col("length")).otherwise(F.lit(chunk) + F.coalesce("_next", F.lit(0)))
    where = lists.select(row, "_no", "piece", begin.alias("_begin"), (end - begin).alias("_take"))
    rows = chunks.join(where, [row, "_no"]).select(*keys, "piece", "_no", F.substring(F.col("_part"), F.col("_begin") + 1, F.col("_take")).alias("_cut"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_no", "_cut"))), lambda x: x["_cut"]), "")
    return rows.repartition(partitions(df, slots(df.sparkSession)), *keys, "piece").groupBy(*keys, "piece").agg(joined.alias("text"))


def _long_and_short(df: DataFrame, key: str, text: str, chunk: int) -> tuple[DataFrame, DataFrame]:
    flat = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("_text"))
    return flat.where(F.length("_text") > chunk), flat.where(F.col("_text").isNull() | (F.length("_text") <= chunk))


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, chunk: int = 8192, overlap: int = 512) -> DataFrame:
    """(key, ids) for every row of df."""
    path = path or f"{FOLDER}/{VOCABULARY}"
    long, short = _long_and_short(spread(df), key, text, chunk)
    ids = _ids_udf(path)
    long = long.withColumn("_row", F.monotonically_increasing_id())  # repeated and null keys stay apart
    parts = pieces(long, "_text", [key, "_row"], chunk, overlap).withColumn("_ids", ids("text"))
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece", "_ids"))), lambda x: x["_ids"]))
    return short.select(key, ids("_text").alias("ids")).unionByName(parts.groupBy(key, "_row").agg(whole.alias("ids")).select(key, "ids"))


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, path: str | None = None, chunk: int = 8192, overlap: int = 512) -> DataFrame:
    """(key, keep..., tokens) for every row of df, by the same stitched encoding; only counts leave the workers."""
    path, keep = path or f"{FOLDER}/{VOCABULARY}", keep or []
    flat = spread(df).select(F.col(f"`{key}`").alias(key), *[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text"))
    long = flat.where(F.length("_text") > chunk).withColumn("_row", F.monotonically_increasing_id())
    short = flat.where(F.col("_text").isNull() | (F.length("_text") <= chunk))
    parts = pieces(long, "_text", [key, *keep, "_row"], chunk, overlap).withColumn("tokens", token_count(F.col("text"), path))
    return short.select(key, *keep, token_count(F.col("_text"), path).cast("long").alias("tokens")).unionByName(parts.groupBy(key, *keep, "_row").agg(F.sum("tokens").alias("tokens")).select(key, *keep, "tokens"))


def decode_column(ids: Column, path: str | None = None) -> Column:
    """Texts of id lists."""
    path = path or f"{FOLDER}/{VOCABULARY}"

    @F.pandas_udf(T.StringType())
    def text(parts: pd.Series) -> pd.Series:
        return parts.map(lambda x: decode(x, path), na_action="ignore")

    return text(ids)
