"""Best-fit packing into sequences, certified by lower bounds.

Documents become pieces of at most ``LENGTH`` tokens. Pieces are dealt to parts of bounded size and
packed there by best-fit decreasing. Dual feasible functions give a lower bound on the sequences a
part needs. A part that meets its bound is certified and stays. The other parts give up their
sequences that are not full: these pieces are exchanged, that is dealt to new, larger parts, and
packed again. A repacking counts only where it needs fewer sequences.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloop.llm.common import rows_of, texts, written
from flowloop.llm.word_bpe import loaded

LENGTH = 2048
# Pieces of one part in the first round, about; each round's parts are twice as large.
PART = 4096
ROUNDS = 4
# A part is certified if it uses no more than this above its need. Whole sequences would be too
# coarse: the half sequence that each part wastes by rounding adds up over many parts.
GAP = 0.05

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """The pieces of every text's ids, an id 0 after them. An empty text is the piece of that 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer)
        for batch in batches:
            rows = list(rows_of(iter([batch]), "doc_id", "text"))
            out = []
            for (doc_id, _), ids in zip(rows, bpe.encode([text for _, text in rows])):
                ids += bytes(4)
                for piece, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    out.append((doc_id, piece, piece * length, len(part) // 4, zlib.crc32(part)))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
            if out:
                yield pa.RecordBatch.from_arrays(columns, names=names)

    docs = texts(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return docs.mapInArrow(run, PIECES)


def need(sizes: np.ndarray, length: int = LENGTH) -> float:
    """The sequences that sizes need, as the dual feasible functions of every threshold bound it.

    For a threshold ``t`` up to half the length: sizes above ``length - t`` count as whole
    sequences, sizes below ``t`` as nothing, the rest as their share of one.
    """
    counts = np.bincount(sizes, minlength=length + 1).astype(np.int64)
    volume = np.cumsum(counts * np.arange(length + 1))
    number = np.cumsum(counts)
    t = np.arange(0, length // 2 + 1)
    large = number[length] - number[length - t]
    below = np.where(t > 0, volume[np.maximum(t - 1, 0)], 0)
    return float((large + (volume[length - t] - below) / length).max())


def lower_bound(sizes: np.ndarray, length: int = LENGTH) -> int:
    """No packing of ``sizes`` has fewer sequences."""
    return int(np.ceil(need(sizes, length) - 1e-9))


def best_fit_decreasing(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each size; bins are counted from 0."""
    bins = np.zeros(len(sizes), dtype=np.int64)
    offsets = np.zeros(len(sizes), dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(length + 1)]  # by the room that is left
    rooms = 0  # bit r: some bin has r tokens of room
    used = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            chosen = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            room, chosen = length, used
            used += 1
        bins[i], offsets[i] = chosen, length - room
        left = room - size
        if left:
            open_bins[left].append(chosen)
            rooms |= 1 << left
    return bins, offsets


def _repacked(length: int, final: bool):
    """Pack a part anew, keep its earlier sequences if that is no gain, and mark what may move."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        # A repeated task must deal equal sizes alike.
        part = part.sort_values("uid").reset_index(drop=True)
        sizes = part["length"].to_numpy()
        bins, offsets = best_fit_decreasing(sizes, length)
        if (part["bin"] < 0).all() or bins.max() + 1 < part["bin"].nunique():
            # The piece at offset 0 names its sequence.
            names = np.zeros(bins.max() + 1, dtype=np.int64)
            names[bins[offsets == 0]] = part["uid"].to_numpy()[offsets == 0]
            part["bin"], part["offset"] = names[bins], offsets
        gap = part["bin"].nunique() - need(sizes, length) > GAP
        filled = part.groupby("bin")["length"].transform("sum")
        part["moves"] = (filled < length) & (gap and not final)
        return part.drop(columns="part")

    return run


def packed(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """``rows`` of pieces with ``sequence_id`` and ``offset``; sequences have no gaps."""
    state = f"{PIECES}, uid bigint, bin bigint, offset bigint, moves boolean"
    rows = written(rows.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    columns = [*rows.columns, "bin", "offset", "moves"]
    moving = rows.withColumns(
        {"bin": F.lit(-1).cast("bigint"), "offset": F.lit(0).cast("bigint"), "moves": F.lit(True)}
    )
    settled: list[DataFrame] = []
    for attempt in range(ROUNDS):
        left = moving.count()
        if not left:
            break
        parts = max(1, round(left / (PART << attempt)))
        final = attempt == ROUNDS - 1 or parts == 1
        # A first deal is by piece, a later one by sequence, which moves as a whole.
        key = F.when(F.col("bin") < 0, F.xxhash64("uid", F.lit(attempt))).otherwise(
            F.xxhash64("bin", F.lit(attempt))
        )
        dealt = moving.withColumn("part", F.pmod(key, F.lit(parts)))
        done = dealt.groupBy("part").applyInPandas(_repacked(length, final), state).select(*columns)
        done = written(done, "packed")
        settled.append(done.filter(~F.col("moves")))
        moving = done.filter("moves")
        if final:
            break
    if not settled:
        settled = [moving]
    out = settled[0]
    for more in settled[1:]:
        out = out.union(more)
    named = F.col("bin").alias("sequence_id")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", named, "offset")


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """Every document's pieces with their place in the sequences.

    A null text is an empty one and takes one token. Repeated rows are packed each, null ids too.
    Ties among equal sizes are settled by id. An empty table gives no rows.
    """
    return packed(pieces(docs, tokenizer, length), length)
