"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints of 64 bits are cut into ``BLOCKS`` blocks. Two that differ in ``DISTANCE`` bits agree
on ``BLOCKS - DISTANCE`` whole blocks at least, so every close pair shares one of the keys made of
that many blocks. Fingerprints meet by key and their Hamming distance is verified.

Only distinct fingerprints meet: copies never multiply pairs. A key with more than ``BUCKET``
fingerprints is not paired. There, each fingerprint names itself and every value one flipped bit
away within the key's free bits; two that name one value differ in two bits at most, and two that
differ in two bits at most name one value. At most 23 fingerprints can name a value, and each is
linked to the smallest of them: as many rows as fingerprints, with the same components.
"""

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloop.llm.common import rows_of, texts, written
from flowloop.llm.components import connected_components

SHINGLE = 3
DISTANCE = 2
BLOCKS = 6
BUCKET = 32
SEED = 42


def simhash(text: str, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text; 0 for one without words."""
    # On bytes, lower() changes A-Z alone and split() cuts at the six ASCII spaces.
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: -shingle].tolist()] if len(words) >= shingle else [0]
    stops = (ends[shingle - 1 :] - 1).tolist() if len(words) >= shingle else [len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        octets = hashes[at : at + 4096].view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(octets, axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def simhashes(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, hash, fp)``: the xxhash64 and the fingerprint of every text as signed longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array(
                [simhash(text, shingle) for (text,) in rows_of(iter([batch]), "text")], dtype="<u8"
            )
            columns = [batch.column("doc_id"), batch.column("hash"), pa.array(values.view("<i8"))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "hash", "fp"])

    rows = texts(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id bigint, hash bigint, fp bigint")


def _masks() -> list[int]:
    """For each choice of agreeing blocks, the bits of the blocks as a signed long."""
    cuts = [round(64 * i / BLOCKS) for i in range(BLOCKS + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    masks = [sum(chosen) for chosen in combinations(blocks, BLOCKS - DISTANCE)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def close_links(fps: DataFrame) -> DataFrame:
    """Links ``(u, v)`` that connect all of the distinct ``fp`` within ``DISTANCE`` bits."""
    masks = [
        F.struct(F.lit(i).alias("mask"), F.lit(m).alias("bits")) for i, m in enumerate(_masks())
    ]
    keyed = fps.select("fp", F.inline(F.array(*masks))).select(
        "mask", F.col("fp").bitwiseAND(F.col("bits")).alias("block"), "fp"
    )
    # Counts are combined before their shuffle, and the join can split a block that is hot.
    sizes = keyed.groupBy("mask", "block").agg(F.count("*").alias("size")).filter("size > 1")
    sizes = written(sizes, "block_sizes")
    met = written(keyed.join(sizes, ["mask", "block"]), "blocks")

    few = met.filter(F.col("size") <= BUCKET)
    left = few.select("mask", "block", F.col("fp").alias("u"))
    right = few.select("mask", "block", F.col("fp").alias("v"))
    pairs = left.join(right, ["mask", "block"]).filter("u < v")
    pairs = pairs.filter(_distance("u", "v") <= DISTANCE).select("u", "v")

    many = met.filter(F.col("size") > BUCKET)
    free = F.element_at(F.array(*[F.array(*_flips(m)) for m in _masks()]), F.col("mask") + 1)
    values = F.transform(free, lambda bit: bit.bitwiseXOR(F.col("fp")))
    named = many.select("mask", "fp", F.explode(values).alias("value"))
    least = F.min("fp").over(Window.partitionBy("mask", "value"))
    stars = named.select(F.col("fp").alias("u"), least.alias("v")).filter("u != v")
    return pairs.union(stars).distinct()


def _flips(mask: int) -> list[Column]:
    """Nothing, and every single bit outside ``mask``."""
    free = [1 << i for i in range(64) if not mask >> i & 1]
    return [F.lit(0).cast("bigint")] + [F.lit(b - (1 << 64) if b >> 63 else b) for b in free]


def components(docs: DataFrame) -> DataFrame:
    """``(doc_id, hash, fp, home, component_id)`` for every row.

    ``home`` is the fingerprint that stands for the component, ``component_id`` its smallest id.
    """
    return named(written(simhashes(docs), "simhashes"), close_links)


def named(prints: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``prints(doc_id, hash, fp)`` with the components that ``links`` makes of distinct ``fp``."""
    fps = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    nodes = connected_components(links(fps.select("fp")))
    # Only linked fingerprints are in a component of more than one.
    linked = fps.join(nodes, fps.fp == nodes.node, "left")
    homes = linked.select("fp", F.coalesce("component", "fp").alias("home"), "least")
    homes = written(homes, "component_homes")
    named = homes.groupBy("home").agg(F.min("least").alias("component_id"))
    named = written(named, "component_ids")
    names = written(homes.select("fp", "home").join(named, "home"), "component_names")
    return prints.join(names, "fp").select("doc_id", "hash", "fp", "home", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row.

    A null text is an empty one; texts without words have fingerprint 0 and link like any other.
    Rows whose fingerprints are equal are in one component, which the smallest ``doc_id`` names.
    Null ids are kept and name a component only if it has no other; repeated rows each appear. An
    empty table gives no rows.
    """
    fingerprint = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return components(docs).select("doc_id", fingerprint, "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """``(doc_id, hash)`` of one row for each component: that of the smallest id.

    Where an id repeats within a component, the row with the smallest ``hash`` of its text.
    """
    return first_rows(components(docs))


def first_rows(grouped: DataFrame) -> DataFrame:
    first = grouped.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return first.groupBy("doc_id", "home").agg(F.min("hash").alias("hash")).select("doc_id", "hash")
