"""Hard negatives by inner products, with buckets of like length and coordinate pruning.

Rows are ordered by label and falling length and cut into buckets. A bucket holds, for every
coordinate, its rows sorted by that coordinate of their directions. For an anchor and the least
score that still matters, the longest row of a bucket gives the least cosine that matters there.
Each of the anchor's largest coordinates, the focus, then bounds the values that a direction of
that cosine can have; the sorted lists give the rows between the bounds, the intersection of a few
lists the candidates, and exact integer products decide. The least score rises with every bucket
that a task has looked at, as the best rows so far are known.

Buckets meet anchors in blocks: the anchors of one bucket are a block. Positives are looked for in
buckets that share a label with the block. Negatives can be anywhere, so every cell of buckets reads
all blocks. What a block and a bucket find is a few rows for each anchor.
"""

from collections import OrderedDict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloop.llm.common import BATCH_ROWS, written

SCALE = 256
ANCHORS = 50
POSITIVES = 5
NEGATIVES = 3
# Rows of a bucket at most; positions in its lists fit into 16 bits.
BUCKET = 4096
# Coordinates of an anchor that bound its candidates.
FOCUS = 6
# Blocks and buckets are rows of about a megabyte: a task gets few at once.
PAIR_ROWS = 8
# Blocks whose best scores so far a task remembers, and buckets that it keeps unpacked.
BLOCKS_REMEMBERED = 1024
BUCKETS_UNPACKED = 8
# More than rounding can add to a bound.
SLACK = 1e-9

_MEMBERS = "uids binary, ids binary, named binary, labels binary, width int, kind string, v binary"
BUCKETS = f"bucket bigint, label_set array<bigint>, {_MEMBERS}, lists binary"
BLOCKS = f"bucket bigint, label_set array<bigint>, {_MEMBERS}"


class Members(NamedTuple):
    """Rows of a bucket or block; ``named`` tells which have an id."""

    uids: np.ndarray
    ids: np.ndarray
    named: np.ndarray
    labels: np.ndarray
    v: np.ndarray

    def some(self, which: np.ndarray) -> "Members":
        return Members(*(a[which] for a in self))


def vectors(embeddings: DataFrame, scale: int = SCALE, changed: Column | None = None) -> DataFrame:
    """``(uid, vec_id, label, v, squares)`` of every row that takes part, written once.

    ``v`` are the components times ``scale``, rounded down. Rows without a label, without a vector,
    or with a component that is null or not finite take no part. ``changed`` replaces the label.
    """
    finite = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    rows = embeddings.filter(
        F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite
    ).select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        (F.col("label") if changed is None else changed).cast("bigint").alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"),
    )
    squares = F.aggregate(
        "v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")
    )
    rows = rows.select(F.monotonically_increasing_id().alias("uid"), "*", squares.alias("squares"))
    return written(rows, "vectors")


def _packed(members: Members) -> dict:
    top = int(np.abs(members.v).max(initial=0))
    kind = next(k for k in ("<i2", "<i4", "<i8") if top <= np.iinfo(k).max)
    return {
        "uids": members.uids.tobytes(),
        "ids": members.ids.tobytes(),
        "named": members.named.tobytes(),
        "labels": members.labels.tobytes(),
        "width": members.v.shape[1],
        "kind": kind,
        "v": np.ascontiguousarray(members.v, dtype=kind).tobytes(),
    }


def _unpacked(row: dict) -> Members:
    uids, ids, labels = (np.frombuffer(row[n], dtype="<i8") for n in ("uids", "ids", "labels"))
    v = np.frombuffer(row["v"], dtype=row["kind"]).reshape(len(uids), row["width"])
    return Members(uids, ids, np.frombuffer(row["named"], dtype=bool), labels, v)


def _directions(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
    return v / np.where(lengths > 0, lengths, 1)[:, None], lengths


def _members(batches: list[pa.RecordBatch]) -> Members:
    table = pa.Table.from_batches(batches).combine_chunks()
    lists = table.column("v").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    # Vectors of another width are filled up with zeros.
    v = np.zeros((len(sizes), int(sizes.max(initial=0))), dtype=np.int64)
    v[np.arange(v.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy()
    ids = table.column("vec_id")
    return Members(
        table.column("uid").to_numpy(),
        ids.fill_null(np.iinfo(np.int64).max).to_numpy(),
        ~np.asarray(ids.is_null()),
        table.column("label").to_numpy(),
        v,
    )


def buckets_of(rows: DataFrame, size: int = BUCKET) -> DataFrame:
    """Rows by label and falling length in buckets with sorted lists. Rows that are alike in both
    are spread like any others, so a label or a vector with many rows fills many buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        number = 0
        for held in _cut(batches, size):
            members = _members(held)
            directions, _ = _directions(members.v)
            lists = np.argsort(directions, axis=0, kind="stable").T.astype("<u2")
            row = {
                "bucket": base + number,
                "label_set": np.unique(members.labels).tolist(),
                **_packed(members),
                "lists": lists.tobytes(),
            }
            number += 1
            yield _row(row)

    order = ["label", F.desc("squares"), "uid"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(dealt.select("uid", "vec_id", "label", "v").mapInArrow(run, BUCKETS), "buckets")


def _cut(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[pa.RecordBatch]]:
    held, rows = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, size - rows)
            held.append(part)
            rows += part.num_rows
            batch = batch.slice(part.num_rows)
            if rows == size:
                yield held
                held, rows = [], 0
    if rows:
        yield held


def _row(row: dict) -> pa.RecordBatch:
    kinds = {
        "bucket": pa.int64(),
        "label_set": pa.list_(pa.int64()),
        "width": pa.int32(),
        "kind": pa.string(),
    }
    columns = [pa.array([value], kinds.get(name, pa.binary())) for name, value in row.items()]
    return pa.RecordBatch.from_arrays(columns, names=list(row))


def blocks_of(buckets: DataFrame, every: int = ANCHORS) -> DataFrame:
    """The anchors of each bucket, those whose id is divisible by ``every``, as a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                members = _unpacked(row)
                anchors = members.some(members.named & (members.ids % every == 0))
                if len(anchors.ids):
                    told = {"bucket": row["bucket"], "label_set": np.unique(anchors.labels).tolist()}
                    yield _row({**told, **_packed(anchors)})

    return written(buckets.drop("lists").mapInArrow(run, BLOCKS), "blocks")


class Bucket:
    """A bucket that finds candidates by its sorted lists."""

    def __init__(self, members: Members, lists: np.ndarray):
        self.members = members
        self.directions, lengths = _directions(members.v)
        self.longest, self.shortest = lengths.max(), lengths.min()
        self.lists = lists
        self.sorted = np.take_along_axis(self.directions.T, lists.astype(np.int64), axis=1)
        self.top = int(np.abs(members.v).max(initial=0))
        self.exact = members.v.astype(np.float64)
        self.looked_at = self.candidates_found = 0

    def candidates(self, direction: np.ndarray, length: float, least: int) -> np.ndarray | None:
        """Places of the rows whose product with the anchor can be ``least``; ``None`` for all."""
        none = np.zeros(0, dtype=np.int64)
        if length == 0:
            return None if least <= 0 else none
        # A product of at least a positive number needs the cosine that it needs with the longest
        # row; of a negative one, with the shortest.
        reach = length * (self.longest if least > 0 else self.shortest)
        if reach == 0:
            return None if least <= 0 else none
        cosine = least / reach - SLACK
        if cosine > 1:
            return none
        if cosine <= -1:
            return None
        angle = np.arccos(cosine)
        width = min(len(direction), len(self.lists))
        focus = np.argsort(-np.abs(direction[:width]), kind="stable")[:FOCUS]
        ranges = []
        for f in focus.tolist():
            own = np.arccos(np.clip(direction[f], -1, 1))
            low = np.cos(min(np.pi, own + angle)) - SLACK
            high = np.cos(max(0.0, own - angle)) + SLACK
            start = int(np.searchsorted(self.sorted[f], low, "left"))
            stop = int(np.searchsorted(self.sorted[f], high, "right"))
            if stop - start < len(self.exact):
                ranges.append((stop - start, f, start, stop, low, high))
        if not ranges:
            return None
        ranges.sort()
        _, f, start, stop, _, _ = ranges[0]
        found = self.lists[f, start:stop].astype(np.int64)
        for _, f, _, _, low, high in ranges[1:]:
            values = self.directions[found, f]
            found = found[(values >= low) & (values <= high)]
        return found

    def products(self, anchors: Members) -> "Products":
        return Products(self, anchors.v)


class Products:
    """Exact products of a bucket's rows with a block's anchors."""

    def __init__(self, bucket: Bucket, anchors: np.ndarray):
        width = min(anchors.shape[1], bucket.exact.shape[1])
        top = bucket.top * int(np.abs(anchors).max(initial=0)) * max(width, 1)
        if top < 1 << 53:
            self.rows, self.anchors = bucket.exact[:, :width], anchors[:, :width].astype(np.float64)
        else:
            # Doubles would round: whole numbers of 64 bits, or of any size.
            kind = np.int64 if top < 1 << 63 else object
            self.rows = bucket.members.v[:, :width].astype(kind)
            self.anchors = anchors[:, :width].astype(kind)
        self.whole = None

    def of(self, anchor: int, places: np.ndarray | None) -> np.ndarray:
        if places is not None:
            return (self.rows[places] @ self.anchors[anchor]).astype(np.int64)
        if self.whole is None:
            self.whole = (self.rows @ self.anchors.T).astype(np.int64)
        return self.whole[:, anchor]


def _best(places: np.ndarray, scores: np.ndarray, members: Members, most: int) -> np.ndarray:
    """Indexes of the ``most`` best of ``places``: highest score, then smallest id, null ids last."""
    at = np.arange(len(places))
    if len(at) > 4 * most:
        at = np.flatnonzero(scores >= np.partition(scores, -most)[-most])
    chosen = places[at]
    ids, uids = members.ids[chosen], members.uids[chosen]
    return at[np.lexsort((uids, ids, ~members.named[chosen], -scores[at]))[:most]]


class _Remembered(OrderedDict):
    """A mapping that forgets its oldest entries beyond a number."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def add(self, key, value):
        self[key] = value
        while len(self) > self.most:
            self.popitem(last=False)
        return value


def _search(windows_of, kept, same: bool, schema: pa.Schema):
    """A ``mapInArrow`` function over rows of a block and a bucket.

    ``windows_of(row, anchors)`` gives each anchor's windows of scores ``(low, high, payload)``;
    the best ``kept`` rows of each window are handed on. ``same`` asks for rows of the anchor's
    label, else for those of other labels.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, unpacked = _Remembered(BLOCKS_REMEMBERED), _Remembered(BUCKETS_UNPACKED)
        for batch in batches:
            for row in batch.to_pylist():
                bucket = unpacked.get(row["bucket"])
                if bucket is None:
                    members = _unpacked(row)
                    lists = np.frombuffer(row["lists"], dtype="<u2")
                    lists = lists.reshape(members.v.shape[1], len(members.v))
                    bucket = unpacked.add(row["bucket"], Bucket(members, lists))
                anchors = _unpacked({n.removeprefix("block_"): x for n, x in row.items() if n.startswith("block_")})
                windows = blocks.get(row["block"])
                if windows is None:
                    windows = blocks.add(row["block"], windows_of(row, anchors))
                found = list(_found(bucket, anchors, windows, kept, same))
                if found:
                    columns = [pa.array(c, t) for c, t in zip(zip(*found), schema.types)]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _found(bucket: Bucket, anchors: Members, windows: list, kept: int, same: bool) -> Iterator[tuple]:
    """The best rows of one bucket for each window; raises the windows' least scores."""
    members = bucket.members
    directions, lengths = _directions(anchors.v)
    products = bucket.products(anchors)
    everything = np.arange(len(members.uids))
    for a in range(len(anchors.uids)):
        open_windows = [w for w in windows[a] if w["low"] <= w["high"]]
        if not open_windows:
            continue
        least = min(w["low"] for w in open_windows)
        places = bucket.candidates(directions[a], lengths[a], least)
        scores = products.of(a, places)
        places = everything if places is None else places
        fits = (members.labels[places] == anchors.labels[a]) == same
        fits &= (scores >= least) & (members.uids[places] != anchors.uids[a])
        places, scores = places[fits], scores[fits]
        if not len(places):
            continue
        for w in open_windows:
            inside = np.flatnonzero((scores >= w["low"]) & (scores <= w["high"]))
            if not len(inside):
                continue
            best = inside[_best(places[inside], scores[inside], members, kept)]
            for place, score in zip(places[best].tolist(), scores[best].tolist()):
                vec_id = int(members.ids[place]) if members.named[place] else None
                yield (int(anchors.uids[a]), *w["told"], int(members.uids[place]), vec_id, score)
            w["best"] = sorted(w["best"] + scores[best].tolist())[-kept:]
            if len(w["best"]) == kept:
                # An equal score with a smaller id may still come.
                w["low"] = max(w["low"], w["best"][0])


_FOUND = [("uid", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]
_ANCHOR = ("anchor", pa.int64())
_POSITIVE = [("rank", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())]


def _as_block(blocks: DataFrame, *also: str) -> DataFrame:
    names = [n.strip().split(" ")[0] for n in _MEMBERS.split(",")]
    return blocks.select(
        F.col("bucket").alias("block"),
        F.col("label_set").alias("block_labels_in"),
        *[F.col(n).alias(f"block_{n}") for n in names],
        *also,
    )


def _few_at_once(spark: SparkSession, rows: int) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def _shuffled(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A join that sends neither side through the driver. Spark takes blocks and buckets for as
    large as their compressed files, and would broadcast what is many times larger in memory."""
    return left.hint("merge").join(right, key)


def positives_of(blocks: DataFrame, buckets: DataFrame, most: int = POSITIVES) -> DataFrame:
    """``(block, anchor, rank, positive_id, positive_score)``: each anchor's best rows of its label."""

    def whole(row: dict, anchors: Members) -> list:
        lowest, highest = -(1 << 63), (1 << 63) - 1
        told = {"told": (row["block"],), "low": lowest, "high": highest}
        return [[{**told, "best": []}] for _ in anchors.uids]

    left = blocks.select(F.col("bucket").alias("block"), F.explode("label_set").alias("of"))
    right = buckets.select("bucket", F.explode("label_set").alias("of"))
    # Numbers alone: the rows of blocks and buckets are joined to each pair once.
    pairs = left.join(right, "of").select("block", "bucket").distinct()
    met = _shuffled(pairs, _as_block(blocks), "block")
    met = _shuffled(met, buckets.drop("label_set"), "bucket")
    schema = pa.schema([_ANCHOR, ("block", pa.int64()), *_FOUND])
    found = met.mapInArrow(
        _search(whole, most, True, schema),
        "anchor bigint, block bigint, uid bigint, vec_id bigint, score bigint",
    )
    order = [F.desc("score"), F.asc_nulls_last("vec_id"), "uid"]
    rank = F.row_number().over(Window.partitionBy("anchor").orderBy(*order))
    best = written(found, "positives_found").withColumn("rank", rank).filter(F.col("rank") <= most)
    return best.select(
        "block",
        "anchor",
        F.col("rank").cast("bigint").alias("rank"),
        F.col("vec_id").alias("positive_id"),
        F.col("score").alias("positive_score"),
    )


def negatives_of(
    blocks: DataFrame, buckets: DataFrame, positives: DataFrame, most: int, low: int, high: int
) -> DataFrame:
    """For each positive of ``(block, anchor, rank, positive_id, positive_score)`` the best rows of
    other labels, whose scores are from ``low`` to ``high`` hundredths of the positive's."""
    spark = blocks.sparkSession

    def between(row: dict, anchors: Members) -> list:
        windows: dict[int, list] = {int(uid): [] for uid in anchors.uids}
        for p in row["told"]:
            score = p["positive_score"]
            windows[p["anchor"]].append(
                {
                    "told": (p["rank"], p["positive_id"], score),
                    "low": -(-low * score // 100),
                    "high": high * score // 100,
                    "best": [],
                }
            )
        return [windows[int(uid)] for uid in anchors.uids]

    # A block has a bucket's rows at most, and a few positives for each.
    told = F.collect_list(F.struct("anchor", "rank", "positive_id", "positive_score"))
    windows = positives.groupBy(F.col("block").alias("bucket")).agg(told.alias("told"))
    asking = written(_as_block(_shuffled(blocks, windows, "bucket"), "told"), "asking")
    # A cell has as many buckets as a task keeps unpacked, about, or fewer.
    n = buckets.count()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = max(1, min(n, partitions), -(-n // BUCKETS_UNPACKED))
    one_label = (F.size("label_set") == 1) & F.col("label_set").eqNullSafe(F.col("block_labels_in"))
    # Each cell's task reads the blocks from their files: no copies of them are shuffled or sent
    # through the driver, however many cells there are.
    met = (
        asking.coalesce(1)
        .hint("shuffle_replicate_nl")
        .join(buckets.repartition(cells), ~one_label)
        .drop("label_set", "block_labels_in")
    )
    schema = pa.schema([_ANCHOR, *_POSITIVE, *_FOUND])
    found = met.mapInArrow(
        _search(between, most, False, schema),
        "anchor bigint, positive_rank bigint, positive_id bigint, positive_score bigint, "
        "uid bigint, vec_id bigint, score bigint",
    )
    found = written(found, "negatives_found")
    order = [F.desc("score"), F.asc_nulls_last("vec_id"), "uid"]
    rank = F.row_number().over(Window.partitionBy("anchor", "positive_rank").orderBy(*order))
    return found.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= most)


def hard_negatives(
    rows: DataFrame,
    every: int = ANCHORS,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = 50,
    high: int = 95,
    bucket: int = BUCKET,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``rows`` are those of ``vectors``. Anchors are rows whose ``vec_id`` is divisible by ``every``.
    A null ``vec_id`` is no anchor, and comes last among equal scores; rows that repeat a ``vec_id``
    are rows of their own. Vectors of another width count as filled up with zeros, so an empty one
    has the score 0 with all. A positive that no row is hard enough for gives no rows; so do an
    empty table and anchors without another row of their label. Scores are 64-bit numbers.
    """
    spark = rows.sparkSession
    _few_at_once(spark, BATCH_ROWS)
    buckets = buckets_of(rows, bucket)
    _few_at_once(spark, PAIR_ROWS)
    blocks = blocks_of(buckets, every)
    wanted = written(positives_of(blocks, buckets, positives), "positives")
    found = negatives_of(blocks, buckets, wanted, negatives, low, high)
    _few_at_once(spark, BATCH_ROWS)
    anchors = rows.select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return found.join(anchors.filter(F.col("anchor_id") % every == 0), "anchor").select(
        "anchor_id",
        "positive_id",
        "rank",
        F.col("vec_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )


def changed_label() -> Column:
    """The contract's labels: where the id is divisible by 7, the next of ten."""
    label = F.col("label").cast("bigint")
    return F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)


ORACLE = """
    WITH vecs AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               [floor(256 * x::DOUBLE) for x in embedding] AS v
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL
          AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
    ), scored AS (
        SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
               list_dot_product(a.v, b.v)::BIGINT AS score
        FROM vecs a JOIN vecs b ON a.vec_id <> b.vec_id
        WHERE a.vec_id % 50 = 0
    ), positives AS (
        SELECT anchor_id, other_id AS positive_id, score AS positive_score
        FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
    )
    SELECT p.anchor_id, p.positive_id,
           row_number() OVER (
               PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id
           ) AS rank,
           n.other_id AS negative_id, p.positive_score, n.score AS negative_score
    FROM positives p JOIN scored n
      ON n.anchor_id = p.anchor_id AND NOT n.same
     AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
    QUALIFY rank <= 3
"""
