"""Document fingerprints by prefix polynomial hashes.

The prefix array of a text holds ``S[i] = sum(c[j] * B**j for j < i) mod p`` for its code points
``c``. The hash of the span ``[i, j)`` is ``(S[j] - S[i]) * B**-i``: any two spans, of one text or
of two, compare in constant time, and the longest common extension of two positions is found by
binary search over its length. Two bases under ``p = 2**31 - 1`` give 62 bits.

A fingerprint is the length, the hash of the whole text and a sketch: the ``SKETCH`` smallest
distinct (mixed) hashes of all spans of ``SPAN`` code points. Two sketches estimate which share of
their spans two texts have in common, wherever in the texts they stand. In a short text, one change
touches most spans of that length, so texts of less than ``SHORT`` code points also have a sketch of
spans of ``SHORT_SPAN``; two short texts are compared by these.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloop.llm.common import rows_of, texts

P = np.uint64((1 << 31) - 1)
BASES = (1_000_003, 16_777_619)
INVERSES = tuple(pow(base, -1, int(P)) for base in BASES)
SPAN = 24
SHORT = 256
SHORT_SPAN = 4
SKETCH = 64
# Ranges of ids for each shuffle partition: ranges are dealt by hash, so several even out.
RANGES_PER_PARTITION = 4

_S31 = np.uint64(31)
_powers: dict[int, np.ndarray] = {}


def _mod(x: np.ndarray) -> np.ndarray:
    """``x mod 2**31 - 1`` for any unsigned 64-bit ``x``, by folding."""
    x = (x & P) + (x >> _S31)
    x = (x & P) + (x >> _S31)
    x[x >= P] -= P
    return x


def _power_table(base: int, n: int) -> np.ndarray:
    """``base**i mod p`` for ``i < n`` at least; the table doubles when it is too short."""
    table = _powers.get(base)
    if table is None:
        table = np.ones(1, dtype=np.uint64)
    while len(table) < n:
        step = np.uint64(pow(base, len(table), int(P)))
        table = np.concatenate([table, _mod(table * step)])
    _powers[base] = table
    return table


class PrefixHashes:
    """Prefix arrays of one text; an empty text has hash 0."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
        codes += np.uint64(1)
        self.n = len(codes)
        self.sums = []
        for base in BASES:
            sums = np.zeros(self.n + 1, dtype=np.uint64)
            # Terms are below 2**31, so their sums stay below 2**64 for 2**33 code points.
            np.cumsum(_mod(codes * _power_table(base, self.n)[: self.n]), out=sums[1:])
            self.sums.append(_mod(sums))

    def windows(self, length: int) -> np.ndarray:
        """Hashes of all spans of ``length``."""
        m = self.n - length + 1
        out = np.zeros(m, dtype=np.uint64)
        for inverse_base, sums in zip(INVERSES, self.sums):
            inverse = _power_table(inverse_base, self.n + 1)
            part = _mod(sums[length:] + P - sums[:m])
            out = (out << _S31) | _mod(part * inverse[:m])
        return out

    def span(self, start: int, length: int) -> int:
        """The hash of one span."""
        out = 0
        for inverse_base, sums in zip(INVERSES, self.sums):
            inverse = _power_table(inverse_base, self.n + 1)
            part = int(sums[start + length]) - int(sums[start])
            out = (out << 31) | part * int(inverse[start]) % int(P)
        return out

    def whole(self) -> int:
        return self.span(0, self.n)


def spans_equal(a: PrefixHashes, i: int, b: PrefixHashes, j: int, length: int) -> bool:
    """Whether ``length`` code points of ``a`` from ``i`` equal those of ``b`` from ``j``."""
    fits = i + length <= a.n and j + length <= b.n
    return fits and a.span(i, length) == b.span(j, length)


def common_extension(a: PrefixHashes, i: int, b: PrefixHashes, j: int) -> int:
    """The longest length for which the spans from ``i`` and ``j`` are equal."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        middle = (low + high + 1) // 2
        if spans_equal(a, i, b, j, middle):
            low = middle
        else:
            high = middle - 1
    return low


def _mix(hashes: np.ndarray) -> np.ndarray:
    """A bijection that spreads hashes over all 64 bits, so that the smallest are a sample."""
    x = hashes * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def sketch(prefix: PrefixHashes, span: int = SPAN) -> np.ndarray:
    """The smallest distinct span hashes; a text shorter than a span is one span."""
    if not prefix.n:
        return np.zeros(0, dtype=np.uint64)
    mixed = _mix(prefix.windows(min(span, prefix.n)))
    if len(mixed) > 8 * SKETCH:
        low = np.unique(mixed[mixed < np.uint64(int(4 * SKETCH / len(mixed) * 2**64))])
        if len(low) >= SKETCH:
            return low[:SKETCH]
    return np.unique(mixed)[:SKETCH]


def fingerprint(prefix: PrefixHashes) -> str:
    """Length, whole hash and sketch, and the sketch of short spans if the text is short."""
    parts = [sketch(prefix)]
    if 0 < prefix.n < SHORT:
        parts.append(sketch(prefix, SHORT_SPAN))
    values = [",".join(map("{:x}".format, part.tolist())) for part in parts]
    return ":".join([str(prefix.n), f"{prefix.whole():x}", *values])


def likeness(a: str, b: str) -> float:
    """Twice the common spans over the spans of both texts, estimated from two fingerprints.

    The smallest values of both sketches together are a random sample of the union of spans. Equal
    fingerprints give 1, as two empty texts do; an empty and another text give 0.
    """
    if a == b:
        return 1.0
    parts = [x.split(":") for x in (a, b)]
    # Two short texts have a fourth part each.
    which = 3 if all(len(part) > 3 for part in parts) else 2
    left, right = ({int(v, 16) for v in part[which].split(",") if v} for part in parts)
    sample = sorted(left | right)[:SKETCH]
    if not sample:
        return 0.0
    jaccard = sum(v in left and v in right for v in sample) / len(sample)
    return 2 * jaccard / (1 + jaccard)


RESULT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
        T.StructField("prefix_edited", T.LongType()),
        T.StructField("prefix_next", T.LongType()),
    ]
)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Each own row of a range with the row after it.

    A range ends with a copy of the first row of the next.
    """
    held = first = None
    ended = False
    for bucket, copy, doc_id, text in rows_of(batches, "range", "copy", "doc_id", "text"):
        if held is not None and bucket != first[0]:
            if not ended:
                yield held, first[1:]
            held = None
        if held is None:
            first, held, ended = (bucket, doc_id, text), (doc_id, text), False
        elif not ended:
            yield held, (doc_id, text)
            held, ended = (doc_id, text), copy
    if held is not None and not ended:
        yield held, first[1:]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    schema = pa.schema([(f.name, _ARROW[type(f.dataType)]) for f in RESULT.fields])
    known: tuple | None = None  # the row after the last pair's, hashed already
    out: list[tuple] = []
    for (doc_id, text), (next_id, next_text) in _pairs(batches):
        if known is not None and known[0] is text:
            prefix, own = known[1:]
        else:
            prefix = PrefixHashes(text)
            own = fingerprint(prefix)
        following = PrefixHashes(next_text)
        next_print = fingerprint(following)
        known = (next_text, following, next_print)
        half = prefix.n // 2
        edited_text = text[: prefix.n - half] + next_text[:half]
        edited = PrefixHashes(edited_text)
        edited_print = fingerprint(edited)
        out.append(
            (
                doc_id,
                prefix.n,
                hashlib.sha256(edited_text.encode()).hexdigest(),
                own,
                edited_print,
                likeness(own, edited_print),
                likeness(own, next_print),
                common_extension(prefix, 0, edited, 0),
                common_extension(prefix, 0, following, 0),
            )
        )
        if len(out) == 1000:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema
            )
            out = []
    if out:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema
        )


_ARROW = {T.LongType: pa.int64(), T.StringType: pa.string(), T.DoubleType: pa.float64()}


def range_starts(docs: DataFrame, ranges: int) -> list[int]:
    """Ids of the table that cut the descending order into even ranges, from the largest on."""
    cuts = F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 20 * ranges)
    largest, inner = docs.agg(F.max("doc_id"), cuts).first()
    return [] if largest is None else sorted({largest, *(inner or [])}, reverse=True)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint every text and its edited text, and compare them with the next document's.

    The order is descending ``doc_id``, nulls last; rows of one id follow in the order of their
    texts. Every row has a next one, the last the first, a single row itself. A null text is an
    empty one, and an empty text has the fingerprint ``0:0:``. An empty table gives no rows.

    Ids are cut into ranges at ids of the table. The first row of each range goes to the range
    before as well, so one shuffle of the texts brings every row together with its next.
    """
    spark = docs.sparkSession
    docs = texts(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    starts = range_starts(docs.select("doc_id"), RANGES_PER_PARTITION * partitions)
    m = max(1, len(starts))
    ascending = np.array(starts[::-1], dtype=np.int64)

    @F.pandas_udf("array<int>")
    def ranges_of(ids: pd.Series) -> pd.Series:
        """The range of a row, and the range before it if the row starts its own."""
        ids = ids.to_numpy()
        own = np.clip(len(ascending) - np.searchsorted(ascending, ids), 1, m)
        before = np.where(own == 1, m, own - 1)
        rows = zip(own.tolist(), before.tolist(), np.isin(ids, ascending).tolist())
        return pd.Series([[o, b] if starting else [o] for o, b, starting in rows])

    # Null ids come last, so the least number stands for them in the search.
    keyed = docs.withColumn("ranges", ranges_of(F.coalesce("doc_id", F.lit(-(2**63)))))
    dealt = keyed.select(
        F.posexplode("ranges").alias("at", "range"), "doc_id", "text"
    ).withColumn("copy", F.col("at") == 1)
    ordered = (
        dealt.select("range", "copy", "doc_id", "text")
        .repartition(partitions, "range")
        .sortWithinPartitions("range", "copy", F.desc_nulls_last("doc_id"), "text")
    )
    return ordered.mapInArrow(_compare, RESULT)
