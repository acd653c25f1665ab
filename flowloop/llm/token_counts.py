"""Token counts by overlap resynchronisation.

A huge document is encoded in overlapping chunks with offsets. Two neighbouring chunks are spliced
at a token boundary that both have in their overlap and that is proven stable: the two code points
beside it follow each other in no piece of the vocabulary, so no merge can ever cross it, whatever
stands around. Where the overlap has no such place, it is widened and the chunk encoded again, at
worst to the end of the text.
"""

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloop.llm.common import rows_of, texts

CHUNK = 32_768
OVERLAP = 64
LIMIT = 4096


class PieceCounter:
    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        vocab = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        # Neighbours within some piece; the vocabulary writes a space as U+2581.
        self.crossed = {pair for piece in vocab for pair in zip(piece, piece[1:])}

    def stable(self, text: str, at: int) -> bool:
        """Whether no merge crosses the place before ``text[at]``."""
        before, after = (c.replace(" ", "▁") for c in text[at - 1 : at + 1])
        return (before, after) not in self.crossed

    def boundaries(self, text: str) -> list[int]:
        """The offset at which each token of ``text`` begins."""
        offsets = self.library.encode(text, return_type="offset_mapping")["offsets"]
        return [begin for begin, _ in offsets]

    def count(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        n = len(text)
        if n <= chunk + overlap:
            return len(self.library.encode(text))
        total = start = counted = 0  # tokens before ``counted`` are in the total
        begins = None
        while True:
            wide = overlap
            stop = start + chunk
            while True:
                end = min(n, stop + wide)
                if begins is None:
                    begins = self.boundaries(text[start:end])
                if end == n:
                    return total + sum(start + b >= counted for b in begins)
                following = self.boundaries(text[stop:end])
                splice = self._splice(text, start, begins, stop, following)
                if splice is not None:
                    break
                wide, begins = 4 * wide, None
            total += sum(counted <= start + b < splice for b in begins)
            start, counted, begins = stop, splice, None

    def _splice(
        self, text: str, start: int, left: list[int], stop: int, right: list[int]
    ) -> int | None:
        """The first common boundary of two encodings that is proven stable."""
        shared = {start + b for b in left}.intersection(stop + b for b in right if b)
        return min((at for at in shared if self.stable(text, at)), default=None)


@lru_cache(maxsize=2)
def _counter(path: str) -> PieceCounter:
    return PieceCounter(path)


SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
    ]
)


def token_counts(docs: DataFrame, model: str, limit: int = LIMIT) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for every row.

    A null text is an empty one with no tokens; strings of special tokens are ordinary text.
    Repeated rows and null ids each give a row; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model)
        for batch in batches:
            all_texts = [text for (text,) in rows_of(iter([batch]), "text")]
            columns = [
                batch.column("doc_id"),
                pa.array([len(text.encode()) for text in all_texts], pa.int64()),
                pa.array([counter.count(text) for text in all_texts], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=SCHEMA.names)

    docs = texts(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    counts = docs.mapInArrow(run, SCHEMA)
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
