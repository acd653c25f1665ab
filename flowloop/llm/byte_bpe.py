"""Byte-level BPE by DuckDB recursive queries, one small database per Python worker.

A text is split into words by the tokenizer's pattern. Rows ``(word, position, token)`` of new words
join the merge table; every round of a recursive query contracts the leftmost pair of least rank of
each unfinished word, until no word has a pair. An ordered aggregation joins the ids with the
vocabulary and puts each word's bytes together again: a document's decoded bytes are those of its
words. Words repeat, so a worker remembers the ids and bytes of many, in Arrow columns from which the
words of a document are taken and joined.

The rank file is checked when it is loaded: every token must come apart into exactly two tokens of
lower rank. Then a contraction never brings up a pair of lower rank than its own.

A query keeps the rows of all its rounds, so words go into queries by the work they make, which
grows with the square of their length. Words of more than ``LONG`` bytes are cut into pieces, which
are contracted like words, and spliced. Two tokens that follow each other are compatible if their
bytes alone contract to just these two. A sequence of tokens is the word's if all neighbours are
compatible: the first contraction across a border would also come about in the two tokens alone.
Where a splice makes neighbours that are not, the tokens around are contracted anew, in windows that
widen until all are.
"""

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloop.llm.common import rows_of, texts

# Texts of about this many code points are encoded together, in queries of so many words.
STRETCH = 8 << 20
QUERY_WORDS = 50_000
# Rows that the rounds of one query make together, a word of n bytes n * n / 2.
QUERY_ROWS = 2_500_000
# Words of more bytes are spliced from pieces of this length.
LONG = 96
PIECE = 32
# Long words of about this many bytes are spliced together.
LONG_BYTES = 4 << 20
# Ids of long words that one query decodes.
QUERY_IDS = 500_000
# Tokens on both sides of a border that are contracted anew first.
WINDOW = 2
# Words that a worker remembers, none longer than LONG; it starts anew beyond them. Splitting is
# cheaper than contraction, so it remembers fewer stretches between white space.
REMEMBERED = 800_000
CHUNKS = 400_000
# Pairs of tokens that it remembers.
PAIRS = 300_000
MEMORY = "300MB"

# Unicode's White_Space, which is what \s means in the pattern.
_SPACE = r"\t-\r \x85\xa0  -     　"
# Cuts that every match of the pattern respects: what stands between them is split on its own.
_COARSE = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")

# Rows hold the place and token of the row after them, and what the two merge into.
_START = """
    SELECT i.w, i.pos, i.tok, i.q, i.nxt, m.merged AS m, 0 AS it
    FROM (SELECT w, pos, tok, lead(pos) OVER win AS q, lead(tok) OVER win AS nxt
          FROM rows_in WINDOW win AS (PARTITION BY w ORDER BY pos)) i
    LEFT JOIN merges m ON i.tok = m.l AND i.nxt = m.r
"""

# One contraction for each word: the pair of least rank, the leftmost of several.
_ONE = f"""
    WITH RECURSIVE state(w, pos, tok, q, nxt, m, it) AS ({_START}
    UNION ALL
    SELECT c.w, c.pos, c.tok, c.q, c.nxt, m.merged, c.it FROM (
        WITH best AS (
            SELECT w, min((m::BIGINT << 32) | pos) AS b, arg_min(q, (m::BIGINT << 32) | pos) AS q
            FROM state WHERE m IS NOT NULL AND it < $rounds GROUP BY w
        ), change AS (
            SELECT b.w, (b & 4294967295)::INT AS head, (b >> 32)::INT AS merged,
                   t.pos AS gone, t.q, t.nxt
            FROM best b JOIN state t ON t.w = b.w AND t.pos = b.q
        )
        SELECT s.w, s.pos, s.it + 1 AS it,
               CASE WHEN s.pos = head THEN merged ELSE s.tok END AS tok,
               CASE WHEN s.pos = head THEN c.q ELSE s.q END AS q,
               CASE WHEN s.pos = head THEN c.nxt WHEN s.q = head THEN merged ELSE s.nxt END AS nxt
        FROM state s JOIN change c ON s.w = c.w WHERE s.pos <> c.gone
    ) c LEFT JOIN merges m ON c.tok = m.l AND c.nxt = m.r)
"""

# All of a word's pairs of least rank at once; of a run of equal tokens, every other one.
_ALL = f"""
    WITH RECURSIVE state(w, pos, tok, m, it) AS (SELECT w, pos, tok, m, it FROM ({_START})
    UNION ALL
    SELECT n.w, n.pos, n.tok, m.merged, n.it FROM (
        SELECT w, pos, tok, it, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS nxt FROM (
            SELECT w, pos, it + 1 AS it, CASE WHEN hit THEN m ELSE tok END AS tok,
                   lag(hit) OVER (PARTITION BY w ORDER BY pos) AS gone
            FROM (
                SELECT *, m = least AND (NOT twin
                    OR (i - max(CASE WHEN prv IS DISTINCT FROM tok THEN i END)
                        OVER (PARTITION BY w ORDER BY pos)) % 2 = 0) AS hit
                FROM (
                    SELECT *, min(m) OVER (PARTITION BY w) AS least, lag(tok) OVER win AS prv,
                           coalesce(lead(tok) OVER win = tok, false) AS twin,
                           row_number() OVER win AS i
                    FROM state WHERE it < $rounds WINDOW win AS (PARTITION BY w ORDER BY pos)
                ) WHERE least IS NOT NULL
            )
        ) WHERE gone IS DISTINCT FROM true
    ) n LEFT JOIN merges m ON n.tok = m.l AND n.nxt = m.r)
"""

_LAST = """
    SELECT s.w, s.pos, s.tok, s.m FROM state s
    JOIN (SELECT w, max(it) AS it FROM state GROUP BY w) z ON s.w = z.w AND s.it = z.it
"""

_DECODED = """
    SELECT count(*) AS n, string_agg(tok, ',' ORDER BY pos) AS ids,
           unhex(string_agg(hex, '' ORDER BY pos)) AS raw
    FROM rows_out JOIN vocab ON id = tok GROUP BY w ORDER BY w
"""
DECODED = pa.schema([("n", pa.int64()), ("ids", pa.large_string()), ("raw", pa.large_binary())])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def _halves(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The token's bytes merged by the ranks below its own."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        joined = [ranks.get(a + b, ranks[token]) for a, b in zip(parts, parts[1:])]
        least = min(joined)
        if least >= ranks[token]:
            break
        at = joined.index(least)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.pattern = regex.compile(pattern)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        merges = []
        for token, rank in ranks.items():
            if len(token) > 1:
                halves = _halves(token, ranks)
                if len(halves) != 2:
                    raise ValueError(f"{token!r} does not come apart into two tokens of {path}")
                merges.append((ranks[halves[0]], ranks[halves[1]], rank))
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.compatible: dict[tuple[int, int], bool] = {}
        config = {"threads": 1, "memory_limit": MEMORY, "temp_directory": ""}
        self.db = duckdb.connect(config=config)
        columns = [pa.array(c, pa.int32()) for c in zip(*merges)]
        self._table("merges", pa.table(columns, names=["l", "r", "merged"]))
        vocab = {"id": pa.array(ranks.values(), pa.int32()), "hex": [t.hex() for t in ranks]}
        self._table("vocab", pa.table(vocab))
        self.forget()

    def forget(self) -> None:
        # Numbers of words, whose results are the rows of ``results``.
        self.words: dict[str, int] = {}
        self.results = DECODED.empty_table()
        self.forget_chunks()

    def forget_chunks(self) -> None:
        # Numbers of chunks; the words of chunk i are ``parts[stops[i] : stops[i + 1]]``.
        self.chunks: dict[str, int] = {}
        self.parts = np.zeros(0, dtype=np.int32)
        self.stops = np.zeros(1, dtype=np.int64)

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("fresh", rows)
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM fresh")
        self.db.unregister("fresh")

    def contract(self, words: list[bytes]) -> None:
        """Leave the tokens of each word, by its number, in the table ``rows_out``."""
        sizes = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        first = np.cumsum(sizes) - sizes
        rows = pa.table(
            {
                "w": np.repeat(np.arange(len(words), dtype=np.int32), sizes),
                "pos": (np.arange(len(raw)) - np.repeat(first, sizes)).astype(np.int32),
                "tok": self.byte_ids[raw],
            }
        )
        self._table("rows_in", rows)
        # Long windows are contracted everywhere at once, and in queries of few rounds; what shorter
        # words make in all their rounds is bounded already.
        query, rounds = _ONE, int(sizes.max())
        if rounds > LONG:
            query, rounds = _ALL, max(QUERY_ROWS // len(raw), 1)
        query = query.replace("$rounds", str(rounds))
        self.db.execute("CREATE OR REPLACE TEMP TABLE rows_out (w INT, pos INT, tok INT)")
        while True:
            self.db.execute(f"CREATE OR REPLACE TEMP TABLE step AS {query} {_LAST}")
            self.db.execute(
                "CREATE OR REPLACE TEMP TABLE unfinished AS "
                "SELECT DISTINCT w FROM step WHERE m IS NOT NULL"
            )
            self.db.execute(
                "INSERT INTO rows_out SELECT w, pos, tok FROM step ANTI JOIN unfinished USING (w)"
            )
            self.db.execute(
                "CREATE OR REPLACE TEMP TABLE rows_in AS "
                "SELECT w, pos, tok FROM step SEMI JOIN unfinished USING (w)"
            )
            if not self.db.sql("SELECT * FROM rows_in LIMIT 1").fetchall():
                break

    def decoded(self) -> pa.Table:
        """Count of tokens, ids joined by commas and bytes of each word in ``rows_out``."""
        return self.db.sql(_DECODED).to_arrow_table().cast(DECODED)

    def decoded_long(self, ids: list[list[int]]) -> pa.Table:
        """The same of the ids of long words, which more than one query may decode."""
        tokens = np.concatenate([np.array(t, dtype=np.int32) for t in ids])
        owner = np.repeat(np.arange(len(ids), dtype=np.int32), [len(t) for t in ids])
        found, owners = [], []
        for at in range(0, len(tokens), QUERY_IDS):
            w, tok = owner[at : at + QUERY_IDS], tokens[at : at + QUERY_IDS]
            rows = {"w": w, "pos": np.arange(len(w), dtype=np.int32), "tok": tok}
            self._table("rows_out", pa.table(rows))
            found.append(self.decoded())
            owners.append(np.unique(w))
        ends = np.searchsorted(np.concatenate(owners), np.arange(len(ids) + 1))
        return joined(pa.concat_tables(found), ends)

    def ids(self, words: set[bytes]) -> dict[bytes, list[int]]:
        """The ids of each word, as its contraction leaves them."""
        out = {}
        for some in _by_work(sorted(words)):
            self.contract(some)
            rows = self.db.sql("SELECT w, tok FROM rows_out ORDER BY w, pos").fetchnumpy()
            stops = np.cumsum(np.bincount(rows["w"], minlength=len(some)))
            for word, part in zip(some, np.split(rows["tok"], stops[:-1])):
                out[word] = part.tolist()
        return out

    def _learn_pairs(self, pairs: set[tuple[int, int]]) -> None:
        """Know of each pair of tokens whether they are compatible."""
        if len(self.compatible) > PAIRS:
            self.compatible.clear()
        both = {p: self.tokens[p[0]] + self.tokens[p[1]] for p in pairs.difference(self.compatible)}
        found = self.ids(set(both.values()))
        self.compatible.update((p, found[text] == list(p)) for p, text in both.items())

    def spliced(self, words: list[bytes]) -> list[list[int]]:
        """The ids of long words."""
        pieces = [[w[at : at + PIECE] for at in range(0, len(w), PIECE)] for w in words]
        known = self.ids({piece for own in pieces for piece in own})
        ids = [[i for piece in own for i in known[piece]] for own in pieces]
        borders = [np.cumsum([len(known[p]) for p in own])[:-1].tolist() for own in pieces]
        width = WINDOW
        while any(borders):
            self._learn_pairs({(t[i - 1], t[i]) for t, at in zip(ids, borders) for i in at})
            windows = [self._windows(t, at, width) for t, at in zip(ids, borders)]
            texts = [
                [b"".join([self.tokens[i] for i in t[low:high]]) for low, high in own]
                for t, own in zip(ids, windows)
            ]
            known = self.ids({text for own in texts for text in own})
            for n, own in enumerate(windows):
                ids[n], borders[n] = _replaced(ids[n], own, [known[text] for text in texts[n]])
            width *= 2
        return ids

    def _windows(self, ids: list[int], borders: list[int], width: int) -> list[list[int]]:
        """Stretches around the places where a token and the one before are not compatible."""
        windows: list[list[int]] = []
        for at in borders:
            if self.compatible[ids[at - 1], ids[at]]:
                continue
            low, high = max(0, at - width), min(len(ids), at + width)
            if windows and low <= windows[-1][1]:
                windows[-1][1] = high
            else:
                windows.append([low, high])
        return windows

    def _learn_words(self, words: list[str]) -> None:
        coded = {word: word.encode() for word in words}
        short = [w for w in words if len(coded[w]) <= LONG]
        found = [self.results]
        for some in _by_work([coded[w] for w in short]):
            self.contract(some)
            found.append(self.decoded())
        long = [w for w in words if len(coded[w]) > LONG]
        some: list[str] = []
        size = 0
        for i, word in enumerate(long, 1):
            some.append(word)
            size += len(coded[word])
            if size >= LONG_BYTES or i == len(long):
                found.append(self.decoded_long(self.spliced([coded[w] for w in some])))
                some, size = [], 0
        self.results = pa.concat_tables(found).combine_chunks()
        self.words.update(zip(short + long, range(len(self.words), self.results.num_rows)))

    def learn(self, chunks: set[str]) -> None:
        """Remember chunks and their words, those longer than ``LONG`` after all others."""
        order = sorted(chunks, key=_is_long)
        split = list(map(self.pattern.findall, order))
        fresh = sorted(set().union(*split).difference(self.words), key=_is_long)
        big = sum(map(_is_long, fresh))
        self._learn_words(fresh[: len(fresh) - big])
        self._learn_words(fresh[len(fresh) - big :])
        parts = [self.words[word] for word in chain.from_iterable(split)]
        stops = np.cumsum([len(words) for words in split], dtype=np.int64)
        self.stops = np.concatenate([self.stops, stops + len(self.parts)])
        self.parts = np.concatenate([self.parts, np.array(parts, dtype=np.int32)])
        self.chunks.update(zip(order, range(len(self.chunks), len(self.stops) - 1)))

    def forget_long(self) -> None:
        """Forget words and chunks longer than ``LONG``, which are the last."""
        for known in (self.words, self.chunks):
            while known and _is_long(next(reversed(known))):
                known.popitem()
        self.results = self.results.slice(0, len(self.words))
        self.stops = self.stops[: len(self.chunks) + 1]
        self.parts = self.parts[: self.stops[-1]]

    def encode(self, texts: list[str]) -> Iterator[tuple]:
        """``(count, ids joined by commas, decoded bytes)`` of each text."""
        if len(self.words) > REMEMBERED:
            self.forget()
        if len(self.chunks) > CHUNKS:
            self.forget_chunks()
        split = [_COARSE.findall(text) for text in texts]
        chunks = list(chain.from_iterable(split))
        fresh = set(chunks).difference(self.chunks)
        if fresh:
            self.learn(fresh)
        numbers = np.fromiter(map(self.chunks.__getitem__, chunks), np.int64, len(chunks))
        first = self.stops[numbers]
        sizes = self.stops[numbers + 1] - first
        stops = np.cumsum(np.concatenate([[0], sizes]))
        # The words of all texts, and where each text's begin and end.
        words = self.parts[np.arange(stops[-1]) + np.repeat(first - stops[:-1], sizes)]
        ends = stops[np.cumsum([0, *map(len, split)])]
        found = joined(self.results.take(pa.array(words)), ends)
        self.forget_long()
        yield from zip(*(column.to_pylist() for column in found.columns))


def _is_long(text: str) -> bool:
    return len(text) > LONG


def joined(rows: pa.Table, ends: np.ndarray) -> pa.Table:
    """A row for the rows from each end to the next: counts added, ids and bytes joined."""
    counts = np.concatenate([[0], np.cumsum(rows["n"].to_numpy())])[ends]
    columns = [pa.array(np.diff(counts))]
    for name, between in (("ids", b","), ("raw", b"")):
        values = rows[name].combine_chunks()
        between = pa.scalar(between, pa.large_binary()).cast(values.type)
        columns.append(pc.binary_join(pa.LargeListArray.from_arrays(ends, values), between))
    return pa.table(columns, schema=DECODED)


def _replaced(ids: list[int], windows: list, new: list[list[int]]) -> tuple[list[int], list[int]]:
    """``ids`` with windows replaced, and the windows' borders in them."""
    out: list[int] = []
    borders: set[int] = set()
    done = 0
    for (low, high), own in zip(windows, new):
        out += ids[done:low]
        borders.add(len(out))
        out += own
        borders.add(len(out))
        done = high
    out += ids[done:]
    return out, sorted(at for at in borders if 0 < at < len(out))


def _by_work(words: list[bytes]) -> Iterator[list[bytes]]:
    """Words in lists whose queries make about ``QUERY_ROWS`` rows, in their order."""
    some, work = [], 0
    for word in words:
        own = len(word) * (len(word) + 1) // 2
        if some and (work + own > QUERY_ROWS or len(some) == QUERY_WORDS):
            yield some
            some, work = [], 0
        some.append(word)
        work += own
    if some:
        yield some


@lru_cache(maxsize=2)
def _tokenizer(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


RESULT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)


def round_trips(docs: DataFrame, ranks: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Encode every text and decode its ids; digests of both, or with ``with_ids`` both whole.

    A null text is an empty one; it has no ids and decodes to nothing. No special tokens are known.
    Repeated rows and null ids each give a row; an empty table gives none.
    """
    schema = RESULT
    if with_ids:
        whole = [T.StructField("ids", T.StringType()), T.StructField("decoded", T.BinaryType())]
        schema = T.StructType([*RESULT.fields[:2], *whole])
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary() if with_ids else pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(ranks, pattern)
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            rows = []
            for (doc_id, _), (n, ids, raw) in zip(held, bpe.encode([text for _, text in held])):
                if not with_ids:
                    ids, raw = (hashlib.sha256(x).hexdigest() for x in (ids.encode(), raw))
                rows.append((doc_id, n, ids, raw))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for row in rows_of(batches, "doc_id", "text"):
            held.append(row)
            size += len(row[1])
            if size >= STRETCH:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    docs = texts(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return docs.mapInArrow(run, schema)
