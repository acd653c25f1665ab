"""Personal data and information-theoretic sanitisation.

Patterns find the protected entities: mail addresses, network addresses, card and phone numbers.
The corpus then shows which other terms reveal them. For an entity ``e`` and a term ``t`` seen
beside it, with document frequencies ``n``,

    disclosure = PMI(e; t) / IC(e) = log2(n(e,t) N / (n(e) n(t))) / log2(N / n(e))

is the share of the entity's information that the term gives away: 1 if the term never occurs
without it. A term that stands beside one entity in ``CONTEXTS`` different contexts and discloses
``GENERALISE`` of it is a span wherever it occurs; it is generalised in the sanitised text, and
removed from ``REMOVE`` on. Copies of a context are one context.

Terms are counted where a Bloom filter of fixed size lets them through; exact joins follow, so the
filter saves work and decides nothing.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloop.llm.common import free_name, rows_of, texts, written

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
# Words on either side of an entity that count as seen beside it.
WINDOW = 8
CONTEXTS = 3
GENERALISE = 0.8
REMOVE = 0.95
FILTER_WORDS = 1 << 16  # of 64 bits each: half a megabyte
REMEMBERED = 300_000

# Patterns and limits of the base spans are fixed by their definition.
_MAIL_HEAD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_MAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_WORD = re.compile(r"\w{3,}")


def _mails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the head of a mail address is the whole run before its ``@``."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _MAIL_HEAD:
            start -= 1
        tail = _MAIL_TAIL.match(text, at) if start < at else None
        if tail:
            end = tail.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _passes_luhn(digits: str) -> bool:
    doubled = "0246813579"
    total = sum(map(int, digits[-1::-2])) + sum(int(doubled[int(d)]) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` by kind, then start."""
    out = [("email", a, b) for a, b in _mails(text)]
    if not _DIGIT.search(text):
        return out
    if text.count(".") > 2:
        for m in _IP.finditer(text):
            parts = [part.lstrip("0") for part in m.group().split(".")]
            if all(len(part) <= 3 and int(part or 0) <= 255 for part in parts):
                out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _passes_luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGIT.findall(m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


def entity(kind: str, value: str) -> int:
    """One number for all spellings of an entity."""
    plain = value.lower() if kind in ("email", "ip") else "".join(_DIGIT.findall(value))
    return _signed(xxhash.xxh64_intdigest(f"{kind}:{plain}".encode()))


def term(word: str) -> int:
    return _signed(xxhash.xxh64_intdigest(word.lower().encode()))


def _signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def blanked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with its base spans as spaces, so that their parts are no terms."""
    out, end = [], 0
    for start, stop in sorted((start, stop) for _, start, stop in spans):
        if stop > end:
            start = max(start, end)
            out += [text[end:start], " " * (stop - start)]
            end = stop
    return "".join(out) + text[end:]


def contexts(text: str) -> list[tuple[int, list[int], int]]:
    """``(entity, terms beside it, signature)`` for each entity of a text."""
    spans = base_spans(text)
    if not spans:
        return []
    words = list(_WORD.finditer(blanked(text, spans)))
    starts = np.array([m.start() for m in words])
    out = []
    for kind, start, end in spans:
        at = int(np.searchsorted(starts, start))
        beside = [m.group() for m in words[max(0, at - WINDOW) : at + WINDOW]]
        terms = sorted({term(word) for word in beside})
        signature = _signed(xxhash.xxh64_intdigest(" ".join(beside).lower().encode()))
        out.append((entity(kind, text[start:end]), terms, signature))
    return out


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64()]
    names = ["doc", "entity", "terms", "signature"]
    for batch in batches:
        rows = [
            (doc, *found)
            for doc, text in rows_of(iter([batch]), "doc", "text")
            for found in contexts(text)
        ]
        if rows:
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=names)


class TermFilter:
    """A Bloom filter of one bit a term, as numbers of 64 bits."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.memo: dict[str, int | None] = {}

    def number(self, word: str) -> int | None:
        """The term of a lower-case word if the filter may hold it."""
        found = self.memo.get(word, 0)
        if found == 0:
            found = term(word)
            bit = np.uint64(found // FILTER_WORDS % 64)
            if not self.bits[found % FILTER_WORDS] >> bit & np.uint64(1):
                found = None
            if len(self.memo) > REMEMBERED:
                self.memo.clear()
            self.memo[word] = found
        return found

    def terms(self, text: str) -> set[int]:
        found = {self.number(word) for word in set(_WORD.findall(text.lower()))}
        found.discard(None)
        return found

    def places(self, text: str) -> list[tuple[int, int, int]]:
        rows = ((self.number(m.group().lower()), *m.span()) for m in _WORD.finditer(text))
        return [row for row in rows if row[0] is not None]


def term_filter(terms: DataFrame) -> TermFilter:
    """The filter of a table's ``term``; at most ``FILTER_WORDS`` rows come to the driver."""
    word = F.pmod("term", F.lit(FILTER_WORDS))
    above = F.expr(f"shiftright(term, {FILTER_WORDS.bit_length() - 1})")
    bit = F.pmod(above, F.lit(64)).cast("int")
    rows = terms.select(word.cast("int").alias("word"), bit.alias("bit")).distinct()
    bits = np.zeros(FILTER_WORDS, dtype=np.uint64)
    ored = rows.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit)) AS bits"))
    for row in ored.collect():
        bits[row.word] = np.uint64(row.bits & ((1 << 64) - 1))
    return TermFilter(bits)


def revealing_terms(docs: DataFrame) -> DataFrame:
    """``(term, disclosure)`` of the terms that disclose some entity; ``docs`` has text alone."""
    n = docs.count()
    numbered = docs.select(F.xxhash64("text").alias("doc"), "text")
    schema = "doc bigint, entity bigint, terms array<bigint>, signature bigint"
    seen = numbered.mapInArrow(_contexts, schema)
    seen = written(seen, "contexts")
    met = seen.select("entity", "doc", "signature", F.explode("terms").alias("term")).distinct()
    different = met.select("entity", "term", "signature").distinct().groupBy("entity", "term").count()
    enough = different.filter(F.col("count") >= CONTEXTS).select("entity", "term")
    enough = written(enough, "beside")

    kept = term_filter(enough.select("term"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        for (text,) in rows_of(batches, "text"):
            if "@" in text or _DIGIT.search(text):
                text = blanked(text, base_spans(text))
            for found in kept.terms(text):
                counts[found] = counts.get(found, 0) + 1
        columns = [pa.array(list(c), pa.int64()) for c in (counts.keys(), counts.values())]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "n"])

    everywhere = docs.select("text").mapInArrow(frequencies, "term bigint, n bigint")
    everywhere = everywhere.groupBy("term").agg(F.sum("n").alias("n_t"))
    # Copies of a text count as often as they occur, as they do in the frequencies.
    copies = numbered.groupBy("doc").agg(F.count("*").alias("copies"))
    together = met.select("entity", "term", "doc").distinct().join(enough, ["entity", "term"])
    owners = seen.select("entity", "doc").distinct()
    weight = owners.select("doc").distinct().join(copies, "doc")
    n_et = together.join(weight, "doc").groupBy("entity", "term").agg(F.sum("copies").alias("n_et"))
    n_e = owners.join(weight, "doc").groupBy("entity").agg(F.sum("copies").alias("n_e"))
    facts = n_et.join(n_e, "entity").join(everywhere, "term")
    information = F.log2(F.lit(float(n)) / F.col("n_e"))
    pmi = F.log2(F.col("n_et") * float(n) / (F.col("n_e") * F.col("n_t")))
    # An entity in every document has no information to disclose.
    known = facts.filter(F.col("n_e") < n).withColumn("disclosure", pmi / information)
    told = known.groupBy("term").agg(F.max("disclosure").alias("disclosure"))
    return written(told.filter(F.col("disclosure") >= GENERALISE), "revealing")


FOUND = T.StructType(
    [
        *[T.StructField(f"n_{kind}", T.LongType()) for kind in KINDS],
        T.StructField("base", T.StringType()),
        T.StructField(
            "places",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("term", T.LongType()),
                        T.StructField("start", T.LongType()),
                        T.StructField("end", T.LongType()),
                    ]
                )
            ),
        ),
    ]
)


def find_spans(docs: DataFrame) -> DataFrame:
    """``(doc_id, hash, n_*, base, terms)`` for every row: base spans as text, terms as an array.

    ``hash`` is the xxhash64 of the text; ``terms`` are ``(start, end, disclosure)`` by start.
    """
    docs = texts(docs)
    terms = revealing_terms(docs)
    kept = term_filter(terms)
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("hash", T.LongType()), *FOUND.fields]
    )
    place = pa.struct([("term", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
    kinds = [pa.int64()] * len(KINDS) + [pa.string(), pa.list_(place)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for (text,) in rows_of(iter([batch]), "text"):
                spans = base_spans(text)
                clear = blanked(text, spans)
                places = kept.places(clear) if kept.terms(clear) else []
                counts = [sum(s[0] == kind for s in spans) for kind in KINDS]
                base = ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)
                rows.append((*counts, base, [dict(zip(("term", "start", "end"), p)) for p in places]))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("hash"), *columns], names=schema.names
            )

    rows = docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("hash"))
    rows = rows.mapInArrow(run, schema).withColumn("uid", F.monotonically_increasing_id())
    rows = written(rows, "spans")
    places = rows.select("uid", F.inline("places")).join(terms, "term")
    # As many as the terms of one text at most.
    told = F.sort_array(F.collect_list(F.struct("start", "end", "disclosure"))).alias("terms")
    found = places.groupBy("uid").agg(told)
    return rows.drop("places").join(found, "uid", "left").drop("uid")


def personal_data(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` for every row.

    A null text is an empty one and has no spans: the digest is that of the empty text. Repeated
    rows and null ids each give a row; an empty table gives none.
    """
    rows = find_spans(docs)
    told = F.transform("terms", lambda t: F.concat_ws(":", F.lit(TERM), t.start, t.end))
    none = F.array().cast("array<string>")
    base = F.when(F.col("base") != "", F.array("base")).otherwise(none)
    spans = F.array_join(F.concat(base, F.coalesce(told, none)), ",")
    return rows.select(
        "doc_id",
        *[f"n_{kind}" for kind in KINDS],
        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
        spans.alias("spans"),
    )


def _sanitised(text: str, base: str, terms: list) -> str:
    """Base spans as their kind, terms as ``[TERM]`` or gone; overlapping spans are one."""
    spans = [s.split(":") for s in base.split(",") if s]
    marks = [(int(start), int(end), f"[{kind.upper()}]") for kind, start, end in spans]
    for t in terms or []:
        marks.append((t["start"], t["end"], "" if t["disclosure"] >= REMOVE else "[TERM]"))
    out, end = [], 0
    for start, stop, sign in sorted(marks):
        if start >= end:
            out += [text[end:start], sign]
        end = max(end, stop)
    return "".join(out) + text[end:]


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` sanitised and its other columns as they are.

    A null text stays null. Texts without spans stay as they are. Where there is an integer column
    ``n_chars``, it follows the text.
    """
    rows = find_spans(docs).filter((F.col("base") != "") | F.col("terms").isNotNull())
    marked_id, marked_hash, found = (
        free_name(docs, name) for name in ("marked_id", "marked_hash", "found")
    )
    marks = rows.select(
        F.col("doc_id").alias(marked_id),
        F.col("hash").alias(marked_hash),
        F.struct("base", "terms").alias(found),
    ).dropDuplicates([marked_id, marked_hash])
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(marked_id))
    same &= F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(marked_hash)
    met = docs.join(marks, same, "left")
    others = docs.columns
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marked = batch.column(found).to_pylist()
            clear = [
                text if text is None or mark is None else _sanitised(text, mark["base"], mark["terms"])
                for text, mark in zip(batch.column("text").to_pylist(), marked)
            ]
            columns = [
                pa.array(clear, pa.string()) if name == "text" else batch.column(name) for name in others
            ]
            yield pa.RecordBatch.from_arrays(columns, names=others)

    clean = met.mapInArrow(run, schema)
    if dict(docs.dtypes).get("n_chars") in ("int", "bigint"):
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.length("text").cast(kind)).select(*docs.columns)
    return clean
