"""Ids, counts and pieces against the tokenizer libraries."""

import base64
import hashlib
import random
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from flowloop.llm import byte_bpe, packing, token_counts
from flowloop.llm.word_bpe import WordBpe
from tests.llm.conftest import ODD

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _random_text(seed, n, *ranges):
    rng = random.Random(seed)
    return "".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(n))


HARD = [
    "",
    " ",
    "\n\n  x\t\ty ",
    "don't can't I'll we've !!'s 's 'S it's'll",
    "日本語 ÀÉ é İstanbul ΣΑΣ ſ ﬁ Ⅷ ²³ ½ ٣",
    "a　b\x1cc\x1f d\x85e\xa0f",
    "<|endoftext|> x<|startoftext|>y <s></s><unk>",
    "\x00\x01",
    "▁▁a ▁b",
    "a" * 5000,
    "ab" * 700,
    "1234567890" * 40,
    "🙂🙃" * 30,
    "----====----" * 30,
    _random_text(1, 2000, (97, 123)),
    _random_text(2, 2000, (32, 127), (160, 0x2FFF), (0x4E00, 0x9FFF)),
]


@pytest.fixture(scope="module")
def all_texts(sample):
    return HARD + [r.text for r in sample.collect()]


@pytest.fixture(scope="module")
def tiktokens():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def test_word_bpe_of_long_and_odd_words():
    """Long words by the library, in time that follows their length; letters beyond ASCII."""
    rng = random.Random(9)
    texts = ["w" * 1_000_000, "x" * 256 + " " + "x" * 257, "<|endoftext|>" + "Z" * 300, "İ ŞİM ǅ ŉ ß"]
    texts += [f"a{chr(c)} {chr(c)}b {chr(c)}{chr(c)}" for c in range(0x80, 0x250)]
    for _ in range(300):
        texts.append("".join(chr(rng.choice([32, rng.randrange(33, 0x250)])) for _ in range(50)))
    start = time.perf_counter()
    got = WordBpe(WORDS).encode(texts)
    assert time.perf_counter() - start < 30
    library = Tokenizer.from_file(WORDS)
    for text, ids in zip(texts, got, strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, dtype="<u4").tolist() == want


def test_byte_bpe(all_texts, tiktokens):
    bpe = byte_bpe.ByteBpe(RANKS, public_tokenizers.PATTERN)
    for text, (n, ids, raw) in zip(all_texts, bpe.encode(all_texts)):
        want = tiktokens.encode_ordinary(text)
        assert (n, ids) == (len(want), ",".join(map(str, want)))
        assert raw == text.encode() == tiktokens.decode_bytes(want)


def test_byte_bpe_starts_anew(monkeypatch, tiktokens):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 5)
    bpe = byte_bpe.ByteBpe(RANKS, public_tokenizers.PATTERN)
    for text in ["one two three four", "five six seven eight", "one nine"] * 2:
        assert next(bpe.encode([text]))[1] == ",".join(map(str, tiktokens.encode_ordinary(text)))


def test_byte_bpe_many_rounds(monkeypatch, tiktokens):
    """Queries of few rounds hand their unfinished words on."""
    monkeypatch.setattr(byte_bpe, "QUERY_ROWS", 50)
    bpe = byte_bpe.ByteBpe(RANKS, public_tokenizers.PATTERN)
    for text in HARD:
        assert next(bpe.encode([text]))[1] == ",".join(map(str, tiktokens.encode_ordinary(text)))


def as_tiktoken(bpe, tiktokens, texts):
    for text, (n, ids, raw) in zip(texts, bpe.encode(texts), strict=True):
        want = tiktokens.encode_ordinary(text)
        assert (n, ids) == (len(want), ",".join(map(str, want))) and raw == text.encode()


def test_byte_bpe_splices_long_words(monkeypatch, tiktokens):
    """Words of every kind beyond the limit, spliced from pieces and windows of odd sizes."""
    rng = random.Random(6)
    texts = []
    for _ in range(60):
        n = rng.randrange(90, 700)
        some = "abcdefghijklmnopqrstuvwxyz"[: rng.choice([1, 2, 3, 26])]
        texts.append("".join(rng.choice(some) for _ in range(n)))
        texts.append("".join(rng.choice("éäßабвг日本語a") for _ in range(n)))
        texts.append(rng.choice(["=", "-", " ", "\n", "the", "ing", "0", "!?"]) * n)
    as_tiktoken(byte_bpe.ByteBpe(RANKS, public_tokenizers.PATTERN), tiktokens, texts)
    monkeypatch.setattr(byte_bpe, "LONG", 5)
    monkeypatch.setattr(byte_bpe, "PIECE", 3)
    monkeypatch.setattr(byte_bpe, "WINDOW", 1)
    as_tiktoken(byte_bpe.ByteBpe(RANKS, public_tokenizers.PATTERN), tiktokens, texts[:40] + HARD)


def test_byte_bpe_contracts_a_word_once(monkeypatch, tiktokens):
    """A worker meets hundreds of thousands of words; those it has met are not contracted again."""
    bpe = byte_bpe.ByteBpe(RANKS, public_tokenizers.PATTERN)
    contracted = []
    contract = bpe.contract
    monkeypatch.setattr(bpe, "contract", lambda words: contracted.extend(words) or contract(words))
    text = " ".join(map(str, range(310_000)))
    for more, new in (("", 310_000), (" one", 1), (" one, two", 2), ("", 0)):
        contracted.clear()
        as_tiktoken(bpe, tiktokens, [text + more])
        assert len(set(contracted)) == len(contracted) == new


def test_byte_bpe_forgets_long_words_only(tiktokens):
    """Long words and chunks among others, in one call and over several."""
    long = "x" * 97
    texts = [f"a {long} b", "", f"{long},{long} a", f"new{' ' * 200}b", "a b new", "\n" * 300, f"é{long}"]
    bpe = byte_bpe.ByteBpe(RANKS, public_tokenizers.PATTERN)
    assert list(bpe.encode([])) == []
    for some in (texts, texts[::-1], texts[4:], [""], *([text] for text in texts)):
        as_tiktoken(bpe, tiktokens, some)
        assert not any(len(known) > byte_bpe.LONG for known in [*bpe.words, *bpe.chunks])
    assert {"a", " b", "new"} <= {*bpe.words} and {"a", " b", " new"} <= {*bpe.chunks}


def test_byte_bpe_decodes_long_words_in_parts(monkeypatch, tiktokens):
    """Words of more ids than one query decodes, also several words in a query."""
    bpe = byte_bpe.ByteBpe(RANKS, public_tokenizers.PATTERN)
    [space] = set(tiktokens.encode_ordinary(" " * 1000))  # the pattern of the library stops at millions
    n, ids, raw = next(bpe.encode([" " * 3_200_000]))
    assert (n, ids) == (3_200_000, ",".join([str(space)] * n)) and raw == b" " * n
    monkeypatch.setattr(byte_bpe, "QUERY_IDS", 37)
    texts = ["xyz" * n + " " + "é=" * n + "=" * n + " \n" * n for n in (97, 99, 130, 401)]
    for some in (texts, texts[:1], [" ".join(texts)]):
        as_tiktoken(bpe, tiktokens, some)


def test_byte_bpe_keeps_words_without_chunks(monkeypatch, tiktokens):
    monkeypatch.setattr(byte_bpe, "CHUNKS", 5)
    bpe = byte_bpe.ByteBpe(RANKS, public_tokenizers.PATTERN)
    for text in ["one two three, four. five! six?", "one, two three four", "nine one"] * 2:
        as_tiktoken(bpe, tiktokens, [text])
        assert set(bpe.pattern.findall(text)) <= {*bpe.words}


def test_byte_bpe_within_its_memory(tiktokens):
    """Long words, and many of them, in a database of MEMORY and in time that follows their length."""
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz"

    def word(n):
        return "".join(rng.choices(letters, k=n))

    bpe = byte_bpe.ByteBpe(RANKS, public_tokenizers.PATTERN)
    start = time.perf_counter()
    as_tiktoken(bpe, tiktokens, ["a" * 2_000_000])
    as_tiktoken(bpe, tiktokens, [word(2_000_000)])
    as_tiktoken(bpe, tiktokens, [word(90) + " " for _ in range(11_000)])
    assert time.perf_counter() - start < 180
    assert max(map(len, bpe.words)) <= byte_bpe.LONG and max(map(len, bpe.chunks)) <= byte_bpe.LONG


def test_round_trips(odd, none, tiktokens):
    got = byte_bpe.round_trips(odd, RANKS, public_tokenizers.PATTERN).collect()
    want = []
    for i, text in ODD:
        ids = tiktokens.encode_ordinary(text or "")
        digests = (hashlib.sha256(x).hexdigest() for x in (",".join(map(str, ids)).encode(), (text or "").encode()))
        want.append((i, len(ids), *digests))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    whole = byte_bpe.round_trips(odd, RANKS, public_tokenizers.PATTERN, with_ids=True).collect()
    assert sorted(bytes(r.decoded) for r in whole) == sorted((t or "").encode() for _, t in ODD)
    assert byte_bpe.round_trips(none, RANKS, public_tokenizers.PATTERN).collect() == []


def test_word_bpe(all_texts):
    library = Tokenizer.from_file(WORDS)
    letters = [chr(c) for c in range(1, 0x300)]
    all_texts = all_texts + [f"x{c}y {c}Z 1{c}" for c in letters] + [a + b for a in "aÉ'" for b in letters]
    ours = WordBpe(WORDS).encode(all_texts)
    for text, ids in zip(all_texts, ours):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("chunk", "overlap"), [(500, 16), (97, 1), (2000, 64)])
def test_resynchronised_counts(all_texts, chunk, overlap):
    counter = token_counts.PieceCounter(PIECES)
    joined = [" ".join(all_texts[i : i + 20]) for i in range(0, 200, 20)]
    for text in all_texts + joined + ["".join(HARD)]:
        assert counter.count(text, chunk, overlap) == len(counter.library.encode(text))


def test_token_counts(odd, none):
    counter = token_counts.PieceCounter(PIECES)
    want = [
        (i, len((t or "").encode()), n := len(counter.library.encode(t or "")), n > 4096) for i, t in ODD
    ]
    got = token_counts.token_counts(odd, PIECES).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts.token_counts(none, PIECES).collect() == []


def check_packing(rows, packed, length=packing.LENGTH):
    library = Tokenizer.from_file(WORDS)
    want = []
    for i, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), length)):
            part = np.array(ids[at : at + length], dtype="<u4")
            want.append((i, piece, at, len(part), zlib.crc32(part.tobytes())))
    got = packed.collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        ends = [0, *(o + n for o, n in sorted(places))]
        assert [o for o, _ in sorted(places)] == ends[:-1] and ends[-1] <= length
    return len(bins), np.array([w[3] for w in want])


def test_packing(odd, none, sample):
    check_packing(ODD, packing.pack_documents(odd, WORDS))
    assert packing.pack_documents(none, WORDS).collect() == []
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    used, sizes = check_packing(rows, packing.pack_documents(sample, WORDS))
    assert used <= packing.lower_bound(sizes) + 1


def test_parts_exchange(spark, sample, monkeypatch):
    """With parts of 16 pieces most have a gap, which the exchange makes smaller."""
    monkeypatch.setattr(packing, "PART", 16)
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    used, sizes = check_packing(rows, packing.pack_documents(sample, WORDS))
    monkeypatch.setattr(packing, "ROUNDS", 1)
    alone, _ = check_packing(rows, packing.pack_documents(sample, WORDS))
    assert packing.lower_bound(sizes) <= used < alone


def test_bound_and_best_fit():
    rng = np.random.default_rng(1)
    for _ in range(200):
        sizes = rng.integers(1, 21, rng.integers(1, 9))
        bins, offsets = packing.best_fit_decreasing(sizes, 20)
        used = bins.max() + 1
        for b in range(used):
            mine = np.argsort(offsets[bins == b])
            ends = np.cumsum(sizes[bins == b][mine])
            assert ends[-1] <= 20 and (offsets[bins == b][mine] == ends - sizes[bins == b][mine]).all()
        assert packing.lower_bound(sizes, 20) <= fewest(sorted(sizes.tolist(), reverse=True), 20) <= used


def fewest(sizes, length):
    """The least number of bins, by trying everything."""
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for at in {r: k for k, r in enumerate(rooms) if r >= sizes[i]}.values():
            place(i + 1, [r - sizes[i] * (k == at) for k, r in enumerate(rooms)])
        place(i + 1, [*rooms, length - sizes[i]])

    place(0, [])
    return best
