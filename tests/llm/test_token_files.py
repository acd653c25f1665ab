import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowloop.llm import token_files as files
from flowloop.llm.queries import op11_token_files
from flowloop.session import work_path
from tests.conftest import SF_DIR, plan_of
from tests.llm.conftest import ODD, documents

WORDS = public_tokenizers.path("word_bpe_49k.json")
COLUMNS = ["doc_id", "start", "n_tokens", "ids_crc32"]


def plain_rows(rows):
    """``(doc_id, n_tokens, ids_crc32)`` as the library gives the ids."""
    library = Tokenizer.from_file(WORDS)
    out = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc_id, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
    return out


def test_whole_table(spark, sample):
    rows = sorted((r.doc_id, r.text) for r in sample.collect())
    want, start = [], 0
    for doc_id, n, crc in plain_rows(rows):
        want.append((doc_id, start, n, crc))
        start += n
    got = op11_token_files(spark, SF_DIR).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == want


def test_odd_rows(spark, odd, none):
    got = files.token_files(odd, WORDS).select(*COLUMNS).collect()
    want = plain_rows(ODD)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter(want)
    got.sort(key=lambda r: r.start)
    ends = np.cumsum([r.n_tokens for r in got]).tolist()
    assert [r.start for r in got] == [0, *ends[:-1]]
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    assert files.token_files(none, WORDS).collect() == []
    assert files.token_files(odd, WORDS).schema == files.token_files(none, WORDS).schema


def test_hot_id_is_spread(spark):
    """Rows of one id do not all go to one file, and their places are gapless still."""
    rows = [(7, f"text {i % 5}") for i in range(3000)] + [(i, "other") for i in range(100)]
    docs = documents(spark, rows).repartition(4)
    with_aqe = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tokens = files.encoded(docs, WORDS).cache()
        sizes = tokens.groupBy("file").count().collect()
        assert len(sizes) == 4 and max(r["count"] for r in sizes) < 1500
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", with_aqe)
    got = files.token_files(docs, WORDS).orderBy("start").collect()
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert [r.doc_id for r in got] == sorted(i for i, _ in rows)


def orc_footers(spark, path):
    """For each file: stripes, and kinds of encodings and streams of the first one."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    for status in sorted(fs.listStatus(folder), key=lambda s: s.getPath().getName()):
        if not status.getPath().getName().endswith(".orc"):
            continue
        options = jvm.org.apache.orc.OrcFile.readerOptions(conf)
        reader = jvm.org.apache.orc.OrcFile.createReader(status.getPath(), options)
        stripes = reader.getStripes()
        if not len(stripes):
            continue
        footer = reader.rows().readStripeFooter(stripes[0])
        kinds = [c.getKind().toString() for c in footer.getColumnsList()]
        streams = [(s.getColumn(), s.getKind().toString()) for s in footer.getStreamsList()]
        yield len(stripes), kinds, streams, reader.getCompressionKind().toString()


def test_files(spark, sample):
    """Stripes, run-length encodings, row indexes and Bloom filters are in the files; a scan cuts
    a file by stripes, and a look-up reads few rows."""
    path = work_path(spark, "small_stripes")
    docs = sample.withColumn("doc_id", F.col("doc_id") * 1000)
    copies = docs.crossJoin(spark.range(20)).withColumn("doc_id", F.col("doc_id") + F.col("id"))
    files.write_tokens(copies, path, WORDS, stripe_bytes=1 << 16, index_rows=1000)
    told = list(orc_footers(spark, path))
    assert told
    for stripes, kinds, streams, compression in told:
        # Columns: the row, doc_id, file, before, n_tokens, ids and their elements.
        assert kinds[1:] == ["DIRECT_V2"] * 6 and compression == "ZSTD"
        kept = {kind for column, kind in streams if column == 1}
        assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kept
        assert ("BLOOM_FILTER_UTF8" in {k for c, k in streams if c != 1}) is False
    assert max(t[0] for t in told) > 1

    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 16))
    try:
        scan = spark.read.schema(files.FILES).orc(path)
        assert scan.rdd.getNumPartitions() > len(told)
        cut = scan.select("doc_id", F.size("ids").alias("n"), "n_tokens")
        assert cut.filter("n = n_tokens").count() == copies.count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)

    # No ids are shuffled to learn where a file starts.
    assert "BroadcastHashJoin" in plan_of(files.read_tokens(spark, path))

    wanted = [1000 * 17 + 3, 1000 * 150, 5, 999]
    looked_up = files.read_tokens(spark, path, wanted)
    assert "PushedFilters: [In(doc_id" in plan_of(looked_up).replace("IsNotNull(doc_id), ", "")
    whole = {r.doc_id: tuple(r) for r in files.read_tokens(spark, path).collect()}
    want = sorted(whole[i] for i in wanted if i in whole)
    assert sorted(tuple(r) for r in looked_up.collect()) == want and len(want) == 3

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        one = spark.read.schema(files.FILES).orc(path).filter(F.col("doc_id").isin([17_003]))
        assert len(one.collect()) == 1
        scan = one._jdf.queryExecution().executedPlan().collectLeaves().head()
        assert scan.metrics().apply("numOutputRows").value() < copies.count() / 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_text_beyond_a_batch(spark, monkeypatch):
    monkeypatch.setattr(files, "BATCH_IDS", 100)
    rows = [(i, "some words " * (i % 50)) for i in range(60)]
    got = files.token_files(documents(spark, rows), WORDS).select(*COLUMNS).collect()
    want = plain_rows(rows)
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)
