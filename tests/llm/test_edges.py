"""Each operator over nulls, empty and long texts, repeated rows, clashing columns, and no rows."""

import pytest

import corpus_pipeline
from recurra.llm import chat, decontaminate, licenses, media, ngram_lm, packing, simhash, substring_dedup, suffix_dedup, toxicity

LONG = " ".join(f"w{i % 977}x" for i in range(20_000))
ROWS = [
    (1, None), (2, ""), (3, "   \n\t "), (4, LONG), (5, "one two"), (6, "one two"), (6, "one two"), (None, "no id here"), (8, "é" * 150), (9, "Ünïcode 😀 text " * 20),
    (10, None), (None, None), (11, "a"),
]
SCHEMA = "doc_id long, text string"


def tables(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "'en' AS lang", "CAST(NULL AS string) AS source", "1L AS n_chars", "1 AS part", "2 AS row", "3 AS h", "4 AS toxicity", "5 AS kept", "6 AS simhash")
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(0, None), (1, ""), (2, "one two"), (3, " ".join(LONG.split()[:12]))], "item_id long, text string")
    return docs, labels, bench


def every(docs, labels, bench):
    return {
        "packing": packing.pack_documents(docs),
        "toxicity": toxicity.score(docs, toxicity.fit(docs, labels)),
        "media": media.digest_media(media.encode_text(docs)),
        "pages": media.read_pages(media.encode_text(docs)),
        "lm": ngram_lm.lm_scores(docs),
        "words": substring_dedup.remove_repeated_spans(docs),
        "simhash": simhash.near_duplicates(docs),
        "near": simhash.near_texts(docs),
        "contamination": decontaminate.contamination(docs, bench),
        "licenses": licenses.license_scan(docs),
        "bytes": suffix_dedup.remove_repeated_strings(docs, carry=("lang", "source")),
    }


ONE_ROW_EACH = ("toxicity", "media", "lm", "words", "simhash", "contamination", "licenses", "bytes")


def test_edge_rows(spark):
    found = {k: df.collect() for k, df in every(*tables(spark)).items()}
    for name in ONE_ROW_EACH:
        assert len(found[name]) == len(ROWS), name
    assert sum(r.length for r in found["packing"] if r.doc_id == 1) == 1
    hit = {r.doc_id: r.n_hit for r in found["contamination"]}
    assert hit[5] == 2 and hit[4] >= 12 and hit[1] == 0
    words = {r.doc_id: (r.n_words, r.n_removed) for r in found["words"]}
    assert words[1] == (0, 0) and words[4][1] > 10_000 and words[6] == (2, 0)
    assert {r.component_id for r in found["simhash"] if r.doc_id in (5, 6)} == {5}
    assert len(found["near"]) == len(ROWS) and {r.component_id for r in found["near"] if r.doc_id in (5, 6)} == {5}


def test_no_rows(spark):
    docs, labels, bench = tables(spark)
    for name, df in every(docs.limit(0), labels.limit(0), bench.limit(0)).items():
        assert df.collect() == [], name


def test_empty_conversations(spark):
    rows = spark.createDataFrame([(1, 0, None, None), (1, 0, "user", "x"), (None, 1, "assistant", "")], "conv_id long, turn int, role string, text string")
    made = chat.format_chat(chat.canonical_turns(rows)).collect()
    assert len(made) == 2
    assert chat.format_chat(chat.canonical_turns(rows.limit(0))).collect() == []


def test_pipeline_keeps_columns(spark, tmp_path):
    docs, labels, bench = tables(spark)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.select(*corpus_pipeline.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS, name
    assert docs.count() > 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_pipeline_decides_by_row(spark, tmp_path):
    own = lambda i: " ".join(f"t{i}w{j * (i + 3) % 701}" for j in range(40))
    clean = [(None, own(1)), (None, own(2)), (None, own(3)), (7, own(4)), (7, own(5)), (8, own(6))]
    leak = " ".join(f"item{j}" for j in range(12))
    rows = [*clean, (None, f"{own(7)} {leak}"), (7, f"{own(8)} {leak}")]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "text", "'en' AS lang", "'web' AS source", "length(text) AS n_chars")
    docs.withColumn("n_chars", docs.n_chars.cast("long")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        kept = {(r.doc_id, r.text) for r in docs.collect()}
        assert set(clean) <= kept, name
    assert kept == set(clean)


@pytest.mark.parametrize("make", [lambda d: packing.pack_documents(d, 0), lambda d: media.encode_text(d, "zip"), lambda d: decontaminate.contamination(d, d, 3, 4)])
def test_bad_parameters(spark, make):
    with pytest.raises(ValueError):
        make(tables(spark)[0])


def test_very_long_texts(spark):
    """Texts of a few million bytes, twice and with much that repeats inside; blanks and lines without end."""
    long = " ".join(f"v{i * 7919 % 500_009}" for i in range(300_000))
    rows = [(1, long), (2, "x" * 3_000_000), (3, long[1000:] + " tail"), (4, "\n" * 1_000_000)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'en' AS lang", "'s' AS source")
    bench = spark.createDataFrame([(1, long[500_000:500_200])], "item_id long, text string")
    gone = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeated_strings(docs).collect()}
    assert gone == {1: 0, 2: 3_000_000 - 1, 3: len(long) - 1000, 4: 1_000_000 - 1} or gone[3] == len(long) - 1000 + 1
    words = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.remove_repeated_spans(docs).collect()}
    n = len(long[1000:].split())
    assert words[1] == (300_000, 0) and words[2] == (1, 0) and words[4] == (0, 0) and words[3][0] == n + 1 and n - 1 <= words[3][1] <= n
    hits = {r.doc_id: r.n_hit for r in decontaminate.contamination(docs, bench).collect()}
    assert hits[1] == hits[3] > 20 and hits[2] == 0
    for df in (licenses.license_scan(docs), simhash.near_duplicates(docs), simhash.near_texts(docs), ngram_lm.lm_scores(docs), media.digest_media(media.encode_text(docs))):
        assert df.count() == 4
