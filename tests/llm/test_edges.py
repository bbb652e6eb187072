"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import public_tokenizers
import pytest

import corpus_pipeline
from tracktally.llm import byte_bpe, dart_minhash, html_main, mixing, quality_rda, quality_rules, secret_links, shards, syncmers, toxic_ordinal

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
LONG = "word " * 30_000 + "x" * 50_000
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, kept string, secrets int, ids string, decoded int,"
    " keys string, grp int, node int, size int, at int, score string, features int, anchors int, row int, `a.b` int"
)
TEXTS = [None, "", "same text here", "same text here", LONG, "é😀 password: hunter2hunter2 ok", "\n\t \n", "a"]


def rows():
    made = [(i, t, "en", "s" if i % 3 else None, 1) for i, t in enumerate(TEXTS)] + [(2, "same text here", "en", "s", 1), (None, "null id", None, None, None)]
    return [r + (None,) * 14 for r in made]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (2, 0, 1), (None, 1, 1), (4, None, None), (99, 1, 0)], "doc_id long, quality int, toxic int")


def operators(labels):
    return {
        "rules": lambda d: quality_rules.quality_cascade(d, counts=True),
        "secrets": secret_links.scan_secrets,
        "redact": secret_links.redact_secrets,
        "slots": lambda d: shards.number_slots(d.select("doc_id", shards.shard_of(d["doc_id"], 3).alias("shard")), "shard"),
        "html": lambda d: html_main.extract_main(d, "text", "main"),
        "bpe": lambda d: byte_bpe.decode_bpe(byte_bpe.encode_bpe(d, PATH, public_tokenizers.PATTERN), PATH),
        "dart": dart_minhash.near_duplicates,
        "quality": lambda d: quality_rda.score_quality(d, labels),
        "toxic": lambda d: toxic_ordinal.score_toxicity(d, labels),
        "mix": mixing.mix_sizes,
        "anchors": syncmers.find_anchors,
        "fingerprint": syncmers.fingerprint,
        "edits": syncmers.fingerprint_edits,
    }


@pytest.mark.parametrize("name", list(operators(None)))
def test_every_row_is_answered(docs, labels, name):
    run = operators(labels)[name]
    assert len(run(docs).collect()) == len(rows())
    assert run(docs.limit(0)).collect() == []


def test_stages_take_extra_columns_and_empty_tables(spark, docs):
    folder = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES[:4]:
        made = stage(spark, docs, folder)
        assert made.columns == docs.columns, name
        made.collect()
        assert stage(spark, docs.limit(0), folder).collect() == [], name
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    assert corpus_pipeline.token_stage(spark, plain, folder).count() == len(rows())


def test_defined_results(docs, labels):
    cut = quality_rules.quality_cascade(docs).select("doc_id", "kept").collect()
    assert not any(r.kept for r in cut if r.doc_id in (0, 1, 7))
    classes = {r.doc_id: r.class_id for r in dart_minhash.near_duplicates(docs).collect()}
    assert classes[0] == classes[1] == classes[6] == 0 and classes[2] == classes[3] == 2 and classes[7] == 7
    ids = {r.doc_id: (list(r.ids), bytes(r.decoded)) for r in operators(labels)["bpe"](docs).select("doc_id", "ids", "decoded").collect()}
    assert ids[0] == ([], b"") and ids[4][1] == LONG.encode()
    prints = {r.doc_id: r.fingerprint for r in syncmers.fingerprint(docs).select("doc_id", "fingerprint").collect()}
    assert prints[0] == "" and prints[2] == prints[3] != prints[7]


def test_classes_that_share_their_smallest_id(spark):
    near = [f"w{i}" for i in range(60)]
    rows = [
        (None, "one text without an id"),
        (None, "another one, unlike the first"),
        (None, "one text without an id"),
        (3, "a text under an id that repeats"),
        (3, "unrelated words of the same id"),
        (5, " ".join(near)),
        (4, " ".join([*near[:-1], "end"])),
        (None, " ".join(["start", *near[1:]])),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = dart_minhash.near_duplicates(docs)
    assert found.select("cls").distinct().count() == 5
    kept = sorted(tuple(r) for r in dart_minhash.keep_one(docs).na.fill(-1).collect())
    assert kept == sorted((-1 if i is None else i, t) for i, t in {*rows[:2], rows[3], rows[4], rows[6]})
