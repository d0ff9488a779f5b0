"""The pipeline against its stages in plain Python, on a small fixture and on its own invariants."""

import public_tokenizers
import pytest

import corpus_pipeline
from topicgrove.llm import piece_viterbi, quality_rules

from .test_duplicates import item_words, line_set, plain_components, plain_fingerprint, plain_line_groups, shingle_set

WORDS = "harbor ledger winter quiet river stone lantern meadow copper signal garden anchor ribbon thunder velvet orchard".split()


def sentence(seed, n=30):
    return " ".join(f"{WORDS[(seed * 7 + i * i + i * seed) % len(WORDS)]}{(seed * 31 + i) % 97}" for i in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("pipe"))
    item = sentence(900, 25)
    docs = [(i, "\n".join(sentence(10 * i + k) for k in range(4))) for i in range(12)]
    docs += [(20, docs[3][1]), (21, None), (22, ""), (23, "too short"), (24, "again and again and again and again and again and again and again"), (25, sentence(555) + " " + item + " " + sentence(556)), (26, docs[5][1] + "\n" + sentence(777))]
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "'en' lang", "'s' source", "cast(length(text) as long) n_chars").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "never found anywhere at all here")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, docs, [item]


def test_stages_equal_plain_python(spark, folder):
    d, docs, items = folder
    kept = [(i, t) for i, t in docs if quality_rules.profile(t)[-1]]
    drop, _ = plain_line_groups(kept)
    lined = []
    for i, t in kept:
        lines = [x for k, x in enumerate(t.split("\n")) if (i, k) not in drop]
        if any(x.strip() for x in lines):
            lined.append((i, "\n".join(lines)))
    component = plain_components({i: plain_fingerprint(t) for i, t in lined})
    single = [(i, t) for i, t in lined if component[i] == i]
    clean = []
    for i, t in single:
        shingles = shingle_set(item_words(t), 5)
        if not any(len(shingle_set(item_words(x), 5) & shingles) >= 0.8 * len(shingle_set(item_words(x), 5)) for x in items):
            clean.append((i, t))
    model = piece_viterbi.piece_model(public_tokenizers.path("piece_bpe_32k.model"))
    got = corpus_pipeline.run(spark, d).collect()
    assert {r["doc_id"]: r["text"] for r in got} == dict(clean)
    assert len(got) == len(clean) >= 10 and 25 not in dict(clean) and 20 not in dict(clean) and line_set("a b")
    for r in got:
        assert r["decoded_ok"] and model.decode(__import__("numpy").array(r["piece_ids"], "<i4")) == r["text"]


def test_stages_keep_the_columns_and_take_empty_tables(spark, folder):
    d, _, _ = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for some in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, some, d)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality rules" and corpus_pipeline.ORACLE_SQL is None
