"""Columns of any name pass through every operator, and none of them meets an operator's own."""

import public_tokenizers
import pytest

from topicgrove.llm import decontamination, license_scan, line_dedup, pii, piece_viterbi, quality_rules, sharding, simhash, token_binary, token_counts
from topicgrove.llm import queries

TEXT = "one two three four five six seven eight nine ten eleven\nall rights reserved by a@b.cc"
NAMES = ["_id", "_hash", "_kept", "_found", "_cell", "_base", "_measured", "_encoded", "_nth", "_key", "_word", "_bits", "c0", "c1", "N_WORDS", "Kept", "SCAN", "Pii", "Decoded_OK", "a.b", "k1", "fp", "words", "item_id", "size"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t) for i, t in [(1, TEXT), (2, TEXT), (2, TEXT), (3, None), (None, ""), (4, "a word or two " * 30)]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for i, n in enumerate(NAMES):
        df = df.selectExpr("*", f"{i} as `{n}`")
    return df


def spread(df):
    return [r.asDict() for r in df.collect()]


KEEPING = {
    "lines": lambda d, i: line_dedup.without_repeated_lines(d),
    "prints": lambda d, i: simhash.one_of_each(d),
    "benchmark": lambda d, i: decontamination.decontaminated(d, i),
    "quality": lambda d, i: quality_rules.quality_profile(d),
    "pieces": lambda d, i: piece_viterbi.encode_pieces(d, public_tokenizers.path("piece_bpe_32k.model")),
    "licences": lambda d, i: license_scan.license_scan(d),
    "pii": lambda d, i: pii.personal_data(d),
}


@pytest.mark.parametrize("name", KEEPING)
def test_columns_pass_through(spark, odd, name):
    items = spark.createDataFrame([(1, "never found anywhere at all here")], "item_id long, text string")
    out = KEEPING[name](odd, items)
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    new = {c.lower() for c in out.columns} - {c.lower() for c in odd.columns}
    rows = spread(out)
    assert rows
    for i, n in enumerate(NAMES):
        if n in out.columns and n.lower() not in {"n_words", "kept", "scan", "pii", "decoded_ok"} | new:
            assert {r[n] for r in rows} == {i}, n
    assert not spread(KEEPING[name](odd.limit(0), items))


def test_other_operators_ignore_columns(spark, odd):
    items = spark.createDataFrame([(1, TEXT)], "item_id long, text string")
    assert decontamination.contaminated(odd, items).count() == 2
    assert simhash.simhash_components(odd).count() == 6
    assert line_dedup.line_report(odd).count() == 6
    assert sharding.balanced_shards(odd, 3).count() == 6
    assert token_counts.encoded_lengths(odd, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 6
    assert token_binary.token_file_index(odd, public_tokenizers.path("word_bpe_49k.json"), queries.END_ID).count() == 6


def test_rows_of_one_id_are_documents_of_their_own(spark):
    """Null ids and ids that repeat with other texts: only near copies go, and rows that repeat one."""
    texts = ["alpha beta gamma delta epsilon zeta eta theta", "red green blue yellow black white brown pink", "one two three four five six seven"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[0]), (8, texts[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["text"]) for r in simhash.one_of_each(df).collect()), key=str)
    assert got == sorted([(None, texts[1]), (7, texts[2]), (7, texts[0])], key=str)
