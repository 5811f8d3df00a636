import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronotext.llm import tokens

regex = pytest.importorskip("regex")
ENCODER = tokens.PairIndexEncoder(open(tokens.tokenizer_file(), "rb").read())
SPLIT = regex.compile(tokens.PATTERN).findall


def ids(texts):
    return [[i for word in row for i in word] for row in ENCODER.encode_texts(texts, SPLIT)]


def plain(text):
    """The tokenizer's own rule, word by word: merge the leftmost pair of lowest rank until there is none."""
    out = []
    for word in SPLIT(text):
        parts = [bytes([b]) for b in word.encode()]
        while len(parts) > 1:
            ranks = [(ENCODER.ids.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, i = min(ranks)
            if rank == 1 << 30:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        out += [ENCODER.ids[p] for p in parts]
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_against_the_plain_rule_and_back(texts):
    got = ids(texts)
    assert got == [plain(t) for t in texts]
    assert [b"".join(ENCODER.bytes[i] for i in row).decode() for row in got] == texts


def test_against_the_library():
    library = pytest.importorskip("tokenizers")
    other = library.Tokenizer.from_file(tokens.tokenizer_file("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    texts = ["<|endoftext|> it's 12345  \n\n x", "a" * 20_001, "aaaa aaab" * 500, "é́ ﷺ 🙂\U0001f3fd‍", "\t\r\n ", "don't DON'T"]
    assert ids(texts) == [e.ids for e in other.encode_batch(texts, add_special_tokens=False)]


def test_rows_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Hello", "x"), (3, "Hello", "x"), (None, " Hello", "x")], "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id or 0, r.ids) for r in tokens.token_ids(df, doc_id=F.col("doc_id"), text=F.col("text")).collect())
    hello = ids(["Hello", " Hello"])
    assert got == [(0, hello[1]), (1, []), (2, []), (3, hello[0]), (3, hello[0])]
    assert tokens.token_ids(df.limit(0), doc_id=F.col("doc_id"), text=F.col("text")).collect() == []
