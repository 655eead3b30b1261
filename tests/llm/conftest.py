import public_tokenizers
import pytest
from tokenizers import Tokenizer

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def byte_tokenizer():
    return Tokenizer.from_file(BYTES)


@pytest.fixture(scope="session")
def word_tokenizer():
    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="session")
def odd_texts():
    """Texts with nulls, empties, rare characters, special strings, copies and a very long one."""
    return [
        None, "", " ", "\n\n", "a", "Don't they're x'll 'sabc", "  two  blanks\n\t and\r\nmore ", "x<|endoftext|>y <|endoftext|>", "<|startoftext|>",
        "ÅÉİ ΣΑΣ ﬁ 한글 १२३ ½ 😀👍🏽", "é     z​", "!!!!'s''ll", "a" * 3_000, "ab " * 40_000, "same text again", "same text again", "\x00 nul \x00",
    ]


@pytest.fixture(scope="session")
def odd_documents(spark, odd_texts):
    rows = [(k, t, "en", f"src{k % 3}", "x", 1.5) for k, t in enumerate(odd_texts)]
    # A null id, a repeated row, and columns whose names the operators use inside.
    rows += [(None, "no id", None, None, None, None), rows[5]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, `group` string, n double")


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
