import numpy as np

from quire.llm import arrowfile, queries, tokens


def test_token_files_remember_more_chunks_than_packing():
    path = queries.vocabulary(queries.BYTE_VOCABULARY)
    large, small = tokens.JsonEncoder(path, arrowfile.KNOWN), tokens.JsonEncoder(path, 30)
    assert large.spaced.size > tokens.JsonEncoder(path).spaced.size  # before: one size for all
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice([*"abcdeéß.,"], 6)) for _ in range(300)]
    for _ in range(20):
        text = " ".join(rng.choice(words, 60))
        assert large.encode(text) == small.encode(text)
