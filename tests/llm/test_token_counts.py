import random

import pytest
from tokenizers import Regex, Tokenizer, normalizers
from tokenizers.models import Unigram

from pitlog.llm import token_counts as M

WORDS = "the and thion  ereston Ñdo año 漢字 naïve 😀 x1 <s> a\tb \n ~~ 𠜎 zzzzqq ▁ ▁▁ été".split(" ")


def texts(n=300):
    r = random.Random(5)
    made = [" ".join(r.choice(WORDS) for _ in range(r.randrange(40))) for _ in range(n)]
    return made + ["", " ", "\n", "a" * 5000, "漢" * 300, "  x  ", "é😀" * 50]


@pytest.fixture(scope="module")
def vocabulary():
    return M.read_vocabulary()


def test_counts_are_those_of_a_unigram_tokenizer(vocabulary):
    pieces, has_bytes = vocabulary
    count = M.Counts(pieces, has_bytes).count
    bytes_ = [(f"<0x{b:02X}>", -1e12) for b in range(256)]
    t = Tokenizer(Unigram([("<unk>", -1e12), *bytes_, *pieces], 0, True))
    t.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(Regex(" "), "▁")])
    # Its unknown score is the lowest of all minus 10, which the byte pieces here would shift;
    # so give them the lowest real score instead.
    low = min(s for _, s in pieces)
    t.model = Unigram([("<unk>", low), *[(p, low) for p, _ in bytes_], *pieces], 0, True)
    for text in texts():
        if "<0x" in text or not text:
            continue
        assert count(text) == len(t.encode(text, add_special_tokens=False).ids), repr(text)


def brute(text, pieces, unknown):
    """Best score by all segmentations, single characters as a fallback."""
    scores = dict(pieces)
    best = {0: 0.0}
    for end in range(1, len(text) + 1):
        tried = [best[s] + scores[text[s:end]] for s in range(end) if text[s:end] in scores]
        if text[end - 1] not in scores:
            tried.append(best[end - 1] + unknown)
        best[end] = max(tried)
    return best[len(text)]


def test_score_is_the_best_and_ties_take_the_longer_last_piece():
    pieces = [("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0), ("abb", -3.0)]
    best = M.segmenter(pieces, False)
    r = random.Random(1)
    for _ in range(300):
        t = "▁" + "".join(r.choice("abz▁") for _ in range(r.randrange(12)))
        assert best(t)[1] == brute(t, pieces, -13.0)
    assert best("▁ab") == (2, -3.0)  # "▁" + "ab" ties with "▁a" + "b": the longer last piece
    assert best("▁zz")[0] == 2 and best("▁za")[0] == 3  # unknown neighbours are one piece


def test_rows_pass_through(spark):
    df = spark.createDataFrame(
        [(1, "the and", "x"), (1, "the and", "x"), (None, None, None), (2, "", "y")],
        "doc_id long, text string, n_tokens_old string",
    )
    got = M.count_tokens(df).collect()
    assert sorted(r.n_tokens for r in got) == [0, 0, 4, 4]
    assert M.count_tokens(df.limit(0)).count() == 0
    assert M.count_tokens(df).columns == [*df.columns, "n_tokens"]
