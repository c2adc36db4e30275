import random

import numpy as np
import pyarrow as pa
import pytest

from notewell.llm import token_counts
from notewell.llm.tokens import default_vocabulary, vocabulary

ODD = [None, "", " ", "  ", "a ", " a", "\n", "a   b", "x\u00a0y\u2003 z 1", "foo \n bar\n\n  baz", "é è  ñ", "it's 've \t a", "<|endoftext|> x", "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y  <|endoftext|>\n", "<|endoftext|", "  <|endoftext|>  z", "a" * 3000, "日本語 テキスト", "end \r\n", "\u0085 x"]


def _hf():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def _texts(n=60):
    rng = random.Random(5)
    words = ["the", "Ünïcode", "naïve", "x1", "42", "foo.bar", "'s", "don't", "—", "\n", "  ", "été"]
    return ODD + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(n)]


def test_ids_equal_those_of_the_tokenizers_library():
    texts, t = _texts(), _hf()
    v = vocabulary(default_vocabulary())
    for chunk in (texts, texts[::-1]):
        got = [ids[p[k] : p[k + 1]].tolist() for a, b, ids, p in v.encode(pa.array(chunk)) for k in range(b - a)]
        assert got == [t.encode(x or "", add_special_tokens=False).ids for x in chunk]


def test_lines_add_up_to_the_document(spark):
    texts, t = _texts(20), _hf()
    df = spark.createDataFrame([(i, x, "extra") for i, x in enumerate(texts)], "doc_id long, text string, n_tokens string")
    out = token_counts.attribute_tokens(df).toPandas()
    for i, x in enumerate(texts):
        rows = out[out.doc_id == i].sort_values("section")
        enc = t.encode(x or "", add_special_tokens=False)
        assert rows.n_tokens.sum() == rows.doc_tokens.iloc[0] == len(enc.ids)
        assert rows.char_start.iloc[0] == 0 and rows.char_end.iloc[-1] == len(x or "")
        if (x or "").isascii():
            for r in rows.itertuples():
                assert r.n_tokens == sum(r.char_start <= a < r.char_end for a, _ in enc.offsets)


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_rules_against_token_by_token_counting(rule):
    rng = np.random.default_rng(0)
    ends = np.cumsum(rng.integers(1, 6, 40))
    starts = np.concatenate([[0], ends[:-1]])
    a = rng.integers(0, ends[-1], 30)
    b = np.minimum(a + rng.integers(0, 20, 30), ends[-1])
    got = token_counts.count_within(starts, ends, a, b, rule)
    for x, y, n in zip(a, b, got):
        if rule == "share":
            want = sum(max(0, min(e, y) - max(s, x)) / (e - s) for s, e in zip(starts, ends))
        else:
            want = sum(x <= (s if rule == "first" else (s + e - 1) // 2) < y for s, e in zip(starts, ends))
        assert n == pytest.approx(want)


def test_given_sections(spark):
    kind = "doc_id long, text string, s array<struct<name:string,start:int,end:int>>"
    df = spark.createDataFrame([(1, "Hello world again", [("a", 0, 5), ("b", 3, 99)]), (2, "x", None), (3, None, [("c", 0, 9)])], kind)
    out = {(r.doc_id, r.name): r for r in token_counts.attribute_tokens(df, sections="s").toPandas().itertuples()}
    assert set(out) == {(1, "a"), (1, "b"), (3, "c")}
    assert out[1, "a"].n_tokens == 1 and out[1, "b"].n_tokens == 2 and out[1, "b"].char_end == 17 and out[3, "c"].n_tokens == 0
    assert token_counts.attribute_tokens(df.limit(0), sections="s").count() == 0
