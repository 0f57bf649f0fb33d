import json

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from allelic.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
THEIRS = Tokenizer.from_file(PATH)
OURS = bpe.Coder(bpe.Vocabulary(json.load(open(PATH))))
ODD = ["", " ", "<|endoftext|>", "a<|endoftext|>b  <|endoftext|>", " \x1c\x1d x", "   a　b", "aaaa aaaaaaaaaa 1234567890 ½²", "日本語テキスト 🎉👩‍👩‍👧 é", "don't I'LL's", "   leading\n\n\n tabs\t\t x ", "\x00\x01", "ﬁ İ ı ß", "x" * 3000, "<|endoftext"]


def test_odd_texts():
    for got, want in zip(OURS.encode(ODD), THEIRS.encode_batch(ODD, add_special_tokens=False), strict=True):
        assert got == want.ids
        assert OURS.decode(want.ids) == THEIRS.decode(want.ids, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("abthein g's\n\t 01")), max_size=60))
def test_any_text(text):
    assert OURS.encode([text])[0] == THEIRS.encode(text, add_special_tokens=False).ids


def test_plain_merging_agrees():
    v = OURS.v
    for word in ("tokenization", " unbelievably", "aaaaaaa", "éàü"):
        assert [v.id_of[t] for t in v.merge(word.encode())] == dict(v.walk([word.encode()]))[word.encode()]


def test_columns(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (2, None, None), (None, "", "y")], "doc_id long, text string, ids string").drop("ids")
    out = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert sorted((r["text"] or "") for r in out) == sorted(r["decoded"] for r in out)
    assert bpe.encode_digests(df.limit(0), PATH).count() == 0
    assert [r["n_tokens"] for r in bpe.encode_digests(df, PATH).orderBy("n_tokens").collect()] == [0, 0, 2, 2]


@pytest.mark.parametrize("special", [True, False])
def test_special_tokens(special):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = not special
    assert bpe.Coder(OURS.v, special).encode(["a<|endoftext|>b"])[0] == t.encode("a<|endoftext|>b", add_special_tokens=False).ids
