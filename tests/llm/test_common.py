import pyarrow as pa
import pytest

from quillstream.llm.common import ALNUM_WORDS, Tokens, slices, within, window_hash


@pytest.mark.parametrize("texts", [["a b", None, "", "  x\ty ", "a b"], ["é ü", "a\x0bb\x0cc\x1cd"], [], [None], ["ends", "starts"]])
def test_words_are_those_between_ascii_white_space(texts):
    t = Tokens(pa.array(texts, pa.string()))
    got = [[bytes(t.buf[t.start[k] : t.end[k]]).decode() for k in range(t.first[i], t.first[i + 1])] for i in range(len(texts))]
    assert got == [[w.decode() for w in (x or "").encode().split()] for x in texts]


def test_equal_words_have_equal_hashes_wherever_they_stand():
    t = Tokens(pa.array(["The cat the", "CAT of THE the"]), ALNUM_WORDS, fold=True)
    h = t.hashes().tolist()
    assert h[0] == h[2] == h[5] == h[6] and h[1] == h[3] and len(set(h)) == 3
    exact = Tokens(pa.array(["The cat the", "CAT of THE the"])).hashes().tolist()
    assert len(set(exact)) == 6


def test_window_hashes():
    h = Tokens(pa.array(["a b c d a b c e a b"])).hashes()
    for n in range(1, 11):
        w = window_hash(h, n).tolist()
        words = "abcdabceab"
        assert len(w) == 11 - n
        for i in range(len(w)):
            assert [x == w[i] for x in w] == [words[j : j + n] == words[i : i + n] for j in range(len(w))]
    assert len(window_hash(h, 11)) == 0


def test_windows_stay_within_documents():
    t = Tokens(pa.array(["a b c", "", "d e", "f g h i"]))
    assert within(t, 3).tolist() == [0, 5, 6]


def test_slices_cut_by_size_and_keep_every_row():
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(["x" * n for n in (5, 50, 1, 1, 1, 30, 2)])], names=["i", "text"])
    parts = list(slices([batch], size=10))
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(7)) and max(p.num_rows for p in parts) == 3
