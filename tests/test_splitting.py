import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrymill.operators.splitting import chunks_of, packed, split_documents, windows

TEXTS = st.text(alphabet="ab 。，\n.!;", max_size=200)


def test_short_text_is_one_chunk():
    assert list(chunks_of("one short text", 50, 10)) == ["one short text"]


def test_separators_by_strength():
    assert list(chunks_of("a。b\n\nc。d", 3, 0)) == ["a。b", "c。d"]


def test_overlap_takes_whole_pieces():
    assert list(chunks_of("aa bb cc dd ee ff", 8, 3)) == ["aa bb cc", "cc dd ee", "ee ff"]


def test_overlap_may_pass_the_size():
    assert list(packed(["aaa", "bbbbb"], " ", 6, 3)) == ["aaa", "aaa bbbbb"]


@pytest.mark.parametrize("n", [1, 9, 10, 11, 17, 18, 50])
def test_windows_end_once(n):
    found = list(windows("x" * n, 10, 3))
    assert len(found) == (1 if n <= 10 else 1 + -(-(n - 10) // 7))
    assert found[-1] == ("x" * n)[(len(found) - 1) * 7 :]


@given(TEXTS, st.integers(2, 20))
@settings(max_examples=200, deadline=None)
def test_without_overlap_chunks_are_parts_within_the_size(text, size):
    for chunk in chunks_of(text, size, 0):
        assert len(chunk) <= size and chunk in text


def test_without_an_empty_separator_a_piece_is_forced_apart():
    assert list(chunks_of("abcdefgh i", 4, 1, (" ",))) == ["abcd", "defg", "gh", "i"]
    assert list(chunks_of("abcdefgh", 4, 1, (" ",))) == ["abcd", "defg", "gh"]  # no separator at all: windows


def test_length_function():
    words = lambda t: len(t.encode())
    assert list(chunks_of("ééé é", 6, 0, length=words)) == ["ééé", "é"]


def test_documents(spark):
    docs = spark.createDataFrame([(1, "a b\n\nc", "x"), (2, "", "x"), (3, None, "x"), (4, "   ", "x")], "id bigint, body string, chunk_index string")
    found = split_documents(docs.select("id", "body"), "id", "body", 3, 0).collect()
    assert [tuple(r) for r in found] == [(1, 0, "a b"), (1, 1, "c")]
    carried = split_documents(docs.withColumnRenamed("chunk_index", "name"), "id", "body", 3, 0, carry=("name",))
    assert [tuple(r) for r in carried.collect()] == [(1, "x", 0, "a b"), (1, "x", 1, "c")]
