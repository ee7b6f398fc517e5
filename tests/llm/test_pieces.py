import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quarrymill.llm.pieces import balanced_ends, latest_ends, pieces

TEXTS = st.builds(lambda parts: "".join(parts), st.lists(st.sampled_from(["word ", "end. ", "\n", "\n\n", "句。", "x" * 90, "数据　"]), max_size=80))


def brute(text, size, overlap):
    """The rule as it stands, one place after the other."""
    ends, start = [], 0
    while len(text) - start > size:
        best = (9, -(start + size))
        for end in range(start + size // 2 + 1, start + size + 1):
            before = text[:end]
            for rank, pattern in enumerate((r"\n\n$", r"\n$", r"([。！？।؟]|[.!?] )$", "[ 　]$")):
                if re.search(pattern + r"(?!\n)", before[-3:] if before[-3:] else "") and re.search(pattern[:-1] + r"\Z", before[-3:]):
                    best = min(best, (rank, -end))
        ends.append(-best[1])
        start = ends[-1] - overlap
    return [*ends, len(text)]


@given(TEXTS)
@settings(max_examples=150, deadline=None)
def test_latest_as_the_rule(text):
    assert latest_ends(text, 64, 8) == brute(text, 64, 8)


@given(TEXTS)
@settings(max_examples=150, deadline=None)
def test_balanced_covers_within_the_limit(text):
    ends = balanced_ends(text, 64, 8)
    starts = [0, *[e - 8 for e in ends[:-1]]]
    assert ends[-1] == len(text) and all(e - s <= 64 for s, e in zip(starts, ends)) and all(a < b for a, b in zip(ends, ends[1:]))
    assert len(ends) <= 2 * max(1, -(-(len(text) - 8) // 56)) + 1


def balanced_by_trying(text, size, overlap):
    """Balanced targets as they stand: every place around a target is looked at, the strongest kind first, then the nearest, then the earlier."""
    kinds = (["\n\n"], ["\n"], ["。", "！", "？", "।", "؟", ". ", "! ", "? "], [" ", "　"])
    count = max(1, -(-(len(text) - overlap) // (size - overlap)))
    while len(text) > size:
        length = (len(text) + (count - 1) * overlap) / count
        reach = max(0, min(size // 8, int(length - overlap) // 2 - 1))
        ends = []
        for k in range(1, count):
            target = round(k * length - (k - 1) * overlap)
            around = [(rank, abs(end - target), end) for end in range(target - reach, target + reach + 1) for rank, marks in enumerate(kinds) if any(text[:end].endswith(m) for m in marks)]
            ends.append(min(around)[2] if around else target)
        ends.append(len(text))
        starts = [0] + [e - overlap for e in ends[:-1]]
        if all(0 < e - s <= size for s, e in zip(starts, ends)) and sorted(set(ends)) == ends:
            return ends
        count += 1
    return [len(text)]


@given(TEXTS)
@settings(max_examples=150, deadline=None)
def test_balanced_as_by_trying_all_places(text):
    assert balanced_ends(text, 64, 8) == balanced_by_trying(text, 64, 8)


def test_balanced_pieces_are_of_about_one_length():
    ends = balanced_ends("word " * 400, 512, 64)
    assert len(ends) == 5 and max(ends[0], 2000 - ends[-2] + 64) - min(ends[0], 2000 - ends[-2] + 64) < 10


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "y" * 512, "x"), (4, "y" * 513, "x"), (4, "y" * 513, "x"), (5, "z" * 1_000_000, "x")]
    items = spark.createDataFrame(rows, "id bigint, body string, piece_no string").drop("piece_no")
    found = [tuple(r) for r in pieces(items, ["id"], "body").where("id < 5").collect()]
    assert found == [(4, 0, 0, 512), (4, 1, 448, 513)] * 2
    assert pieces(items, ["id"], "body").where("id = 5").count() == 1 + -(-(1_000_000 - 512) // 448)
    assert pieces(items.limit(0), ["id"], "body").count() == 0


