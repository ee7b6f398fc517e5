import random

import pytest

from quarrymill.llm.leakage import _codes, _rolled, leaks, letters

LETTERS = "abcdefghijklmnopqrstuvwxyzäéñ"


def covering(docs, items):
    """How many characters of the item each pair covers."""
    out = {}
    for d, text in docs:
        plain = letters(text)
        for i, passage, lang in items:
            own, span = letters(passage), 12 if lang in ("zh", "ja") else 32
            covered = set()
            for k in range(len(own) - span + 1):
                if own[k : k + span] in plain:
                    covered.update(range(k, k + span))
            if covered:
                out[d, i] = len(covered)
    return out


def brute(docs, items):
    size = {i: len(letters(passage)) for i, passage, _ in items}
    return {k for k, n in covering(docs, items).items() if n * 2 >= size[k[1]]}


def corpus():
    rnd = random.Random(11)
    text = lambda n: "".join(rnd.choices(LETTERS + "   .", k=n))
    han = lambda n: "".join(chr(0x4E00 + rnd.randrange(3000)) for _ in range(n))
    items = [(i, text(200), "en") for i in range(6)] + [(10 + i, han(80), "zh") for i in range(4)] + [(20, "tiny", "en"), (21, None, "en"), (22, "", None), (5, text(200), "en")]
    docs = []
    for d in range(60):
        i, passage, lang = rnd.choice(items[:10])
        n = rnd.randrange(len(passage) // 4, len(passage))
        cut = rnd.randrange(len(passage) - n + 1)
        middle = passage[cut : cut + n]
        if d % 3 == 0:
            middle = middle[len(middle) // 2 :] + text(9) + middle[: len(middle) // 2]
        docs.append((d, text(rnd.randrange(400)) + middle.upper().replace(" ", "\n ") + text(300)))
    docs += [(100, None), (101, ""), (102, "\0 ..."), (103, "ｆｕｌｌ " * 10), (104, text(150_000) + items[0][1] + text(150_000)), (0, docs[0][1])]
    return docs, items[:-1]


@pytest.mark.parametrize("limit", [4_000_000, 300])
def test_as_by_brute_force(spark, limit):
    docs, items = corpus()
    d = spark.createDataFrame([(*x, "x") for x in [*docs, (None, docs[0][1])]], "doc_id bigint, text string, item string")
    i = spark.createDataFrame([(*x, 1) for x in [*items, (None, items[0][1], "en")]], "item_id bigint, text string, lang string, doc_id int")
    every = leaks(d, i, gram_limit=limit).collect()
    found = [r for r in every if r.kind == "copied"]
    assert {(r.doc_id, r.item_id) for r in found} == brute(docs, items) and len(found) == len({(r.doc_id, r.item_id) for r in found})
    assert all(r.covered <= r.item_chars and r.alignment >= 12 for r in found)


def aligned(item, text):
    """The local alignment score, one cell after the other."""
    above, best = [0] * (len(text) + 1), 0
    for c in item:
        now = [0]
        for k, d in enumerate(text):
            now.append(max(0, above[k] + (1 if c == d else -1), above[k + 1] - 1, now[k] - 1))
        above, best = now, max(best, *now)
    return best


@pytest.mark.parametrize("limit", [4_000_000, 300])
def test_edited_copies_are_found_by_their_alignment(spark, limit):
    rnd = random.Random(8)
    words = lambda n: ["".join(rnd.choices(LETTERS, k=rnd.randrange(3, 9))) for _ in range(n)]
    items, docs = [(i, " ".join(words(40)), "en") for i in range(5)], []
    for d in range(60):
        edited = items[d % 5][1].split()
        for _ in range(d // 4):  # words changed, left out or put in
            at = rnd.randrange(len(edited))
            edited[at : at + rnd.randrange(2)] = words(rnd.randrange(2))
        docs.append((d, " ".join(words(30) + edited + words(30))))
    found = {(r.doc_id, r.item_id): r for r in leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string, lang string"), gram_limit=limit).collect()}
    plain, whole, covered = {i: letters(t) for i, t, _ in items}, brute(docs, items), covering(docs, items)
    score = {(d, d % 5): aligned(plain[d % 5], letters(t)) for d, t in docs}
    assert {k for k, r in found.items() if r.kind == "copied"} == whole
    edited = {k for k, s in score.items() if k not in whole and s >= 0.5 * len(plain[k[1]]) and covered.get(k, 0) >= 0.25 * len(plain[k[1]])}
    assert {k for k, r in found.items() if r.kind == "edited"} == edited and len(edited) > 5
    assert all(0.6 * score[k] <= found[k].alignment <= score[k] for k in edited)  # MARGIN cuts some off


def test_hashes_of_runs():
    codes = _codes("abcabcabcabcxyz" * 3)
    hashes = _rolled(codes, 12)
    texts = ["".join(map(chr, codes[i : i + 12])) for i in range(len(codes) - 11)]
    assert all((hashes[i] == hashes[j]) == (texts[i] == texts[j]) for i in range(len(texts)) for j in range(len(texts)))
    assert len(_rolled(codes[:11], 12)) == 0


def test_an_item_in_most_documents_is_found_in_all(spark):
    passage = "the quick brown fox jumps over the lazy dog again and again until night falls on the hills"
    d = spark.createDataFrame([(k, f"{k} {passage} {k}") for k in range(50)], "doc_id bigint, text string")
    i = spark.createDataFrame([(1, passage, "en")], "item_id bigint, text string, lang string")
    assert leaks(d, i).count() == 50


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string")
    i = spark.createDataFrame([], "item_id bigint, text string, lang string")
    assert leaks(d, i).count() == 0
    assert leaks(spark.createDataFrame([(1, "text")], "doc_id bigint, text string"), i).count() == 0
