import random

from quarrymill.llm.reading import footers, prose, reading_levels, tokens

VOCABULARY = {1: "cat dog sun red big run see the a is", 2: "server config cache query index restart the a is batch", 3: "epistemic manifold asymptotic heteroscedastic ontological the a is whereby albeit"}


def paragraph(rnd, level, n=40):
    return " ".join(rnd.choices(VOCABULARY[level].split(), k=n)).capitalize() + "."


def corpus():
    rnd, docs, true = random.Random(4), [], {}
    for i in range(240):
        level, other = rnd.choice([1, 2, 3]), rnd.choice([1, 2, 3])
        parts = ["# Epistemic manifold", paragraph(rnd, level), paragraph(rnd, level), paragraph(rnd, other, 30), "```\nserver config cache\n```", "2025-01-01 10:00:00 INFO epistemic manifold", "Page kept by the team."]
        docs.append((i, "\r\n\r\n".join(parts)))
        true[i] = level
    docs += [(900, None), (901, ""), (902, " \n"), (903, "```\nx = 1\n```"), (904, "2025-01-01 10:00:00 WARN a b"), (905, "---"), (906, "# Only a title"), (907, "the cat is red " * 50_000), (0, docs[0][1])]
    return docs, true


def test_levels(spark):
    docs, true = corpus()
    labels = [(i, true[i]) for i in range(0, 60)] + [(3, None), (4, 9), (5, true[5]), (6, true[6] % 3 + 1), (None, 1), (5000, 2)]
    d = spark.createDataFrame([(*x, "z") for x in docs], "doc_id bigint, text string, level string")
    found = reading_levels(d, spark.createDataFrame(labels, "doc_id bigint, reading_level int")).collect()
    by = {r.doc_id: r.reading_level for r in found}
    assert set(by) == set(true) | {907} and by[907] == 1 and len(found) == 242
    held_out = [by[i] == true[i] for i in true if i >= 60]
    assert sum(held_out) >= 0.97 * len(held_out)


def test_without_labels(spark):
    d = spark.createDataFrame(corpus()[0][:50], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, reading_level int")
    assert reading_levels(d, none).count() == 50
    assert reading_levels(d.limit(0), none).count() == 0


def test_footers(spark):
    assert footers(spark.createDataFrame(corpus()[0], "doc_id bigint, text string")) == ["Page kept by the team."]


def test_other_sources_take_no_footer_away(spark):
    rnd = random.Random(6)
    small = [(i, f"{paragraph(rnd, 1)}\n\nKept by the harbour office.", " Harbour ") for i in range(5)]
    large = [(100 + i, f"{paragraph(rnd, 2)} {i}", "rest") for i in range(3000)]
    alone, beside = (footers(spark.createDataFrame(rows, "doc_id bigint, text string, source string")) for rows in (small, small + large))
    assert alone == beside == ["Kept by the harbour office."]


def test_prose_and_tokens():
    assert prose("# T\n\n- one\n> two\n\n```\ncode\n```\nQ: three\n***\nF", frozenset({"F"})) == ["one two", "three"]
    assert tokens("Über A1 向量库 好。カナ") == ["über", "<4>", "a", "<1>", "向量", "量库", "好", "カナ"]
