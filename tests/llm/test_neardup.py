import random
import unicodedata

import numpy as np

from quarrymill.llm.neardup import alike, all_pairs, canonical, groups

WORDS = [f"word{i:03d}" for i in range(400)]


def key(text):
    return "".join(c for c in text.lower() if not c.isspace() and unicodedata.category(c)[0] != "P")


def brute(rows, similarity=0.6, run=10, least=200):
    sets = {}
    for kind, i, text in rows:
        plain = key(text or "")
        if len(plain) >= least:
            sets[kind, i] = {plain[k : k + run] for k in range(len(plain) - run + 1)}
    ids = sorted(sets)
    return {(a[0], a[1], b[1]) for n, a in enumerate(ids) for b in ids[n + 1 :] if a[0] == b[0] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])}


def corpus():
    rnd, rows = random.Random(3), []
    for base in range(12):
        words = rnd.choices(WORDS, k=80)
        for copy in range(4):
            edited = list(words)
            for _ in range(copy * 3):
                edited[rnd.randrange(len(edited))] = rnd.choice(WORDS)
            rows.append(("file", base * 10 + copy, " ".join(edited)))
        rows.append(("chunk", base * 10, " ".join(words).upper() + "!"))
        rows.append(("chunk", base * 10 + 1, " ".join(words)))
    rows += [("file", 900, None), ("file", 901, ""), ("file", 902, "short"), ("file", 903, "，。" * 400), ("file", 904, "x" * 3000), ("file", 905, "X" * 2000)]
    rows.append(("file", 906, " ".join(rnd.choices(WORDS, k=20_000))))
    rows.append(rows[0])  # a row that comes twice
    return rows


def test_all_pairs_as_by_brute_force(spark):
    rows = corpus()
    texts = spark.createDataFrame([(*r, "x") for r in [*rows, (None, 1, rows[0][2]), ("file", None, rows[0][2])]], "kind string, id bigint, text string, rep string")
    members, links = alike(texts.select("kind", "id", "text", "rep"))
    found = [tuple(r) for r in all_pairs(members, links).select("kind", "id_a", "id_b").collect()]
    assert len(found) == len(set(found))
    assert set(found) == brute(rows)
    grouped = {(r.kind, r.id): (r.group_id, r.n_links) for r in groups(members, links).collect()}
    for kind, a, b in found:
        assert grouped[kind, a][0] == grouped[kind, b][0]
    assert grouped["file", 906] == (906, 0)
    assert len({g for (k, _), (g, _) in grouped.items() if k == "chunk"}) == 12


def test_a_chain_is_one_group(spark):
    links = spark.createDataFrame([("file", i, i + 1) for i in range(40)], "kind string, rep_a bigint, rep_b bigint")
    members = spark.createDataFrame([("file", i, i) for i in range(42)], "kind string, id bigint, rep bigint")
    found = {r.id: (r.group_id, r.n_links) for r in groups(members, links).collect()}
    assert {g for i, (g, _) in found.items() if i <= 40} == {0} and found[41] == (41, 0) and found[5][1] == 2


def test_empty_table(spark):
    members, links = alike(spark.createDataFrame([], "kind string, id bigint, text string"))
    assert members.count() == 0 and all_pairs(members, links).count() == 0 and groups(members, links).count() == 0


def test_canonical_parts():
    codes, bounds = canonical(["Ab, c", "", "。中 文"])
    parts = [codes[a:b].astype(np.uint32).tobytes().decode("utf-32-le") for a, b in zip(bounds, bounds[1:])]
    assert parts == ["abc", "", "中文"]
