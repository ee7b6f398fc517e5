import hashlib
import random

from pyspark.sql import functions as F

from quarrymill.operators import memory


def made(spark):
    """One conversation holds most messages, some longer than a part; one has no line, one a single empty content."""
    rnd = random.Random(5)
    rows = [(1, i, "user" if i % 2 else "bot", "é中x"[i % 3] * rnd.choice((0, 1, 7, 90))) for i in range(400)] + [(2, 5, "bot", None), (3, 1, "bot", ""), (4, 2, "a", "z"), (4, 2, "a", "b"), (4, 1, None, "n")]
    rnd.shuffle(rows)
    whole = {}
    for key, _, line in sorted((k, i, f"{r}: {c}") for k, i, r, c in rows if r is not None and c is not None):
        whole[key] = f"{whole[key]}\n{line}" if key in whole else line
    return spark.createDataFrame(rows, "chat bigint, turn int, role string, content string"), whole


def test_a_hot_conversation_spreads_in_parts_of_bounded_size(spark):
    messages, whole = made(spark)
    found = memory.transcripts(messages.repartition(3), "chat", "turn", "role", "content", size=40, partitions=8)
    parts = {(r.chat, r.part_no): r.text for r in found.collect()}
    assert parts == {(k, n): t[n * 40 : n * 40 + 40] for k, t in whole.items() for n in range(-(-len(t) // 40))}
    assert max(n for _, n in parts) > 100


def test_digests_come_from_batches(spark):
    messages, whole = made(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = {r.chat: (r.digest, r.n_chars) for r in memory.transcript_digests(messages, "chat", "turn", "role", "content").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == {k: (hashlib.md5(t.encode()).hexdigest(), len(t)) for k, t in whole.items()} | {2: (None, None)}


def test_no_group_is_collected_for_a_digest(spark, capsys):
    memory.transcript_digests(made(spark)[0], "chat", "turn", "role", "content").explain()
    assert "collect_list" not in capsys.readouterr().out


def test_without_messages(spark):
    none = made(spark)[0].where(F.lit(False))
    assert memory.transcripts(none, "chat", "turn", "role", "content").count() == 0
    assert memory.transcript_digests(none, "chat", "turn", "role", "content").count() == 0
