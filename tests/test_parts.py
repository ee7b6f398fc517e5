import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill.config import Chunking, Retrieval, Settings, env_file, from_env
from quarrymill.conversation import ConversationMemory
from quarrymill.errors import ConfigError, IndexStoreError, IngestionError, RetrievalError
from quarrymill.functions import text as T
from quarrymill.functions.vectors import unit
from quarrymill.hooks import HashingEmbedder, ModelEmbedder, ModelScorer, by_index, embedder_for, jaccard_scorer, retried
from quarrymill.operators import bm25, index, memory, retrieve
from quarrymill.session import bounded_broadcast, dropped, written
from quarrymill.sources.files import each_file, html_text, read_evaluation, read_file, read_folder, topic_number, write_markdown
from quarrymill.streaming.ingest import ingest_stream
from quarrymill.system import RetrievalSystem


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_terms(spark):
    rows = [("Hello, World foo",), ("向量检索",), ("用BM25检索",), ("好 a",), ("",), (None,), ("İstanbul ok",), ("好 İstanbul ok",)]
    found = [["hello", "world", "foo"], ["向量", "量检", "检索"], ["bm25", "检索"], ["a"], [], None, ["i̇stanbul", "ok"], ["i̇stanbul", "ok"]]
    assert values(spark, rows, "t string", T.terms(F.col("t"))) == found


def test_markdown(spark):
    rows = [("![a](b) x [t](u)\n\n\n\ny ",), ("[a](b\nc)",), ("![x](y\nz)",), ("![a]b](c) x",), ("[a[b]](c) [d\ne](f)",), ("a\n\nb\n\n\nc",)]
    assert values(spark, rows, "t string", T.plain_markdown(F.col("t"))) == ["x t\n\ny", "[a](b\nc)", "![x](y\nz)", "x", "[a[b]](c) d\ne", "a\n\nb\n\nc"]


def test_names(spark):
    rows = [("2026-01-02-a-b-123456",), ("2026-01-02-old",), ("2026x",), ("note",)]
    assert values(spark, rows, "t string", T.session_date(F.col("t"))) == ["2026-01-02", "2026-01-02", "", ""]
    assert values(spark, rows, "t string", T.session_slug(F.col("t"))) == ["a-b", "old", "2026x", "note"]
    assert values(spark, [("  Héllo, World! \nx",), ("a" * 100,)], "t string", T.slug(F.col("t"))) == ["héllo-world", "a" * 30]
    assert values(spark, [("",), ("ab",), ("中文",)], "t string", T.token_estimate(F.col("t"))) == [0, 1, 2]


def test_html(spark):
    page = "<html><head><title>t</title></head><body><script>x()</script><p>A &amp; B</p><!-- c --><div>C<br>D</div></body></html>"
    assert values(spark, [(page,)], "h string", html_text(F.col("h"))) == ["A & B\nC\nD"]


def test_unit(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>").select(unit(F.col("v"))).collect()
    assert rows[0][0] == pytest.approx([0.6, 0.8]) and rows[1][0] == [0.0, 0.0]


def test_bm25_candidates_without_signal(spark):
    rows = spark.createDataFrame([("q", 1, "cat dog"), ("q", 2, "dog dog"), ("z", 3, "none")], "asked string, result_id int, text string")
    found = {r.result_id: r.bm25 for r in bm25.candidate_scores(rows.withColumn("asked", F.when(F.col("asked") == "q", "dog").otherwise("zebra")), "asked", "asked", "result_id", "text").collect()}
    assert found[2] > found[1] > 0 and found[3] == 0


def test_bm25_of_a_collection_with_null_and_empty_texts(spark):
    docs = [(1, "cat dog dog"), (2, None), (3, ""), (4, "cat"), (5, "bird bird")]
    found = {(r.qid, r.id): r.score for r in bm25.scores(spark.createDataFrame([(0, "dog Dog cat"), (1, None), (2, "fish")], "qid int, q string"), "qid", "q", spark.createDataFrame(docs, "id int, t string"), "id", "t").collect()}
    lengths = [3, 0, 1, 2]
    average, idf = sum(lengths) / 4, lambda df: np.log(1 + (5 - df + 0.5) / (df + 0.5))
    part = lambda df, tf, dl: idf(df) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / average))
    assert found == {(0, 1): pytest.approx(part(1, 2, 3) + part(2, 1, 3)), (0, 4): pytest.approx(part(2, 1, 1))}


def test_cosine_by_numpy_and_by_expressions(spark):
    rng = np.random.default_rng(1)
    data = [(i, rng.normal(size=4).tolist()) for i in range(30)] + [(30, [0.0] * 4), (31, None)]
    v = spark.createDataFrame(data, "id bigint, vec array<double>")
    asked = v.where("id < 5")
    fast = {(r.id, r.rank_no): (r.other, r.score) for r in retrieve.cosine_top_k(asked, v, 3, at_once=2).collect()}
    pairs = asked.alias("a").join(v.where("vec is not null").alias("b"), F.col("a.id") != F.col("b.id")).select(F.col("a.id").alias("id"), F.col("b.id").alias("other"), F.round(retrieve.cosine(F.col("a.vec"), F.col("b.vec")), 6).alias("score"))
    slow = {}
    for r in sorted(pairs.collect(), key=lambda r: (r.id, -r.score, r.other)):
        n = sum(k[0] == r.id for k in slow) + 1
        if n <= 3:
            slow[r.id, n] = (r.other, r.score)
    assert fast == slow


def test_merge_keeps_the_first_spelling(spark):
    new = spark.createDataFrame([("RAG 系统", 0), ("beta", 1)], "p string, pos int")
    old = spark.createDataFrame([("rag系统", 0), ("gamma", 1)], "p string, pos int")
    assert [r.prompt for r in memory.merged(new, old, "p").orderBy("side", "pos").collect()] == ["RAG 系统", "beta", "gamma"]


def test_deep_recall(spark):
    docs = spark.createDataFrame([("a", "aaaa x"), ("b", "y" * 200 + " aa bb"), ("c", None), ("d", "none")], "key string, text string")
    asked = spark.createDataFrame([(0, "bb aa z"), (1, "q")], "qid bigint, query string")
    found = memory.deep_recall(asked, docs, "qid", "query", "key", "text").orderBy(F.desc("score"), F.desc("key")).collect()
    assert [(r.qid, r.key, r.score) for r in found] == [(0, "b", 2), (0, "a", 2)]
    assert found[0].snippet == ("y" * 200 + " aa bb")[54:]


def test_budget_keeps_the_first(spark):
    rows = spark.createDataFrame([("q", 1, "s", "x" * 300), ("q", 2, "s", "y")], "g string, rank int, source string, text string")
    assert [r["rank"] for r in retrieve.within_budget(rows, "g", "rank", 10).collect()] == [1]


def test_settings(tmp_path):
    assert from_env({"QUARRYMILL_TOP_K": "7", "QUARRYMILL_HYBRID": "是"}).retrieval == Retrieval(top_k=7, hybrid=True)
    for env in ({"QUARRYMILL_TOP_K": "x"}, {"QUARRYMILL_ALPHA": "2"}):
        with pytest.raises(ConfigError):
            from_env(env)
    with pytest.raises(ConfigError):
        Chunking(10, 10)
    (tmp_path / ".env").write_text("# a comment\nexport QUARRYMILL_TOP_K = '9'\nQUARRYMILL_OVERLAP=7\n")
    assert from_env(env_file(str(tmp_path / ".env"))) == Settings(Chunking(overlap=7), Retrieval(top_k=9))
    assert env_file(str(tmp_path / "none")) == {}


def test_broadcast_only_within_bounds(spark):
    df = spark.createDataFrame([("x" * 100, [1, 2], ["a"])] * 50, "s string, n array<int>, t array<string>")
    plan = lambda x: x._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(bounded_broadcast(df)) and "broadcast" not in plan(bounded_broadcast(df, 49)) and "broadcast" not in plan(bounded_broadcast(df, 50, 5000))
    out = written(df, "some")
    dropped(out)
    with pytest.raises(Exception):
        out.count()


def test_retry():
    calls, pauses = [], []

    def fail():
        calls.append(1)
        raise OSError("connection reset")

    with pytest.raises(OSError):
        retried(fail, 4, 10, 30, pauses.append)()
    assert len(calls) == 4 and pauses == [10, 20, 30]


def test_model_embedder(spark):
    rows = spark.createDataFrame([(i, "x" * i) for i in range(5)], "id bigint, t string")
    embedder = ModelEmbedder(lambda: lambda texts: np.array([[len(t), 1.0] for t in texts]), 2, batch=2, prefix=">")
    assert {r.id: r.vec for r in embedder(rows, "id", "t", query=True).collect()} == {i: [i + 1.0, 1.0] for i in range(5)}


def test_snapshots(spark, tmp_path):
    store = index.Snapshots(spark, str(tmp_path / "i"))
    with pytest.raises(IndexStoreError):
        store.load()
    store.commit(spark.createDataFrame([("a", 1)], "source string, n int"))
    store.commit(store.load().where("n > 1"))
    assert store.load().count() == 0
    with pytest.raises(IngestionError):
        index.replaced(spark.createDataFrame([("a",)], "source string"), spark.createDataFrame([("a", 1)], "source string, n int"))


def test_system(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a.md").write_text("cats purr\n\n![x](y)", encoding="utf-8")
    (folder / "b.txt").write_bytes("向量检索".encode("gbk"))
    (folder / "c.html").write_text("<p>dogs bark</p>")
    (folder / "d.exe").write_text("no")
    (folder / "e.txt").write_text("  ")
    files = read_folder(spark, str(folder))
    assert {r.path.rsplit("/", 1)[1]: r.text for r in files.collect()} == {"a.md": "cats purr", "b.txt": "向量检索", "c.html": "dogs bark"}
    with pytest.raises(IngestionError):
        read_file(spark, str(folder / "none.txt"))
    from quarrymill.config import Settings

    system = RetrievalSystem(spark, Settings(retrieval=Retrieval(top_k=1, hybrid=True, rerank=True), folder=str(tmp_path / "index")), scorer=jaccard_scorer)
    asked = spark.createDataFrame([(0, "cats"), (1, "dogs bark")], "qid bigint, query string")
    with pytest.raises(RetrievalError):
        system.search(asked)
    assert system.ingest(files) == {"files": 3, "chunks": 3, "skipped": 0, "updated": 0}
    assert system.ingest(files) == {"files": 0, "chunks": 0, "skipped": 3, "updated": 0}
    changed = files.withColumn("text", F.concat("text", F.lit("!")))
    assert system.ingest(changed)["updated"] == 0
    assert system.ingest(changed, force=True)["updated"] == 3
    found = {r.qid: r.source.rsplit("/", 1)[1] for r in system.search(asked).collect()}
    assert found == {0: "a.md", 1: "c.html"}
    assert system.prompts(asked).where("qid = 0").first().context.endswith("cats purr!")
    told = asked.withColumn("said", F.lit("before"))
    answers = {r.qid: r.answer for r in system.answers(told, lambda context, question: f"{question}? {len(context) > 20} {context[:6]}", "said").collect()}
    assert answers[0].startswith("cats? True before") and answers[0].split("参考来源: ")[1].endswith("a.md")
    blank = files.where("path like '%b.txt'").withColumn("text", F.lit(" \n")).unionByName(spark.createDataFrame([("/new", " ", {})], files.schema))
    assert system.ingest(blank)["skipped"] == 1 and system.sources().count() == 3
    assert system.ingest(blank, force=True) == {"files": 1, "chunks": 0, "skipped": 0, "updated": 1} and system.sources().count() == 2
    source = system.sources().first().source
    assert (system.remove(source), system.remove(source)) == (1, 0)
    other = RetrievalSystem(spark, system.settings, HashingEmbedder(8))
    with pytest.raises(IndexStoreError):
        other.chunks()


def test_prefix_for_queries_and_retry(spark):
    rows = spark.createDataFrame([(0, "ab")], "id bigint, t string")

    def load():
        calls = []

        def model(texts):
            calls.append(1)
            if len(calls) < 3:
                raise OSError("connection reset")
            return np.array([[len(t)] for t in texts])

        return model

    embedder = ModelEmbedder(load, 1, prefix=">>", pause=0.0)
    assert (embedder(rows, "id", "t").first().vec, embedder(rows, "id", "t", query=True).first().vec) == ([2.0], [4.0])
    assert embedder_for("local", 1, load).prefix and not embedder_for("api", 1, load).prefix and embedder_for("hashing", 8).size == 8
    with pytest.raises(ConfigError):
        embedder_for("local", 1)
    assert by_index([{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}], 1).tolist() == [[1.0], [2.0]]


def test_a_re_scorer_that_fails_keeps_the_order(spark):
    rows = spark.createDataFrame([("q", 1, "a"), ("q", 2, "bb"), ("z", 1, "bad"), ("z", 2, "cccc")], "query string, rank int, text string")

    def load():
        def model(queries, texts):
            if "bad" in texts:
                raise ValueError("too bad")
            return [len(t) for t in texts]

        return model

    def final(scorer):
        return {(r["query"], r["final_rank"]): r["text"] for r in retrieve.reranked(rows, "query", "rank", 2, scorer).collect()}

    assert final(ModelScorer(load, batch=1)) == {("q", 1): "bb", ("q", 2): "a", ("z", 1): "bad", ("z", 2): "cccc"}

    def fails(pairs):
        raise RetrievalError("no model")

    assert final(fails) == final(None) == {("q", 1): "a", ("q", 2): "bb", ("z", 1): "bad", ("z", 2): "cccc"}


def test_chat(spark, tmp_path, capsys):
    from quarrymill.cli import run_chat

    system = RetrievalSystem(spark, Settings(retrieval=Retrieval(top_k=1), folder=str(tmp_path / "i")))
    system.ingest(spark.createDataFrame([("a.md", "cats purr"), ("b.md", "dogs bark")], "path string, text string"))
    store = ConversationMemory(spark, str(tmp_path / "m"))
    said = run_chat(system, ["cats purr", "", "dogs bark", "/sources", "/stats", "/save", "/exit", "never asked"], store, lambda context, question: f"{question}|{len(context.splitlines())}")
    assert [who for who, _ in said] == ["user", "assistant"] * 2 and said[1][1].startswith("cats purr|") and said[3][1].split("参考来源: ")[1] == "b.md"
    assert int(said[3][1].split("|")[1].split()[0]) > int(said[1][1].split("|")[1].split()[0])  # what was said before comes along
    assert "a.md\nb.md" in capsys.readouterr().out and store.sessions().count() == 1
    assert run_chat(system, ["cats", "/clear", "/save"], None) == []


def test_files_that_fail_are_passed_over(spark, tmp_path):
    for name in ("a.pdf", "b.pdf", "c.pdf"):
        (tmp_path / name).write_text(name)

    def convert(path, content):
        if path.endswith("b.pdf"):
            raise ValueError("damaged")
        if path.endswith("c.pdf"):
            time.sleep(5)
        return content.decode() + "!"

    found = read_folder(spark, str(tmp_path), rich=each_file(convert, 1.0)).collect()
    assert [r.text for r in found] == ["a.pdf!"]


def test_evaluation_files_and_topics(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"mrr": 1,\n "per_query": [{"qid": 1, "rank": 0}, {"qid": 2, "rank": -1}]}')
    assert [tuple(r) for r in read_evaluation(spark, str(tmp_path / "r.json")).orderBy("qid").collect()] == [("r.json", 1, 0), ("r.json", 2, -1)]
    assert values(spark, [("/x/doc_017-3.md",), ("/9/none.txt",)], "p string", topic_number(F.col("p"))) == [17, None]


def test_stream(spark, tmp_path):
    from quarrymill.config import Settings

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.md").write_bytes("向量检索".encode("gbk"))
    system = RetrievalSystem(spark, Settings(folder=str(tmp_path / "index")))
    for name in ("b.md", "c.md"):
        ingest_stream(spark, str(folder), system, str(tmp_path / "state")).awaitTermination()
        (folder / name).write_text(name)
    assert system.sources().count() == 2 and "向量检索" in {r.text for r in system.chunks().collect()}


def test_memory(spark, tmp_path):
    store = ConversationMemory(spark, str(tmp_path / "m"))
    store.end_session("讨论向量检索\n向量检索很快", "2026-01-01", "10:00:00", "first")
    store.end_session("Markdown splitting", "2026-01-02", "11:00:00")
    assert [r.stem for r in store.sessions().collect()] == ["2026-01-02-markdown-splitting-110000", "2026-01-01-first-100000"]
    assert [r.prompt for r in store.latest_prompts().orderBy("pos").collect()][:2] == ["Markdown", "splitting"]
    assert store.rollback(1, "2026-01-03") and not store.rollback(9, "2026-01-03")
    assert "Markdown" not in [r.prompt for r in store.latest_prompts().collect()]
    assert [r.version for r in store.versions().collect()] == [3, 2, 1]
    assert store.recall_deep("向量检索").first().score == 2
    embedded = []
    store.embedder = Counting(store.embedder, embedded)
    assert store.recall("Markdown").first().prompt == "Markdown"
    assert store.recall("Markdown").first().prompt == "Markdown" and sum(embedded) == 3  # two questions, and the prompts once
    assert store.end_session(" \n", "2026-01-04", "10:00:00") == "" and store.sessions().count() == 2
    assert store.session("2026-01-01-first-100000").endswith("向量检索很快") and store.session("none") is None
    assert [r.prompt for r in store.raw_prompts("2026-01-02-markdown-splitting-110000").collect()] == ["Markdown", "splitting"]
    store.write_recent(str(tmp_path / "recent"), 1)
    assert [r.stem for r in spark.read.json(str(tmp_path / "recent")).collect()] == ["2026-01-02-markdown-splitting-110000"]


class Counting:
    """An embedder that notes its calls."""

    def __init__(self, embedder, calls):
        self.embedder, self.calls, self.size = embedder, calls, embedder.size

    def __call__(self, rows, key, text, query=False):
        self.calls.append(1)
        return self.embedder(rows, key, text, query)


def test_report(spark):
    assert write_markdown(spark.createDataFrame([(1, None)], "a int, b string"), "T") == "# T\n\n| a | b |\n| --- | --- |\n| 1 |  |\n"
