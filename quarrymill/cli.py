"""python -m quarrymill.cli: the index and the memory from the command line."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable, Iterable
from dataclasses import replace
from datetime import datetime

from pyspark.sql import SparkSession

from quarrymill.config import from_env
from quarrymill.conversation import ConversationMemory
from quarrymill.errors import QuarrymillError
from quarrymill.sources.files import read_folder
from quarrymill.system import RetrievalSystem


HISTORY = 6  # messages before a question that go with it


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarrymill")
    p.add_argument("--folder", help="of the index, or of the memory")
    sub = p.add_subparsers(dest="command", required=True)
    ingest = sub.add_parser("ingest")
    ingest.add_argument("path")
    ingest.add_argument("--pattern", default="*")
    ingest.add_argument("--force", action="store_true")
    query = sub.add_parser("query")
    query.add_argument("question")
    query.add_argument("--top-k", type=int)
    chat = sub.add_parser("chat", help="questions from standard input; /exit, /clear, /sources, /stats and /save are commands")
    chat.add_argument("--memory", help="folder of the memory that /save adds to")
    sub.add_parser("info")
    sub.add_parser("list-sources")
    sub.add_parser("remove").add_argument("source")
    memory = sub.add_parser("memory").add_subparsers(dest="memory", required=True)
    end = memory.add_parser("end")
    end.add_argument("content", help="the text, or file:PATH")
    end.add_argument("--slug")
    end.add_argument("--date")
    recall = memory.add_parser("recall")
    recall.add_argument("query")
    recall.add_argument("--top-k", type=int, default=5)
    recall.add_argument("--deep", action="store_true")
    memory.add_parser("list")
    memory.add_parser("versions")
    memory.add_parser("rollback").add_argument("version", type=int)
    return p


def run(args: argparse.Namespace, spark: SparkSession) -> int:
    settings = from_env()
    if args.folder:
        settings = replace(settings, folder=args.folder)
    if args.command == "memory":
        return run_memory(args, ConversationMemory(spark, settings.folder))
    if getattr(args, "top_k", None):
        settings = replace(settings, retrieval=replace(settings.retrieval, top_k=args.top_k))
    system = RetrievalSystem(spark, settings)
    if args.command == "ingest":
        print(system.ingest(read_folder(spark, args.path, args.pattern).select("path", "text"), args.force))
    elif args.command == "query":
        asked = spark.createDataFrame([(0, args.question)], "qid bigint, query string")
        for hit in system.search(asked).orderBy("rank_no").collect():
            print(f"{hit.rank_no}. {hit.score:.4f} {hit.source}\n{hit.text}\n")
    elif args.command == "chat":
        run_chat(system, sys.stdin, ConversationMemory(spark, args.memory) if args.memory else None)
    elif args.command == "info":
        print(system.info().first().asDict())
    elif args.command == "list-sources":
        for row in system.sources().orderBy("source").toLocalIterator():
            print(row.source)
    else:
        n = system.remove(args.source)
        print(f"{n} chunks removed")
        return int(not n)
    return 0


def run_chat(system: RetrievalSystem, lines: Iterable[str], memory: ConversationMemory | None, answer: Callable[[str, str], str] | None = None) -> list[tuple[str, str]]:
    """Answers the lines one by one, with the last HISTORY messages before each; without `answer` the context found is shown."""
    said: list[tuple[str, str]] = []
    for line in map(str.strip, lines):
        if line == "/exit":
            break
        if line == "/clear":
            said.clear()
        elif line == "/sources":
            print("\n".join(r.source for r in system.sources().orderBy("source").toLocalIterator()))
        elif line == "/stats":
            print(system.info().first().asDict())
        elif line == "/save":
            now = datetime.now()
            text = "\n".join(f"{who}: {what}" for who, what in said)
            print(memory.end_session(text, now.strftime("%Y-%m-%d"), now.strftime("%H:%M:%S")) if memory and said else "nothing is saved")
        elif line:
            before = "\n".join(f"{who}: {what}" for who, what in said[-HISTORY:])
            asked = system.spark.createDataFrame([(0, line, before)], "qid bigint, query string, said string")
            reply = system.answers(asked, answer or (lambda context, question: context), "said").first()["answer"]
            print(reply)
            said += [("user", line), ("assistant", reply)]
    return said


def run_memory(args: argparse.Namespace, memory: ConversationMemory) -> int:
    now = datetime.now()
    if args.memory == "end":
        text = args.content
        if text.startswith("file:"):
            with open(text[5:], encoding="utf-8") as f:
                text = f.read()
        print(memory.end_session(text, args.date or now.strftime("%Y-%m-%d"), now.strftime("%H:%M:%S"), args.slug))
    elif args.memory == "recall":
        found = memory.recall_deep(args.query, args.top_k) if args.deep else memory.recall(args.query, args.top_k)
        for row in found.collect():
            print(row.asDict())
    elif args.memory == "rollback":
        return int(not memory.rollback(args.version, now.strftime("%Y-%m-%d")))
    else:
        for row in (memory.sessions().drop("text") if args.memory == "list" else memory.versions()).toLocalIterator():
            print(row.asDict())
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return run(args, SparkSession.builder.appName("quarrymill").getOrCreate())
    except QuarrymillError as e:
        print(e, file=sys.stderr)
        return 1
    except KeyboardInterrupt:
        return 130


if __name__ == "__main__":
    sys.exit(main())
