"""Command line: add, index, search, collections, remove, purge, watch, db-check, compact, vacuum."""

from __future__ import annotations

import argparse
import json
from datetime import UTC, datetime, timedelta

from pyspark.sql import SparkSession

from lakesift.operators import ingest, search
from lakesift.providers import HashingEmbedder, ServedModel
from lakesift.schema import TABLES, Settings
from lakesift.sources.files import read_files
from lakesift.store import Store
from lakesift.streaming.watch import watch, watch_folder


#: Cells of a result's bar.
BAR = 5


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lakesift")
    top.add_argument("--store", required=True)
    top.add_argument("--config", default="")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("add")
    p.add_argument("paths", nargs="+")
    p.add_argument("-c", "--collection", default="default")
    p.add_argument("--pattern", default="*.md")
    p.add_argument("--index", action="store_true")
    p.add_argument("--vault", help="copy the texts of the collection below this folder; without it files stay where they are and are linked by source_uri")
    p = sub.add_parser("index")
    p.add_argument("--doc-id", type=int)
    p.add_argument("--model", help="name of an embedding model of the server at --host")
    p.add_argument("--host", default="http://localhost:11434")
    p = sub.add_parser("search")
    p.add_argument("query")
    p.add_argument("-n", "--count", type=int)
    p.add_argument("-c", "--collection")
    p.add_argument("--since", help="only documents changed since: a day as 2024-05-01, or an age as 3d or 2w")
    p.add_argument("--language", help="only chunks with code of a language")
    p.add_argument("--field", action="append", default=[], metavar="PATH=VALUE", help="only documents whose front matter has a value at a path")
    p.add_argument("--json", action="store_true")
    p.add_argument("--no-rerank", action="store_true")
    p.add_argument("--context", action=argparse.BooleanOptionalAction, default=True, help="show the chunks before and after")
    p.add_argument("--embedder", help="name of the embedding model of the server at --host; without it, the one that the index was made with")
    p.add_argument("--no-expand", action="store_true", help="ask no model for other wordings")
    p.add_argument("--model", help="name of a language model of the server at --host, which words the query anew")
    p.add_argument("--host", default="http://localhost:11434")
    p.add_argument("-v", "--verbose", action="store_true")
    p = sub.add_parser("collections").add_subparsers(dest="action", required=True)
    q = p.add_parser("add")
    q.add_argument("name")
    q.add_argument("path")
    q.add_argument("--pattern", default="**/*.md")
    q.add_argument("--exclude", action="store_true", help="leave the collection out of searches that name none")
    q.add_argument("--ignore", nargs="*", default=[], help="patterns of files that are not read")
    q.add_argument("--context", default="", help="what the collection is about")
    p.add_parser("list")
    p.add_parser("update").add_argument("name")
    p = sub.add_parser("remove")
    p.add_argument("path")
    p.add_argument("-c", "--collection")
    p = sub.add_parser("purge")
    p.add_argument("--older-than", default="0d")
    p.add_argument("--dry-run", action="store_true")
    p = sub.add_parser("watch")
    p.add_argument("folder", nargs="?", help="a folder of change logs; without it the files of --collection are watched")
    p.add_argument("-c", "--collection")
    p.add_argument("--checkpoint", required=True)
    p.add_argument("--quiet", type=int, default=0, help="seconds without a change of a path, after which a burst of its changes is applied as one; with a log the watch then goes on")
    sub.add_parser("db-check")
    sub.add_parser("compact")
    p = sub.add_parser("vacuum")
    p.add_argument("--keep", type=int, default=1)
    return top


def age(text: str) -> timedelta:
    n, unit = text[:-1], text[-1:]
    if unit not in ("d", "w") or not n.isdigit():
        raise ValueError(f"not a number of days or weeks: {text}")
    return timedelta(days=int(n) * (7 if unit == "w" else 1))


def only_of(a: argparse.Namespace, now: datetime) -> search.Only:
    """What the options of a search leave."""
    wrong = [x for x in a.field if "=" not in x]
    if wrong:
        raise ValueError(f"not PATH=VALUE: {wrong[0]}")
    since = a.since and ((now - age(a.since)).strftime("%Y-%m-%d %H:%M:%S") if a.since[-1:] in "dw" else datetime.fromisoformat(a.since).strftime("%Y-%m-%d %H:%M:%S"))
    return search.Only(since, a.language, tuple(tuple(x.split("=", 1)) for x in a.field))


def embedder_of(store: Store, asked: str | None, host: str, width: int):
    """The model to embed queries with: the one asked for, or the index's own."""
    own = HashingEmbedder(width)
    held = [own.name] if asked else search.models(store)
    name = asked or (own.name if own.name in held or not held else held[0])
    if name.startswith("hashing-") and name[8:].isdigit():
        return HashingEmbedder(int(name[8:]))
    return ServedModel(name, host)


def line_of(place: int, row: dict) -> str:
    """A result as text: its place, a bar of its score, title and section, where its ranks come from, and its beginning."""
    share = max(0.0, min(1.0, (row["score"] + 10) / 20))
    full = round(share * BAR)
    ranks = " ".join(f"{name} #{row[k]}" for k, name in (("bm25_rank", "text"), ("vector_rank", "vector")) if row.get(k) is not None)
    shown = row.get("context") or row["excerpt"]
    return f"[{place}] {'█' * full}{'░' * (BAR - full)} {row['score']:.3f}  {row['title']} {('> ' + row['section_path']) if row['section_path'] else ''} ({row['collection']}{', ' + ranks if ranks else ''})\n    {' '.join(shown[:200].split())}"


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> object:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("lakesift").getOrCreate()
    store, settings, now = Store(spark, a.store), Settings.load(a.config), datetime.now(UTC)
    stamp, embedder = now.strftime("%Y-%m-%d %H:%M:%S"), HashingEmbedder(Settings.load(a.config).embedding.dimensions)
    if a.command == "add":
        total: dict[str, int] = {}
        for path in a.paths:
            for k, n in ingest.add_documents(store, read_files(spark, path, a.pattern), a.collection, stamp).items():
                total[k] = total.get(k, 0) + n
        if a.vault:
            total["copied"] = ingest.copy_to_vault(store, a.collection, a.vault).count()
        out: object = total | (ingest.index_documents(store, embedder, settings, stamp) if a.index else {})
    elif a.command == "index":
        out = ingest.index_documents(store, ServedModel(a.model, a.host) if a.model else embedder, settings, stamp, a.doc_id)
    elif a.command == "search":
        model = ServedModel(a.model, a.host) if a.model and not a.no_expand else None
        rows = search.search(store, a.query, embedder_of(store, a.embedder, a.host, settings.embedding.dimensions), stamp, settings, model, count=a.count, collection=a.collection, context=a.context, only=only_of(a, now), log=(lambda k, v: print(f"{k}: {v}")) if a.verbose else None, **({"reranker": False} if a.no_rerank else {}))
        out = json.dumps(rows, ensure_ascii=False) if a.json else "\n".join(line_of(i, r) for i, r in enumerate(rows, 1)) or "nothing found"
    elif a.command == "collections":
        if a.action == "add":
            out = ingest.register_collection(store, a.name, a.path, a.pattern, not a.exclude, a.ignore, {"/": a.context} if a.context else {})
        elif a.action == "update":
            out = ingest.update_collection(store, a.name, stamp)
        else:
            out = [r.asDict() for r in ingest.registry(store.table("store_collections").select("name", "path", "pattern", "include_by_default", "update_command"), store.table("documents")).collect()]
    elif a.command == "remove":
        out = ingest.remove(store, a.path, stamp, a.collection)
    elif a.command == "purge":
        out = ingest.purge(store, (now - age(a.older_than)).strftime("%Y-%m-%d %H:%M:%S"), a.dry_run)
    elif a.command == "watch":
        (watch(spark, store, a.folder, a.checkpoint, embedder, settings, once=not a.quiet, quiet=a.quiet) if a.folder else watch_folder(spark, store, a.collection, a.checkpoint, embedder, settings, quiet=a.quiet)).awaitTermination()
        out = store.version
    elif a.command == "compact":
        out = store.compact()
    elif a.command == "vacuum":
        out = store.vacuum(a.keep)
    else:
        out = {r["name"]: r["n_rows"] for r in ingest.table_counts(spark, {name: store.table(name) for name in TABLES}).collect()}
    print(out)
    return out


if __name__ == "__main__":
    main()
