"""python -m soundweave.cli: queries from a shell."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .api import Phonetics, as_json
from .functions.scoring import PRESETS
from .operators import index as X
from .operators import phrase as H
from .operators import search as S
from .sources import dictionary, lexicon


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="soundweave")
    kinds = top.add_subparsers(dest="command", required=True)

    def add(name: str, text: str, index: bool = True) -> argparse.ArgumentParser:
        own = kinds.add_parser(name, help=text)
        own.add_argument("--json", action="store_true", help="one JSON object a row")
        if index:
            own.add_argument("--index", default=X.default_path(), help="folder of the index")
        return own

    similar = add("similar", "words that sound alike")
    similar.add_argument("query", nargs="+")
    similar.add_argument("-n", "--limit", type=int, default=10, help="0: all")
    similar.add_argument("--preset", choices=sorted(PRESETS), default="pun")
    similar.add_argument("--candidates", type=int, default=S.CANDIDATES)
    similar.add_argument("--min-score", type=float, default=0.0)
    similar.add_argument("--category", default=None, help="names with commas")
    similar.add_argument("--min-mora", type=int)
    similar.add_argument("--max-mora", type=int)
    phrase = add("phrase", "chains of words that sound like a text")
    phrase.add_argument("text", nargs="+")
    phrase.add_argument("-n", "--limit", type=int, default=10)
    phrase.add_argument("--max-chunk", type=int, default=H.MAX_CHUNK)
    phrase.add_argument("--chunk-candidates", type=int, default=H.CHUNK_CANDIDATES)
    phrase.add_argument("--beam", type=int, default=H.BEAM)
    phrase.add_argument("--min-chunk-score", type=float, default=H.MIN_CHUNK)
    phrase.add_argument("--no-particles", action="store_true")
    phrase.add_argument("--lattice", action="store_true", help="the graph's nodes and edges instead")
    compare = add("compare", "two words")
    compare.add_argument("a")
    compare.add_argument("b")
    pronounce = add("pronounce", "readings and sounds")
    pronounce.add_argument("text", nargs="+")
    build = add("build-index", "an index from a dictionary file or a table of entries")
    build.add_argument("source", help="a .dic file, or Parquet with word_id, surface, reading, normalized, pos, cost")
    build.add_argument("--frequencies", help="tab-separated surface and documents, with a [TOTAL] row")
    build.add_argument("--min-mora", type=int, default=lexicon.MIN_MORA)
    build.add_argument("--max-mora", type=int, default=lexicon.MAX_MORA)
    build.add_argument("--force", action="store_true", help="replace an index that is there")
    add("info", "about an index")
    add("serve", "answer as tools over standard input and output")
    web = add("web", "answer over HTTP")
    web.add_argument("--host", default="127.0.0.1")
    web.add_argument("--port", type=int, default=8000)
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("soundweave").getOrCreate()

    def show(df, key="query_id"):
        if a.json:
            for row in as_json(df, key).toLocalIterator():
                print(row["json"])
        else:
            print("\t".join(df.columns))
            for row in df.toLocalIterator():  # all rows, a partition at a time
                print("\t".join(" ".join(map(str, x)) if isinstance(x, list) else "" if x is None else str(x) for x in row))

    if a.command == "build-index":
        entries = dictionary.read_dictionary(spark, a.source) if a.source.endswith(".dic") else spark.read.parquet(a.source)
        counts, total = lexicon.read_frequencies(spark, a.frequencies) if a.frequencies else (None, None)
        began = time.monotonic()
        told = lambda what: print(f"[{time.monotonic() - began:6.0f}s] {what}", file=sys.stderr, flush=True)
        try:
            print(X.build(lexicon.lexicon(entries, counts, total, a.min_mora, a.max_mora), a.index, force=a.force, progress=told))
        except FileExistsError as error:
            print(f"{error} (--force)", file=sys.stderr)
            return 1
        return 0
    if a.command == "serve":
        from .mcp import serve

        serve(lambda: Phonetics.open(spark, a.index))
        return 0
    own = Phonetics.open(spark, a.index)
    if a.command == "similar":
        found = own.similar(a.query, limit=a.limit, preset=a.preset, candidates=a.candidates, min_score=a.min_score, categories=a.category, min_mora=a.min_mora, max_mora=a.max_mora)
        show(found.orderBy("query_id", "rank"))
    elif a.command == "phrase":
        how = {"max_chunk": a.max_chunk, "keep": a.chunk_candidates, "beam": a.beam, "least": a.min_chunk_score, "allow_particles": not a.no_particles}
        if a.lattice:
            for df in own.lattice(a.text, **how):
                show(df.orderBy("phrase_id", "place"), "phrase_id")
        else:
            show(own.phrase(a.text, limit=a.limit, **how).orderBy("phrase_id", "rank"), "phrase_id")
    elif a.command == "compare":
        show(own.compare([(a.a, a.b)]), "pair")
    elif a.command == "pronounce":
        show(own.pronounce(a.text).orderBy("query_id"))
    elif a.command == "web":
        from .server import serve

        serve(own, a.host, a.port)
    else:
        show(own.info().orderBy(F.col("name")), "name")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
