"""The queries over HTTP, as JSON: GET /api/similar, phrase, phrase/lattice, pronounce, compare, info, phonemes, align.

`respond` does the work and needs no socket; ROUTES has all paths there are. A parameter out of its bounds gives status
400, an unknown path 404. An answer to a search has PAGE results at most: `more` tells that there are others, which come
with `offset`. Of searches with a range of moras two run at a time, and one that waits longer than WAIT seconds gives 503.
"""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .api import Phonetics
from .operators import phrase as H
from .operators import search as S
from .sources.lexicon import parse_categories

RANGED, WAIT = 2, 30.0
MOST_PHRASES, PAGE = 50, 500


def rows(df: DataFrame, *order: str) -> list[dict]:
    """Results of one query, whose number is bounded."""
    return [json.loads(r[0]) for r in df.orderBy(*order).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).collect()]


class Given(dict):
    """Parameters as they were given."""

    def text(self, name: str) -> str:
        if not self.get(name):
            raise ValueError(f"{name} is missing")
        return self[name]

    def whole(self, name: str, default: int | None) -> int | None:
        return int(self[name]) if name in self else default

    def number(self, name: str, default: float) -> float:
        return float(self[name]) if name in self else default


class Service:
    def __init__(self, sounds: Phonetics):
        self.sounds, self.gate = sounds, threading.BoundedSemaphore(RANGED)

    def respond(self, path: str, given: dict[str, str]) -> tuple[int, dict]:
        work = ROUTES.get(path)
        if work is None:
            return 404, {"error": f"no {path}"}
        try:
            return 200, work(self, Given(given))
        except TimeoutError as error:
            return 503, {"error": str(error)}
        except (ValueError, KeyError) as error:
            return 400, {"error": str(error)}

    def read(self, g: Given) -> DataFrame:
        """The reading of q, found out once."""
        found = self.sounds.readings([g.text("q")])
        return found.sparkSession.createDataFrame(found.collect(), found.schema)  # one row

    def query(self, asked: DataFrame) -> dict:
        return rows(self.sounds.pronounce(asked), "query_id")[0]

    def similar(self, g: Given) -> dict:
        how = {"preset": g.get("preset", "pun"), "candidates": g.whole("candidates", S.CANDIDATES)}
        how |= {k: g.whole(k, None) for k in ("min_mora", "max_mora")}
        limit, offset = g.whole("limit", 0), g.whole("offset", 0)
        if limit < 0 or offset < 0:
            raise ValueError("limit and offset must not be below 0")
        if g.get("categories"):
            how["categories"] = parse_categories(g["categories"])
        asked = self.read(g)
        ranged = how["min_mora"] is not None or how["max_mora"] is not None
        if ranged and not self.gate.acquire(timeout=WAIT):
            raise TimeoutError("too many searches over ranges")
        try:
            every = self.sounds.similar_with_floor(asked, limit=limit, min_score=g.number("min_score", 0.7), **how)
            found = rows(every.where((F.col("rank") > offset) & (F.col("rank") <= offset + PAGE + 1)), "rank")
        finally:
            if ranged:
                self.gate.release()
        results = [{k: v for k, v in r.items() if k not in ("query_id", "below_floor")} for r in found[:PAGE]]
        return {"query": self.query(asked), "below_floor": any(r["below_floor"] for r in found), "results": results, "more": len(found) > PAGE}

    def how(self, g: Given) -> dict:
        how = {"max_chunk": g.whole("max_chunk_moras", H.MAX_CHUNK), "keep": g.whole("chunk_candidates", H.CHUNK_CANDIDATES), "beam": g.whole("beam_width", H.BEAM), "least": g.number("min_chunk_score", H.MIN_CHUNK)}
        return how | {"allow_particles": g.get("allow_particles", "true") != "false"}

    def phrase(self, g: Given) -> dict:
        limit = g.whole("limit", 10)
        if not 1 <= limit <= MOST_PHRASES:
            raise ValueError(f"limit must be between 1 and {MOST_PHRASES}")
        asked = self.read(g)
        return {"query": self.query(asked), "results": rows(self.sounds.phrase(asked, limit=limit, **self.how(g)), "rank")}

    def lattice(self, g: Given) -> dict:
        asked = self.read(g)
        nodes, edges = self.sounds.lattice(asked, node_budget=g.whole("node_budget", H.NODE_BUDGET), max_nodes_per_span=g.whole("max_nodes_per_span", H.NODES_PER_SPAN), **self.how(g))
        return {"query": self.query(asked), "nodes": rows(nodes, "place"), "edges": rows(edges, "place")}

    def pronounce(self, g: Given) -> dict:
        return rows(self.sounds.pronounce([g.text("q")]), "query_id")[0]

    def compare(self, g: Given) -> dict:
        return rows(self.sounds.compare([(g.text("a"), g.text("b"))]), "pair")[0]

    def info(self, g: Given) -> dict:
        return {r["name"]: r["value"] for r in rows(self.sounds.info(), "name")} | {"presets": rows(self.sounds.presets(), "preset", "component")}

    def phonemes(self, g: Given) -> dict:
        return {"phonemes": rows(self.sounds.phonemes(), "kind", "symbol")}

    def align(self, g: Given) -> dict:
        pairs, total = self.sounds.align(g.get("a", "").split(), g.get("b", "").split())
        return {"pairs": pairs, "distance": total}


ROUTES = {
    "/api/similar": Service.similar,
    "/api/phrase": Service.phrase,
    "/api/phrase/lattice": Service.lattice,
    "/api/pronounce": Service.pronounce,
    "/api/compare": Service.compare,
    "/api/info": Service.info,
    "/api/phonemes": Service.phonemes,
    "/api/align": Service.align,
}


def handler(service: Service) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            url = urlsplit(self.path)
            status, body = service.respond(url.path, {k: v[-1] for k, v in parse_qs(url.query).items()})
            data = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

    return Handler


def serve(sounds: Phonetics, host: str = "127.0.0.1", port: int = 8000) -> None:
    ThreadingHTTPServer((host, port), handler(Service(sounds))).serve_forever()
