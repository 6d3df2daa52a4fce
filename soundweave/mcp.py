"""Four tools over the Model Context Protocol: JSON-RPC 2.0, one message a line, on standard input and output.

search_phonetically, compose_phrase, compare_phonetically and pronounce answer with one text of JSON. `Tools.respond` does
the work and needs no streams. The index is opened with the first call of a tool. A tool's own errors (a wrong preset,
say) are texts of JSON too; a call that isn't understood is an error of the protocol.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from typing import TextIO

from .api import Phonetics
from .functions.scoring import PRESETS
from .operators import index as X
from .operators import phrase as H
from .operators import search as S
from .server import rows
from .sources.lexicon import CATEGORIES, parse_categories

# How many results an answer has at most, the protocol's version, and its codes of errors.
MOST = 200
VERSION = "2025-06-18"
PARSE_ERROR, NO_METHOD, BAD_PARAMETERS = -32700, -32601, -32602

NOTE = "Scores are about sound alone, not about meaning: choose among the results by meaning."
TEXT, WHOLE, NUMBER, FLAG = ({"type": t} for t in ("string", "integer", "number", "boolean"))
#: name: (what it does, parameters with their types, those that must be given)
TOOLS: dict[str, tuple[str, dict, list[str]]] = {
    "search_phonetically": (
        "Words that sound like one word. A range of moras searches all words of these lengths, which takes longer.",
        {"query": TEXT, "limit": WHOLE, "preset": TEXT | {"enum": sorted(PRESETS)}, "categories": {"type": "array", "items": TEXT}, "candidates": WHOLE, "min_mora": WHOLE, "max_mora": WHOLE},
        ["query"],
    ),
    "compose_phrase": (
        "Chains of words and function words that sound like a longer text, for which there is no single word.",
        {"text": TEXT, "limit": WHOLE, "max_chunk_moras": WHOLE, "min_chunk_score": NUMBER, "allow_particles": FLAG},
        ["text"],
    ),
    "compare_phonetically": ("How alike two words sound, as a whole and by consonants, vowels, endings and rhythm.", {"a": TEXT, "b": TEXT}, ["a", "b"]),
    "pronounce": ("Reading, phonemes, moras and vowels of a text.", {"text": TEXT}, ["text"]),
}


def bounded(limit: int) -> int:
    return min(max(limit, 1), MOST)


class Tools:
    def __init__(self, open_index: Callable[[], Phonetics]):
        self._open, self._sounds = open_index, None

    @property
    def sounds(self) -> Phonetics:
        if self._sounds is None:
            self._sounds = self._open()
        return self._sounds

    def _read(self, text: str) -> tuple:
        found = self.sounds.readings([text])
        asked = found.sparkSession.createDataFrame(found.collect(), found.schema)  # one row
        heard = rows(self.sounds.pronounce(asked), "query_id")[0]
        return asked, {k: v for k, v in heard.items() if k not in ("query_id", "text", "vowel_skeleton")}

    def search_phonetically(self, query: str, limit: int = 10, preset: str = "pun", categories: list[str] | None = None, candidates: int = S.CANDIDATES, min_mora: int | None = None, max_mora: int | None = None) -> dict:
        if preset not in PRESETS:
            return {"error": f"unknown preset {preset}", "available": sorted(PRESETS)}
        try:
            wanted = parse_categories(",".join(categories)) if categories else None
        except ValueError as error:
            return {"error": str(error), "available": list(CATEGORIES)}
        ranged = min_mora is not None or max_mora is not None
        asked, heard = self._read(query)
        try:
            scanned = X.mora_range(self.sounds.index.lexicon, min_mora, max_mora).count() if ranged else None
            found = rows(self.sounds.similar(asked, limit=bounded(limit), preset=preset, categories=wanted, candidates=candidates, min_mora=min_mora, max_mora=max_mora).drop("query_id"), "rank")
        except ValueError as error:
            return {"error": str(error)}
        return {"query": query, **heard, "preset": preset, "min_mora": min_mora, "max_mora": max_mora, "scanned": scanned, "note": NOTE, "results": found}

    def compose_phrase(self, text: str, limit: int = 10, max_chunk_moras: int = H.MAX_CHUNK, min_chunk_score: float = H.MIN_CHUNK, allow_particles: bool = True) -> dict:
        asked, heard = self._read(text)
        try:
            found = rows(self.sounds.phrase(asked, limit=bounded(limit), max_chunk=max_chunk_moras, least=min_chunk_score, allow_particles=allow_particles).drop("phrase_id"), "rank")
        except ValueError as error:
            return {"error": str(error)}
        return {"text": text, **heard, "note": NOTE, "results": found}

    def compare_phonetically(self, a: str, b: str) -> dict:
        return {k: v for k, v in rows(self.sounds.compare([(a, b)]), "pair")[0].items() if k != "pair"}

    def pronounce(self, text: str) -> dict:
        return {k: v for k, v in rows(self.sounds.pronounce([text]), "query_id")[0].items() if k != "query_id"}

    def call(self, name: str, given: dict) -> dict:
        """A tool's answer; ValueError for one that isn't there, or parameters it doesn't take."""
        if name not in TOOLS:
            raise ValueError(f"no tool {name}")
        _, known, needed = TOOLS[name]
        if wrong := [k for k in given if k not in known] + [k for k in needed if not isinstance(given.get(k), str)]:
            raise ValueError(f"{name}: wrong or missing {', '.join(wrong)}")
        return getattr(self, name)(**{k: v for k, v in given.items() if v is not None})

    def respond(self, message: dict) -> dict | None:
        """The answer to a message; None to a notification."""
        method, number, given = message.get("method"), message.get("id"), message.get("params") or {}
        if number is None:
            return None
        answer = {"jsonrpc": "2.0", "id": number}
        if method == "initialize":
            return answer | {"result": {"protocolVersion": VERSION, "capabilities": {"tools": {}}, "serverInfo": {"name": "soundweave", "version": "1"}, "instructions": NOTE}}
        if method == "ping":
            return answer | {"result": {}}
        if method == "tools/list":
            tools = [{"name": n, "description": text, "inputSchema": {"type": "object", "properties": known, "required": needed}} for n, (text, known, needed) in TOOLS.items()]
            return answer | {"result": {"tools": tools}}
        if method != "tools/call":
            return answer | {"error": {"code": NO_METHOD, "message": f"no method {method}"}}
        try:
            found = self.call(given.get("name"), given.get("arguments") or {})
        except (TypeError, ValueError) as error:
            return answer | {"error": {"code": BAD_PARAMETERS, "message": str(error)}}
        return answer | {"result": {"content": [{"type": "text", "text": json.dumps(found, ensure_ascii=False)}], "isError": "error" in found}}


def serve(open_index: Callable[[], Phonetics], source: TextIO = sys.stdin, sink: TextIO = sys.stdout) -> None:
    tools = Tools(open_index)
    for line in source:
        if line.strip():
            try:
                answer = tools.respond(json.loads(line))
            except json.JSONDecodeError as error:
                answer = {"jsonrpc": "2.0", "id": None, "error": {"code": PARSE_ERROR, "message": str(error)}}
            if answer is not None:
                print(json.dumps(answer, ensure_ascii=False), file=sink, flush=True)
