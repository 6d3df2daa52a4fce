r"""Chat formatting with offset-aligned loss masks.

A conversation becomes turns `<|turn|>role<|text|>text<|end|>`. Control strings inside roles and texts (CONTROLS) are
escaped: `&` becomes `&amp;` and the first character of each control string an entity, so no control string is left and
unescaping gives the exact text back. The markers are special tokens of the tokenizer, so a token never spans a marker
and text. The rendered conversation is encoded once with offsets; the sorted spans of the turns are intersected with
the sorted token spans by binary search, which gives the loss mask (assistant texts).

Rows are dealt by conversation and sorted by turn, then role and text, within the partition; a task reads them in order
and formats blocks of whole turns of about BLOCK_CHARS characters. As special tokens end every block, the blocks' ids
are those of the whole conversation. So a conversation of any length takes bounded memory; it is one task's work, as
its digest is a hash over its turns in order.

Defined cases: a null text or role is empty; null turns come first; equal turns stay, in order of role and text;
rows with a null conv_id are one conversation; a conversation without assistant texts has an empty loss text; an empty
table gives only what is added; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, columns, record

TURN, TEXT, FINISH = "<|turn|>", "<|text|>", "<|end|>"
# Strings that chat templates and tokenizers treat as control strings.
CONTROLS = (TURN, TEXT, FINISH, "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
BLOCK_CHARS = 1 << 18

ENTITIES = {"&": "&amp;", "<": "&lt;", "[": "&lsqb;"}
ESCAPE = re.compile("&|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS))
UNESCAPE = re.compile("&(?:amp|lt|lsqb);")
RENDERED = re.compile(f"{re.escape(TURN)}(.*?){re.escape(TEXT)}(.*?){re.escape(FINISH)}", re.DOTALL)
BACK = {v: k for k, v in ENTITIES.items()}

DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"
BLOCKS = "conv_id long, block long, text string, ids array<int>, loss array<boolean>, starts array<int>, ends array<int>"


def escape(text: str) -> str:
    return ESCAPE.sub(lambda m: ENTITIES[m[0]], text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(lambda m: BACK[m[0]], text) if "&" in text else text


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"{TURN}{escape(role)}{TEXT}{escape(text)}{FINISH}" for role, text in turns)


@lru_cache(2)
def encoder(tokenizer: str):
    from tokenizers import AddedToken, Tokenizer

    found = Tokenizer.from_file(tokenizer)
    found.add_special_tokens([AddedToken(t, special=True, normalized=False) for t in (TURN, TEXT, FINISH)])
    return found


def mask(text: str, tokenizer: str) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """(ids, starts, ends, loss) of a rendered text; offsets are code points."""
    got = encoder(tokenizer).encode(text, add_special_tokens=False)
    spans = np.array(got.offsets, np.int64).reshape(-1, 2)
    starts, ends = spans[:, 0].copy(), spans[:, 1].copy()
    loss = np.zeros(len(starts), bool)
    for m in RENDERED.finditer(text):
        if unescape(m[1]) == "assistant" and m.start(2) < m.end(2):
            loss[np.searchsorted(ends, m.start(2), "right") : np.searchsorted(starts, m.end(2), "left")] = True
    return got.ids, starts, ends, loss


def under(text: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> list[str]:
    """The runs of text under the mask; a character whose bytes are in several tokens counts once."""
    out: list[list[int]] = []
    for a, b in zip(starts[loss].tolist(), ends[loss].tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [text[a:b] for a, b in out]


def formatted(rows: DataFrame, tokenizer: str, digest: bool) -> DataFrame:
    """DIGESTS of each conversation, or its BLOCKS."""
    schema = DIGESTS if digest else BLOCKS
    arrow = arrow_schema(rows.sparkSession, schema)
    kinds = {"conv_id": "long", "turn": "long", "role": "string", "text": "string"}
    plain = columns(rows, *kinds).select(*[F.col(c).cast(k) for c, k in kinds.items()]).fillna("", ["role", "text"])
    dealt = plain.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        done: list[dict] = []

        def begin(conv) -> None:
            state.update(conv=conv, turns=[], chars=0, block=0, n=0, whole=hashlib.sha256(), loss=hashlib.sha256(), loss_chars=0, formatted=0, tokens=0, loss_tokens=0)

        def block() -> None:
            text = render(state["turns"])
            ids, starts, ends, loss = mask(text, tokenizer)
            if not digest:
                done.append({"conv_id": state["conv"], "block": state["block"], "text": text, "ids": ids, "loss": loss, "starts": starts, "ends": ends})
            for m in RENDERED.finditer(text):  # read back
                state["whole"].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                state["n"] += 1
            for piece in under(text, starts, ends, loss):
                back = unescape(piece)
                state["loss"].update(back.encode())
                state["loss_chars"] += len(back)
            state["formatted"] += len(text)
            state["tokens"] += len(ids)
            state["loss_tokens"] += int(loss.sum())
            state.update(turns=[], chars=0, block=state["block"] + 1)

        def end() -> None:
            if state["turns"]:
                block()
            if digest:
                done.append({"conv_id": state["conv"], "n_turns": state["n"], "turns_sha256": state["whole"].hexdigest(), "loss_chars": state["loss_chars"], "loss_sha256": state["loss"].hexdigest(), "formatted_chars": state["formatted"], "n_tokens": state["tokens"], "n_loss_tokens": state["loss_tokens"]})

        def flush() -> Iterator[pa.RecordBatch]:
            if done:
                yield record({f.name: [x[f.name] for x in done] for f in arrow}, arrow)
                done.clear()

        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if not state or state["conv"] != conv:
                    if state:
                        end()
                    begin(conv)
                state["turns"].append((role, text))
                state["chars"] += len(text)
                if state["chars"] >= BLOCK_CHARS:
                    block()
                    yield from flush()
            yield from flush()
        if state:
            end()
            yield from flush()

    return dealt.mapInArrow(run, schema)


def conversation_digests(rows: DataFrame, tokenizer: str) -> DataFrame:
    return formatted(rows, tokenizer, True)


def conversation_blocks(rows: DataFrame, tokenizer: str) -> DataFrame:
    """The formatted text, ids, offsets and loss mask, in blocks of whole turns."""
    return formatted(rows, tokenizer, False)
