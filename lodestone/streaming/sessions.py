"""Conversations turn by turn: every question is answered with what its session said before, and is written to memory."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as X
from ..functions.models import NOTHING_FOUND, quoting_model
from ..operators import answers as A
from ..operators.memory import HISTORY, MAX_WORKING

#: Topics of a session that count, and characters of a message in the history and of a question in the summary.
TOPICS, SHORT_MESSAGE, SHORT_SUMMARY = 10, 150, 120
CANNED = {"greeting": A.GREETING, "irrelevant": A.IRRELEVANT}
_OUT = "turn bigint, query_type string, history string, message_count bigint, summary string, topics array<string>, response string"
_STATE = "roles array<string>, contents array<string>, messages bigint, first string, topics array<string>"


@dataclass
class Memory:
    """What a session keeps: the newest messages, their number, the first question, the first topics in order."""

    roles: list[str] = field(default_factory=list)
    contents: list[str] = field(default_factory=list)
    messages: int = 0
    first: str | None = None
    topics: list[str] = field(default_factory=list)

    def history(self) -> str:
        lines = [("**Q:** " if r == "user" else "**A:** ") + _short(c, SHORT_MESSAGE) for r, c in zip(self.roles[-HISTORY:], self.contents[-HISTORY:])]
        return "\n---\n**Recent conversation:**\n" + "\n".join(lines) if lines else ""

    def write(self, question: str, answer: str, topics: list[str]) -> None:
        self.roles, self.contents = [*self.roles, "user", "assistant"][-MAX_WORKING:], [*self.contents, question, answer][-MAX_WORKING:]
        self.messages += 2
        self.first = question if self.first is None else self.first
        self.topics = sorted({*self.topics, *topics})[:TOPICS]


def _short(text: str, most: int) -> str:
    return text if len(text) <= most else text[: most - 3] + "..."


def _text(raw: str | None) -> str:
    """The answer in a model's output: the field of its JSON, else the output itself."""
    try:
        found = json.loads(raw or "")
    except ValueError:
        return raw or NOTHING_FOUND
    return (found.get("answer_text") if isinstance(found, dict) else raw) or NOTHING_FOUND


def reply(memory: Memory, question: str, kind: str, topics: list[str], context: str, answer: Callable[[list[str]], list[str | None]]) -> tuple:
    """Answer one question and write it to ``memory``: the history it saw, messages, summary and topics after it, response."""
    seen = memory.history()
    response = CANNED[kind] if kind in CANNED else _text(answer([f"{context}\n\nQuestion: {question}{seen}"])[0])
    memory.write(question, response, topics)
    return seen, memory.messages, "Conversation about: " + _short(memory.first, SHORT_SUMMARY), list(memory.topics), response


def _prepared(turns: DataFrame) -> DataFrame:
    """What needs no memory, by built-in functions: class and topics of each question."""
    query = F.coalesce("query", F.lit("")).alias("query")
    context = F.coalesce("context", F.lit("")).alias("context") if "context" in turns.columns else F.lit("").alias("context")
    return turns.select("session_id", "turn", query, X.query_class(F.col("query")).alias("query_type"), F.coalesce(X.clean_topics(F.col("query")), F.array().cast("array<string>")).alias("topics"), context)


def _replies(rows: pd.DataFrame, memory: Memory, answer: Callable) -> list[tuple]:
    out = []
    for turn, query, kind, topics, context in zip(rows["turn"], rows["query"], rows["query_type"], rows["topics"], rows["context"]):
        seen, *rest = reply(memory, query, kind, list(topics), context, answer)
        out.append((None if pd.isna(turn) else int(turn), kind, seen, *rest))
    return out


_COLUMNS = ["turn", "query_type", "history", "message_count", "summary", "topics", "response"]


def converse(turns: DataFrame, model: Callable[[], Callable] = quoting_model) -> DataFrame:
    """``turns`` (session_id, turn, query and, optionally, context: the retrieved chunks as a prompt) -> ``session_id, turn,
    query_type, history, message_count, summary, topics, response``.

    A session's turns follow each other by number, equal numbers by question and context, one without a number first; a
    session without id is one session, a null question an empty one. Greetings and off-topic questions get their fixed
    reply and are remembered too. Rows stream through sorted by session, with one session's memory at a time: a session
    that holds most of the rows needs no room, though its turns are sequential by nature. A lost task starts its sessions
    over; ``model`` may then be asked again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        answer, at, memory = model(), object(), Memory()
        for b in batches:
            out, sessions = [], []
            b["_key"] = [None if pd.isna(k) else k for k in b["session_id"].astype(object)]
            for key, rows in b.groupby((b["_key"].astype(str) != b["_key"].astype(str).shift()).cumsum(), sort=False):
                k = rows["_key"].iloc[0]
                if k != at:
                    at, memory = k, Memory()
                out += _replies(rows, memory, answer)
                sessions += [k] * len(rows)
            yield pd.DataFrame(out, columns=_COLUMNS).assign(session_id=pd.Series(sessions, dtype=object))[["session_id", *_COLUMNS]]

    rows = _prepared(turns).repartition("session_id").sortWithinPartitions("session_id", "turn", "query", "context")
    return rows.mapInPandas(run, f"session_id {turns.schema['session_id'].dataType.simpleString()}, {_OUT}")


class _Converse(StatefulProcessor):
    def __init__(self, model: Callable[[], Callable]) -> None:
        self.model = model

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.answer = self.model()
        self.memory = handle.getValueState("memory", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        memory = Memory()
        if self.memory.exists():
            roles, contents, messages, first, topics = self.memory.get()
            memory = Memory(list(roles), list(contents), messages, first, list(topics))
        turns = pd.concat(list(rows)).sort_values(["turn", "query", "context"], na_position="first")
        out = pd.DataFrame(_replies(turns, memory, self.answer), columns=_COLUMNS)
        self.memory.update((memory.roles, memory.contents, memory.messages, memory.first, memory.topics))
        out.insert(0, "session_id", [key[0]] * len(out))
        yield out

    def close(self) -> None:
        pass


def converse_stream(turns: DataFrame, model: Callable[[], Callable] = quoting_model) -> DataFrame:
    """``converse`` of a stream: a session's memory is state, at most ten messages and ten topics, and comes back after a
    restart. Turns of a session that come together are put in order; a batch answers before the next one's turns.
    Needs the RocksDB state store and append mode."""
    schema = f"session_id {turns.schema['session_id'].dataType.simpleString()}, {_OUT}"
    return _prepared(turns).groupBy("session_id").transformWithStateInPandas(_Converse(model), schema, "append", "none")
