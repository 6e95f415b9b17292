"""Text and structure of one transcript record's message.content.

The content is plain text, unless it starts with ``[{`` or is exactly ``[]``: then it is a list of blocks as JSON,
and damaged if it isn't valid JSON.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?", re.ASCII)
WORDS = {"true": True, "false": False, "null": None}
BLANKS = " \t\n\r"
#: Nothing but white space, as a Java pattern.
BLANK = r"(?U)^[\s\x1c-\x1f]*$"


def is_blocks(content: Column) -> Column:
    return content.startswith("[{") | (content == "[]")


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON")


def parse_json(text: str):
    """The value of a strict JSON text, of any depth. ValueError if it isn't JSON."""
    try:
        return json.loads(text, parse_constant=_no_constant)
    except RecursionError:
        return _parse_deep(text)


def _parse_deep(text: str):
    """As parse_json, without recursion: open containers are kept on a list."""
    n, at = len(text), 0

    def skip(i: int) -> int:
        while i < n and text[i] in BLANKS:
            i += 1
        return i

    open_, done, root = [], False, None
    key = None
    while True:
        at = skip(at)
        if done:
            if not open_:
                if at != n:
                    raise ValueError("extra data")
                return root
            top = open_[-1]
            c = text[at : at + 1]
            if c == ("}" if isinstance(top[0], dict) else "]"):
                open_.pop()
                at += 1
                key = top[1]
                continue
            if c != ",":
                raise ValueError("expected , or an end")
            at = skip(at + 1)
            done = False
            if isinstance(top[0], dict):
                key, at = _key(text, at, skip)
                continue
        c = text[at : at + 1]
        if c == '"':
            value, at = scanstring(text, at + 1, True)
        elif c in ("{", "["):
            value = {} if c == "{" else []
            _put(open_, key, value)
            root = value if not open_ else root
            at = skip(at + 1)
            if text[at : at + 1] == ("}" if c == "{" else "]"):
                at, done = at + 1, True
            else:
                open_.append((value, key))
                if c == "{":
                    key, at = _key(text, at, skip)
            continue
        elif m := NUMBER.match(text, at):
            value, at = json.loads(m[0]), m.end()
        else:
            word = next((w for w in WORDS if text.startswith(w, at)), None)
            if word is None:
                raise ValueError("expected a value")
            value, at = WORDS[word], at + len(word)
        _put(open_, key, value)
        root = value if not open_ else root
        done = True


def _key(text: str, at: int, skip) -> tuple[str, int]:
    if text[at : at + 1] != '"':
        raise ValueError("expected a name")
    key, at = scanstring(text, at + 1, True)
    at = skip(at)
    if text[at : at + 1] != ":":
        raise ValueError("expected :")
    return key, skip(at + 1)


def _put(open_: list, key, value) -> None:
    if open_:
        holder = open_[-1][0]
        if isinstance(holder, dict):
            holder[key] = value
        else:
            holder.append(value)


def block_text(content: str) -> tuple[str | None, bool, bool]:
    """Text of a list of blocks, joined with line feeds, whether the list is damaged, and whether it uses a tool."""
    try:
        blocks = parse_json(content)
    except ValueError:
        return None, True, False
    texts = [b["text"] for b in blocks if isinstance(b, dict) and b.get("type") == "text" and isinstance(b.get("text"), str)]
    uses = any(isinstance(b, dict) and b.get("type") == "tool_use" for b in blocks)
    return ("\n".join(texts) if texts else None), False, uses


def clean(text: str) -> str:
    """Without lone surrogates, which no UTF-8 column can hold."""
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if any("\ud800" <= c <= "\udfff" for c in text) else text


def with_text(records: DataFrame, content: Column | None = None) -> DataFrame:
    """Adds record_text, damaged and has_tool_use to records.

    record_text: plain content, or the block texts joined with line feeds; null where there is none. damaged: a list of
    blocks that isn't valid JSON. has_tool_use: a block of type tool_use. Plain rows keep to the JVM's columns; only lists of blocks are parsed by Arrow batches.
    A null content gives (null, false).
    """
    content = F.col("message.content") if content is None else content
    parsed = F.when(is_blocks(content), _parse_blocks(F.when(is_blocks(content), content)))
    text = F.when(is_blocks(content), F.col("_parsed.text")).otherwise(content)
    flag = lambda name: F.coalesce(F.col(f"_parsed.{name}"), F.lit(False))
    # The generator keeps Catalyst from pushing filters on the text below it, which would parse every list again.
    found = F.struct(text.alias("record_text"), flag("damaged").alias("damaged"), flag("tool_use").alias("has_tool_use"))
    kept = [c for c in records.columns if c not in ("record_text", "damaged", "has_tool_use")]
    return records.withColumn("_parsed", parsed).select(*kept, F.inline(F.array(found)))


@F.arrow_udf(T.StructType().add("text", "string").add("damaged", "boolean").add("tool_use", "boolean"))
def _parse_blocks(contents: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in contents:
        rows = [(None, False, False) if c is None else block_text(c) for c in batch.to_pylist()]
        texts = [t if t is None else clean(t) for t, _, _ in rows]
        flags = [pa.array([r[k] for r in rows], pa.bool_()) for k in (1, 2)]
        yield pa.StructArray.from_arrays([pa.array(texts, pa.string()), *flags], ["text", "damaged", "tool_use"])


def standing(records: DataFrame) -> DataFrame:
    """rec_id of the records that count: of rows with the same (source_file, line_num) the one with the smallest rec_id.

    A row without source_file or line_num has no name and stands for itself. The grouping combines before its shuffle, so
    that a record delivered any number of times is no hot group; only the three key columns are read.
    """
    nameless = F.when(F.col("source_file").isNull() | F.col("line_num").isNull(), F.col("rec_id"))
    return records.groupBy("source_file", "line_num", nameless.alias("nameless")).agg(F.min("rec_id").alias("rec_id")).select("rec_id")
