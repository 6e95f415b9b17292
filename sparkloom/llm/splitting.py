"""Oversized texts to pieces under a limit, cut at natural boundaries, with overlap.

Cut places are the ends of paragraphs, lines and sentences; ends of words join them only inside a stretch too long to be
cut otherwise, and places within a word only inside a run of characters that leaves no other way. Dynamic programming over
these places minimises the sum of cut penalties and squared shortfalls from the limit. A piece starts in the last `overlap`
characters of the piece before it, at the first boundary there, or exactly `overlap` back if there is none.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.blocks import standing, with_text

LIMIT, OVERLAP = 1600, 160
#: Cost of a cut at the end of a paragraph, line, sentence, word, and within a word. A shortfall costs at most 1.
KINDS = ("paragraph", "line", "sentence", "word", "hard", "end")
COSTS = (0.0, 0.15, 0.3, 1.5, 4.0, 0.0)
ENDS = (re.compile(r"(?:\r\n|\n|\r)[^\S\r\n]*(?:\r\n|\n|\r)\s*"), re.compile(r"(?:\r\n|\n|\r)\s*"), re.compile(r"[.!?…。！？][\"'»”’)\]]*(?:\s+|(?<=[。！？]))"), re.compile(r"\s+"))
PIECES = T.ArrayType(T.StructType().add("piece", "integer").add("start", "integer").add("stop", "integer").add("cut", "string").add("broken", "integer").add("text", "string"))
RUN = re.compile(r"\S+")


def cut_places(text: str, limit: int, overlap: int) -> tuple[list[int], list[int]]:
    """Places where pieces may end, in order, and the kind of each."""
    n, best = len(text), {}
    for kind in (2, 1, 0):
        best |= {m.end(): kind for m in ENDS[kind].finditer(text) if m.end() < n}
    best[n] = 5
    reach, step = limit - overlap, max(overlap, limit // 10)

    def fill(found: dict, make) -> None:
        at = [0, *sorted(found)]
        for a, b in zip(at, at[1:], strict=False):
            if b - a > reach:
                found |= {p: k for p, k in make(a, b) if a < p < b}

    fill(best, lambda a, b: [(m.end(), 3) for m in ENDS[3].finditer(text, a, b)])
    fill(best, lambda a, b: [(p, 4) for p in range(a + step, b, step)])
    places = sorted(best)
    return places, [best[p] for p in places]


def starts_after(text: str, places: list[int], overlap: int) -> list[int]:
    """Where the piece after a cut at each place starts: the first boundary in the overlap, else its full length back."""
    out = []
    for e in places:
        low = max(0, e - overlap)
        if low == e or low == 0 or (text[low - 1].isspace() and not text[low].isspace()):
            out.append(low)
            continue
        word = ENDS[3].search(text, low, e)
        strong = bisect_left(places, low)
        first = min(word.end() if word else e, places[strong])
        out.append(first if first < e else low)
    return out


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(start, stop, kind of cut) of the pieces of one text; one piece if it isn't over the limit."""
    if len(text) <= limit:
        return [(0, len(text), "end")]
    places, kinds = cut_places(text, limit, overlap)
    begin = np.array([0, *starts_after(text, places, overlap)])
    cost, came = np.full(len(places) + 1, np.inf), np.zeros(len(places) + 1, np.int64)
    cost[0], low = 0.0, 0
    for j, e in enumerate(places, 1):
        while e - begin[low] > limit:
            low += 1
        short = (limit - (e - begin[low:j])) / limit
        total = cost[low:j] + short * short
        k = int(np.argmin(total))
        cost[j], came[j] = total[k] + COSTS[kinds[j - 1]] + 0.05, low + k
    cuts, j = [], len(places)
    while j:
        cuts.append((int(begin[came[j]]), places[j - 1], KINDS[kinds[j - 1]]))
        j = int(came[j])
    return cuts[::-1]


def broken_runs(text: str, cuts: list[tuple[int, int, str]]) -> list[int]:
    """For each piece, the length of the run without white space that its end breaks; 0 if it breaks none."""
    if not any(kind == "hard" for _, _, kind in cuts):
        return [0] * len(cuts)
    runs = [m.span() for m in RUN.finditer(text)]
    ends = [e for _, e in runs]
    out = []
    for _, stop, kind in cuts:
        a, b = runs[min(bisect_left(ends, stop), len(runs) - 1)]
        out.append(b - a if kind == "hard" and a < stop < b else 0)
    return out


def split_rows(texts: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, broken, pieces): for each text longer than limit characters its pieces in order, and the length of the longest run
    without white space that the splitter had to break, 0 if none.

    Texts within the limit, null and empty ones have no row. Equal keys or texts are split each. The work is local to a row.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be smaller than half the limit")

    @F.arrow_udf(T.StructType().add("broken", "integer").add("pieces", PIECES))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        piece = pa.struct([("piece", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("cut", pa.string()), ("broken", pa.int32()), ("text", pa.string())])
        for batch in batches:
            out = []
            for t in batch.to_pylist():
                cuts = [] if t is None else split_text(t, limit, overlap)
                broken = broken_runs(t, cuts)
                pieces = [{"piece": i, "start": s, "stop": e, "cut": c, "broken": r, "text": t[s:e]} for i, ((s, e, c), r) in enumerate(zip(cuts, broken, strict=True))]
                out.append({"broken": max(broken, default=0), "pieces": pieces})
            yield pa.array(out, pa.struct([("broken", pa.int32()), ("pieces", pa.list_(piece))]))

    long = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.char_length("text") > limit)
    return long.select(F.col("key").alias(key), run("text").alias("cut")).select(key, "cut.broken", "cut.pieces")


def split_long(texts: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece, start, stop, cut, broken, text): the pieces of split_rows(), one row each.

    A piece is text[start:stop], at most limit characters (code points) long; cut says what it ends at, and broken how long
    the run without white space is that this breaks.
    """
    return split_rows(texts, key, text, limit, overlap).select(key, F.inline("pieces"))


def long_turns(records: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(rec_id, text) of the records of type user or assistant, without tool result, whose text is over the limit."""
    # A list of blocks is never shorter than its text, so only long contents are parsed and shuffled.
    speaks = F.col("type").isin("user", "assistant") & F.col("tool_use_result").isNull() & (F.char_length("message.content") > limit)
    rows = records.where(speaks).select("rec_id", "message").join(standing(records), "rec_id", "left_semi")
    return with_text(rows).where(F.char_length("record_text") > limit).select("rec_id", F.col("record_text").alias("text"))


def record_pieces(records: DataFrame) -> DataFrame:
    """(rec_id, piece, start, stop, cut, broken, text): the pieces of the long texts of transcript records."""
    return split_long(long_turns(records), "rec_id", "text")


def broken_records(records: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(rec_id, unbroken): the records with a long text, and whether a run longer than a piece had to be broken."""
    return split_rows(long_turns(records, limit), "rec_id", "text", limit).select("rec_id", (F.col("broken") > limit).cast("int").alias("unbroken"))
