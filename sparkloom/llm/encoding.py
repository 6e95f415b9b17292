"""The whole corpus as token ids of a public byte-level BPE.

Encoding is tiktoken's, over a local rank file. Long texts are cut first where the pre-splitting pattern always starts a
new match, so the ids are those of the whole text. Decoding joins the tokens' raw bytes, since one character may span
several tokens.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-splitting pattern that belongs to the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_RANK_BYTES = 16 << 20
CHUNK, LONG_SPACE = 1 << 16, 10_000
SPACES = re.compile(r"[^\S\x1c-\x1f]{%d,}" % LONG_SPACE)
#: A match never runs on from what isn't white space into white space, nor from an ASCII letter into a digit or back.
SAFE = re.compile(r"(?<=[^\s\x1c-\x1f])(?=[ \n])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


def load_ranks(path: str = RANKS) -> bytes:
    """The rank file, of at most MAX_RANK_BYTES: it is sent to every executor."""
    with open(path, "rb") as f:
        data = f.read(MAX_RANK_BYTES + 1)
    if len(data) > MAX_RANK_BYTES:
        raise ValueError(f"{path} is larger than {MAX_RANK_BYTES} bytes")
    return data


def encoding(data: bytes, pattern: str = PATTERN):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """The text in parts of about size characters, cut only at safe places; a part without any stays whole."""
    at = 0
    while len(text) - at > size:
        m = SAFE.search(text, at + size)
        if m is None or m.start() >= len(text):
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def encode_text(enc, text: str) -> list[int]:
    """Ids of a text of any length. Very long white space, which the pattern's look-ahead can't take, is one piece up to
    its last character, as the pattern has it, or whole at the end of the text."""
    if len(text) <= LONG_SPACE:
        return enc.encode_ordinary(text)
    ids, at = [], 0
    for m in SPACES.finditer(text):
        stop = m.end() if m.end() == len(text) else m.end() - 1
        ids += [i for part in chunks(text[at : m.start()]) for i in enc.encode_ordinary(part)]
        ids += enc._encode_single_piece(text[m.start() : stop])
        at = stop
    return ids + [i for part in chunks(text[at:]) for i in enc.encode_ordinary(part)]


def encode(documents: DataFrame, key: str, text: str, ranks: str = RANKS) -> DataFrame:
    """(key, ids): the token ids of each text, without special tokens; an empty list for an empty or null text.

    One row for each row given, repeated keys and texts too. The work is local to a row: no shuffle, no other column read.
    """
    data = documents.sparkSession.sparkContext.broadcast(load_ranks(ranks))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoding(data.value)
        for batch in batches:
            yield pa.array([encode_text(enc, t) if t else [] for t in batch.to_pylist()], pa.list_(pa.int32()))

    return documents.select(F.col(key), run(F.col(text)).alias("ids"))


def decode(tokens: DataFrame, key: str, ids: str = "ids", ranks: str = RANKS) -> DataFrame:
    """(key, text): the text of each list of ids; bytes that are no UTF-8 become U+FFFD. A null list gives null."""
    data = tokens.sparkSession.sparkContext.broadcast(load_ranks(ranks))

    @F.arrow_udf(T.StringType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoding(data.value)
        for batch in batches:
            yield pa.array([None if x is None else enc.decode_bytes(x).decode("utf-8", "replace") for x in batch.to_pylist()], pa.string())

    return tokens.select(F.col(key), run(F.col(ids)).alias("text"))


def round_trip(spark: SparkSession, documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, tokens, same): how many tokens each text has, and whether decoding them gives the text back."""
    both = documents.select(F.col(key), F.col(text).alias("text"))
    data = spark.sparkContext.broadcast(load_ranks())

    @F.arrow_udf(T.StructType().add("tokens", "integer").add("same", "boolean"))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoding(data.value)
        kind = pa.struct([("tokens", pa.int32()), ("same", pa.bool_())])
        for batch in batches:
            out = []
            for t in batch.to_pylist():
                ids = encode_text(enc, t) if t else []
                out.append({"tokens": len(ids), "same": enc.decode_bytes(ids).decode("utf-8", "replace") == (t or "")})
            yield pa.array(out, kind)

    return both.select(F.col(key), run("text").alias("r")).select(key, "r.tokens", "r.same")
