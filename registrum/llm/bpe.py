"""Byte-level BPE encoding and decoding with overlapping chunks.

Texts are cut into chunks that overlap. Every chunk is split into pre-tokens on its own, in parallel; a chunk's cuts become
those of the whole text from the first place in the overlap where it and the chunk before it cut alike, since what the
pattern matches depends only on the text that follows. The pieces between the cuts are then encoded by their ranks.
"""

import base64
import hashlib
from collections.abc import Callable, Iterator
from itertools import chain
from operator import itemgetter

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registrum.llm._shared import kept

CHUNK, OVERLAP, LOOK = 32_768, 1_024, 3


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: base64 token and rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class _Known(dict):
    """Pre-token to its ids and the same in decimal, joined by commas; works out what it is asked for. Keeps short pre-tokens from
    the second time that they are met (most are met once), between `keep` and twice that many."""

    def __init__(self, merge: Callable[[str], list[int]], keep: int):
        super().__init__()
        self.merge, self.keep, self.older = merge, keep, {}
        self.met, self.n_met = bytearray(1 << 22), 0

    def __missing__(self, piece: str) -> tuple[tuple[int, ...], str]:
        got = self.older.get(piece)
        if got is None:
            ids = tuple(self.merge(piece))
            got = ids, ",".join(map(str, ids))
            at = hash(piece) & 0x3FFFFF
            if not self.met[at]:
                self.met[at], self.n_met = 1, self.n_met + 1
                if self.n_met > 1 << 21:
                    self.met, self.n_met = bytearray(1 << 22), 0
                return got
        if len(piece) <= 64:
            if len(self) >= self.keep:
                self.older = dict(self)
                self.clear()
            self[piece] = got
        return got


class Codec:
    """Encodes and decodes with one rank file."""

    def __init__(self, path: str, pattern: str, keep: int = 100_000):
        self.ranks = load_ranks(path)
        self.tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.split = regex.compile(pattern)
        # its pattern takes whatever it is given as one pre-token: the library only joins pairs by rank
        merges = tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=self.ranks, special_tokens={})
        self.known = _Known(merges.encode_ordinary, keep)

    def encode_pieces(self, pieces: list[str]) -> list[tuple[tuple[int, ...], str]]:
        """Ids of each pre-token, and the same in decimal, joined by commas."""
        return list(map(self.known.__getitem__, pieces))

    def encode(self, text: str) -> list[int]:
        return self.encode_both(text)[0]

    def encode_both(self, text: str) -> tuple[list[int], str]:
        found = self.encode_pieces(self.split.findall(text))
        return list(chain.from_iterable(map(itemgetter(0), found))), ",".join(map(itemgetter(1), found))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def cuts(self, chunk: str, last: bool) -> list[int]:
        """Where pre-tokens of a chunk begin, and in a text's last chunk its end. A cut is left out where the match before
        it could have been another with more text: contractions look three characters ahead."""
        found = [m.start() for m in self.split.finditer(chunk)]
        if last:
            return [*found, len(chunk)]
        return [c for k, c in enumerate(found) if not k or found[k - 1] <= len(chunk) - LOOK]


def codec_for(path: str, pattern: str) -> Codec:
    """One codec for all tasks of a Python worker."""
    return kept((path, pattern), lambda: Codec(path, pattern))


def _short(path: str, pattern: str, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(path, pattern)
        for batch in batches:
            for part in (batch.slice(at, 512) for at in range(0, batch.num_rows, 512)):
                yield _encoded(codec, part.column("key"), part.column("text").to_pylist(), with_ids)

    return run


def _encoded(codec: Codec, keys: pa.Array, texts: list[str | None], with_ids: bool) -> pa.RecordBatch:
    return _rows(codec, keys, [codec.encode_both(t or "") for t in texts], with_ids)


def _rows(codec: Codec, keys: pa.Array, found: list[tuple[list[int], str]], with_ids: bool) -> pa.RecordBatch:
    decoded = [codec.decode(ids) for ids, _ in found]
    columns = {"key": keys, "n_tokens": pa.array([len(ids) for ids, _ in found], pa.int64())}
    if with_ids:
        columns |= {"ids": pa.array([ids for ids, _ in found], pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.binary())}
    columns |= {
        "ids_sha256": pa.array([hashlib.sha256(digits.encode()).hexdigest() for _, digits in found], pa.string()),
        "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
    }
    return pa.RecordBatch.from_pydict(columns)


def _cut_chunks(path: str, pattern: str, size: int):
    """Cuts and encoded pre-tokens of each chunk; which of the cuts hold for the text is for the stitch to tell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(path, pattern)
        for batch in batches:
            for row in batch.to_pylist():
                text, start = row["text"], row["chunk"] * size
                cuts = codec.cuts(text, row["chunk"] == row["chunks"] - 1)
                ids = [ids for ids, _ in codec.encode_pieces([text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])]
                out = {"key": row["key"], "row_no": row["row_no"], "chunk": row["chunk"], "cuts": [c + start for c in cuts]}
                yield pa.RecordBatch.from_pylist([out | {"sizes": [len(x) for x in ids], "ids": [i for x in ids for i in x], "rest": text[cuts[-1] :]}], schema=_PIECES)

    return run


_PIECES = pa.schema([("key", pa.int64()), ("row_no", pa.int64()), ("chunk", pa.int32()), ("cuts", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("ids", pa.list_(pa.int32())), ("rest", pa.string())])
_PIECES_DDL = "key long, row_no long, chunk int, cuts array<long>, sizes array<int>, ids array<int>, rest string"


def join_chunks(chunks: list[dict]) -> list[int] | None:
    """Ids of the whole text from its chunks in order; None where two neighbours share no cut."""
    out: list[int] = []
    cuts, sizes, ids, at = chunks[0]["cuts"], chunks[0]["sizes"], chunks[0]["ids"], 0
    for nxt in chunks[1:]:
        own = {c: k for k, c in enumerate(nxt["cuts"])}
        meet = next((k for k in range(at, len(cuts)) if cuts[k] in own), None)
        if meet is None:
            return None
        out += ids[sum(sizes[:at]) : sum(sizes[:meet])]
        at = own[cuts[meet]]
        cuts, sizes, ids = nxt["cuts"], nxt["sizes"], nxt["ids"]
    return out + list(ids[sum(sizes[:at]) :])


def _stitched(path: str, pattern: str, size: int, with_ids: bool):
    def run(table: pa.Table) -> pa.Table:
        codec, chunks = codec_for(path, pattern), sorted(table.to_pylist(), key=lambda r: r["chunk"])
        ids = join_chunks(chunks)
        if ids is None:  # a pre-token outgrows the overlap: the text is put together again and split as a whole
            bodies = [codec.decode(c["ids"]).decode() + c["rest"] for c in chunks]
            ids = codec.encode("".join([*(b[:size] for b in bodies[:-1]), bodies[-1]]))
        return pa.Table.from_batches([_rows(codec, pa.array([chunks[0]["key"]], pa.int64()), [(ids, ",".join(map(str, ids)))], with_ids)])

    return run


def bpe_roundtrip(docs: DataFrame, path: str, pattern: str, *, key: str = "doc_id", text: str = "text", size: int = CHUNK, overlap: int = OVERLAP, with_ids: bool = True) -> DataFrame:
    """(key, n_tokens, ids, decoded, ids_sha256, decoded_sha256) of every row of docs: its text encoded by the ranks at
    `path`, pre-tokens by `pattern`, and the bytes that the ids decode to.

    A null text counts as empty: no ids, no bytes. A null key stays null. Repeated rows each give a row. Texts up to `size`
    characters are one chunk; longer ones are cut into chunks of `size` that reach `overlap` into the next, encoded in
    parallel and stitched; where a pre-token outgrows the overlap the text is split again as a whole. An empty table gives an
    empty result. Other columns of docs are ignored, whatever their names.
    """
    rows = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text"))
    extra = "ids array<int>, decoded binary, " if with_ids else ""
    out = f"key long, n_tokens long, {extra}ids_sha256 string, decoded_sha256 string"
    long = F.char_length("text") > size
    short = rows.where(~F.coalesce(long, F.lit(False))).mapInArrow(_short(path, pattern, with_ids), out)
    chunks = (
        rows.where(long)
        .withColumn("row_no", F.monotonically_increasing_id())
        .withColumn("chunks", F.ceil(F.char_length("text") / F.lit(size)).cast("int"))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("key", "row_no", "chunks", "chunk", F.substring("text", F.col("chunk") * size + 1, F.lit(size + overlap)).alias("text"))
    )
    # the chunks are dealt out before they are cut, so that one very long text keeps many tasks busy
    pieces = chunks.repartition("row_no", "chunk").mapInArrow(_cut_chunks(path, pattern, size), _PIECES_DDL)
    stitched = pieces.groupBy("row_no").applyInArrow(_stitched(path, pattern, size, with_ids), out)
    return short.unionByName(stitched).withColumnRenamed("key", key)
