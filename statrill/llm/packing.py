"""Packing tokenised documents into sequences: large-item matching, then best fit.

Documents (ids, then the end id) longer than a sequence are cut from their end, so that only the first piece may be
shorter. Full pieces are sequences of their own. For the others a plan is made from nothing but how many pieces there
are of each length (at most `capacity` numbers): pieces above a third of the capacity, of which at most two fit into a
sequence, are matched greedily, longest first, each with the longest partner that still fits; then the smaller ones,
longest first, go where the least room that holds them is left. The plan says, for each length, which pieces by their
number among those of that length go to which sequences; the pieces are numbered and placed by Spark.

Null texts count as empty; an empty text is a document of the end id alone. A special token's string in a text is that
token, as the library has it; such a text goes to the library whole. Repeated rows are packed each. An empty table gives an
empty one. Very long texts are many pieces, tokenised whole. Ties between pieces of one length fall as they were stored. Other
columns are not read, and ids of documents never leave the JVM.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table, texts
from .pretokens import Memo, fragments, parts

CAPACITY, END = 2048, 0
#: Numbering: rows in one window at most, about; and most windows for each length.
NUMBERED, SHARES = 500_000, 4096
#: Fragments of text that go to the tokenizer as one input, that a worker keeps, and whose ids are laid out at a time.
TOGETHER, KEPT, GATHERED = 200, 300_000, 1 << 20


@cache
def coder(path: str) -> tuple[Memo, list[str]]:
    """The ids of fragments, as bytes, and the strings that are tokens of their own wherever they stand."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    size = np.array([len(tokenizer.id_to_token(i)) for i in range(tokenizer.get_vocab_size())])  # a character a byte
    special = [x.content for x in tokenizer.get_added_tokens_decoder().values()]

    def fill(new: list[str]) -> list[bytes]:
        """A few hundred fragments are one input: that costs less than as many inputs. Those that begin with a space and end
        visibly are one text, as matches end before that space; others are split beforehand. How many ids a fragment has
        follows from the bytes that each id stands for."""
        joins = [x[0] == " " and not x[-1].isspace() and not any(y in x for y in special) for x in new]
        out = {}
        for joined in (True, False):
            some = [x for x, y in zip(new, joins, strict=True) if y == joined]
            for i in range(0, len(some), TOGETHER):
                group = some[i : i + TOGETHER]
                (got,) = tokenizer.encode_batch_fast(["".join(group) if joined else group], is_pretokenized=not joined, add_special_tokens=False)
                ids = np.array(got.ids, "<u4")
                ends = np.cumsum([len(x.encode("utf-8", "surrogatepass")) for x in group])
                ends = (4 * np.searchsorted(np.cumsum(size[ids]), ends, side="left") + 4).tolist()
                out.update(zip(group, map(ids.tobytes().__getitem__, map(slice, [0, *ends], ends)), strict=True))
        return [out[x] for x in new]

    return Memo(fill, KEPT), special


def tokenised(docs: pa.Array, memo: Memo, special: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts one after the other, the end id after each, and where each text's ids end."""
    found, at, upto = fragments(docs, special)
    held = [*memo.distinct(found), np.array([end], "<u4").tobytes()]
    size = np.fromiter(map(len, held), np.int64, len(held)) // 4
    begin, flat = np.cumsum(size) - size, np.frombuffer(b"".join(held), "<u4")
    at = np.insert(at, upto, len(found))
    ends = np.cumsum(size[at])
    ids = np.empty(ends[-1], "<u4")
    for i in range(0, len(at), GATHERED):
        some, to = at[i : i + GATHERED], ends[i : i + GATHERED]
        first = to[0] - size[some[0]]
        ids[first : to[-1]] = flat[np.arange(first, to[-1]) + np.repeat(begin[some] - to + size[some], size[some])]
    return ids, ends[upto + np.arange(len(upto))]


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = True) -> DataFrame:
    """Pieces: doc_id, piece, start, length, ids_crc32, and ids (binary, little-endian unsigned 32-bit) if asked for."""

    @F.arrow_udf(f"array<struct<start: long, length: long, ids_crc32: long{', ids: binary' * keep_ids}>>")
    def cuts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo, special = coder(path)
        for batch in batches:
            starts, lengths, sums, kept, upto = [], [], [], [], [0]
            for part in parts(batch):
                ids, ends = tokenised(part, memo, special, end)
                begin = 0
                for stop in ends.tolist():
                    n = stop - begin
                    for to in range((n - 1) % capacity + 1, n + 1, capacity):
                        starts.append(max(0, to - capacity))
                        lengths.append(to - starts[-1])
                        piece = ids[begin + starts[-1] : begin + to].tobytes()
                        sums.append(zlib.crc32(piece))
                        if keep_ids:
                            kept.append(piece)
                    begin = stop
                    upto.append(len(starts))
            columns = {"start": pa.array(starts, pa.int64()), "length": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(sums, pa.int64())}
            columns |= {"ids": pa.array(kept, pa.binary())} if keep_ids else {}
            yield pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.StructArray.from_arrays(list(columns.values()), list(columns)))

    return texts(docs).select("doc_id", F.posexplode(cuts("text")).alias("piece", "cut")).select("doc_id", "piece", "cut.*")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first number, pieces a sequence, first sequence, offset there) that place every piece."""
    out, done, opened = [], dict.fromkeys(counts, 0), 0
    room: dict[int, list[tuple[int, int]]] = {}

    def put(length: int, each: int, first: int, n: int, gap: int) -> int:
        """n sequences from the first, each with so much room, take so many pieces each; the room left is returned."""
        out.append((length, done[length], each, first, capacity - gap))
        done[length] += each * n
        return gap - each * length

    def leave(gap: int, first: int, n: int) -> None:
        if n and gap:
            room.setdefault(gap, []).append((first, n))

    left = {x: n for x, n in counts.items() if n}
    large = sorted((x for x in left if 3 * x > capacity), reverse=True)
    for a in large:
        while left[a]:
            b = next((b for b in large if b <= min(a, capacity - a) and left[b] > (b == a)), None)
            n = left[a] if b is None else left[a] // 2 if a == b else min(left[a], left[b])
            gap = put(a, 1 + (a == b), opened, n, capacity)
            left[a] -= n * (1 + (a == b))
            if b is not None and b != a:
                gap = put(b, 1, opened, n, gap)
                left[b] -= n
            leave(gap, opened, n)
            opened += n
    for s in sorted((x for x in left if left[x]), reverse=True):
        while left[s]:
            gap = min((g for g in room if g >= s), default=capacity)
            if gap == capacity:
                first, n = opened, -(-left[s] // (capacity // s))
                opened += n
            else:
                first, n = room[gap].pop()
                if not room[gap]:
                    del room[gap]
            each = gap // s
            full = min(n, left[s] // each)
            if full:
                leave(put(s, each, first, full, gap), first, full)
            left[s] -= full * each
            if full < n:
                if left[s]:
                    leave(put(s, left[s], first + full, 1, gap), first + full, 1)
                    left[s], full = 0, full + 1
                leave(gap, first + full, n - full)
    return out


def pack(cuts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (a stored table with their length); full pieces get negative numbers."""
    short = cuts.where(F.col("length") < capacity)
    counts = {r["length"]: r["count"] for r in short.groupBy("length").count().collect()}  # at most `capacity` rows
    share = max(16, min(SHARES, -(-sum(counts.values()) // NUMBERED)))
    runs_ = sorted(plan(counts, capacity))
    key = np.array([x[0] << 44 | x[1] for x in runs_], dtype=np.int64)
    each, first, offset = (np.array([x[i] for x in runs_], dtype=np.int64) for i in (2, 3, 4))

    short = short.withColumn("share_", F.pmod("row_", F.lit(share)))
    before = short.groupBy("length", "share_").count().select("length", "share_", (F.sum("count").over(Window.partitionBy("length").orderBy("share_")) - F.col("count")).alias("before_"))
    numbered = short.withColumn("n_", F.row_number().over(Window.partitionBy("length", "share_").orderBy("row_"))).join(before, ["length", "share_"]).withColumn("number_", F.col("before_") + F.col("n_") - 1)

    @F.pandas_udf("sequence_id long, offset long")
    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for lengths, numbers in batches:
            length, number = lengths.to_numpy(), numbers.to_numpy()
            at = np.searchsorted(key, length << 44 | number, side="right") - 1
            i = number - (key[at] & ((1 << 44) - 1))
            yield pd.DataFrame({"sequence_id": first[at] + i // each[at], "offset": offset[at] + i % each[at] * length})

    names = [c for c in cuts.columns if c != "row_"]
    placed = numbered.select(*names, place("length", "number_").alias("at_")).select(*names, "at_.*")
    return placed.unionByName(cuts.where(F.col("length") == capacity).select(*names, (-1 - F.col("row_")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence_id and offset; with its ids, if asked for."""
    return pack(stored(cut(docs, path, capacity, end, keep_ids).withColumn("row_", F.monotonically_increasing_id())), capacity)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
