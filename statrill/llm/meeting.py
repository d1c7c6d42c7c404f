"""Which rows share a key, where each row has many keys and most keys are of one row only.

Keys leave their task packed: one row of two byte strings for each bucket of keys and chunk of rows. A bucket sorts its
keys and pairs the rows of each. A key of more than HOT rows is hot: it gives no pairs but one row for each of its rows, which
the caller deals out in cells. A key that is hot within a chunk already is told to its bucket as a mark, and its rows go
to buckets of their own. The more chunks there are, the fewer rows make a key hot within one (`within_chunk`), so that a key
that stays below that in each of them brings MOST rows to its bucket at most, or one for each chunk.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Rows of a key that are paired at most; keys of a bucket, about; numbers of a chunk.
HOT, ENTRIES, CHUNK = 64, 1 << 20, 1 << 16
#: Rows of a key that is hot in no chunk, in all chunks together.
MOST = 1 << 18
PACKED = "bucket long, base long, keys binary, rows binary, marks binary"


def buckets(entries: int) -> int:
    return max(64, -(-entries // ENTRIES))


def within_chunk(rows: int, hot: int = HOT) -> int:
    """Rows of a key beyond which it is hot within a chunk, for so many rows in all."""
    return max(1, min(hot, MOST // (rows // CHUNK + 1)))


def _groups(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and size of the runs of equal values."""
    begin = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, np.int64)
    return begin, np.diff(np.concatenate([begin, [len(sorted_)]]))


def packed(base: int, rows: np.ndarray, key: np.ndarray, indexed: np.ndarray | None, n: int, hot: int = HOT) -> pd.DataFrame:
    """Packed keys (uint64) of rows whose numbers are base + rows, rows below CHUNK; `indexed` tells those of which a
    pair needs one (none given: all). A key is known by its bucket and 31 bits."""
    bucket = (key >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)
    known = bucket << np.uint64(32) | (key & np.uint64(0x7FFFFFFF)) << np.uint64(1)
    entry = known | (np.uint64(1) if indexed is None else indexed.astype(np.uint64))
    order = np.argsort(entry, kind="stable")
    entry, rows = entry[order], rows[order].astype(np.uint16)
    begin, size = _groups(entry >> np.uint64(1))
    many = np.repeat(size > hot, size)
    out = []
    for chosen, own in ((~many, True), (many, False)):
        some, who = entry[chosen], rows[chosen]
        if own:
            marks = entry[begin[size > hot]]
            of, mark = some >> np.uint64(32), marks >> np.uint64(32)
            for b in np.union1d(of, mark):
                s, m = slice(*np.searchsorted(of, [b, b + 1])), slice(*np.searchsorted(mark, [b, b + 1]))
                out.append((int(b), base, some[s].astype(np.uint32).tobytes(), who[s].tobytes(), marks[m].astype(np.uint32).tobytes()))
        elif len(some):
            out.append((-1 - base // CHUNK % n, base, some.tobytes(), who.tobytes(), b""))
    return pd.DataFrame(out, columns=["bucket", "base", "keys", "rows", "marks"])


def met(rows: DataFrame, hot: int = HOT) -> DataFrame:
    """Of packed keys, a stored table of two kinds of rows: a, b (a < b) that share a cold key, key null, perhaps more than
    once; and a of a hot key, b null, indexed."""

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        of_hot = pdf["bucket"].iloc[0] < 0
        entry = np.frombuffer(b"".join(pdf["keys"]), np.uint64 if of_hot else np.uint32).astype(np.uint64)
        count = pdf["rows"].map(len).to_numpy() // 2
        row = np.repeat(pdf["base"].to_numpy(np.int64), count) + np.frombuffer(b"".join(pdf["rows"]), np.uint16)
        if of_hot:
            return members(entry, row)
        order = np.argsort(entry, kind="stable")
        entry, row = entry[order], row[order]
        begin, size = _groups(entry >> np.uint64(1))
        marks = np.frombuffer(b"".join(pdf["marks"]), np.uint32).astype(np.uint64) >> np.uint64(1)
        many = np.repeat((size > hot) | np.isin(entry[begin] >> np.uint64(1), marks), size)
        own = members(entry[many] | np.uint64(pdf["bucket"].iloc[0]) << np.uint64(32), row[many])
        some = np.repeat(size > 1, size) & ~many
        entry, row = entry[some], row[some]
        found, at, step = [], np.arange(len(entry)), 1
        while len(at):
            at = at[at + step < len(entry)]
            at = at[entry[at] >> np.uint64(1) == entry[at + step] >> np.uint64(1)]
            yes = at[((entry[at] | entry[at + step]) & np.uint64(1) == 1) & (row[at] != row[at + step])]
            found.append(np.sort(np.stack([row[yes], row[yes + step]], 1), axis=1))
            step += 1
        pairs = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *found]), axis=0)
        cold = pd.DataFrame({"key": pd.array([None] * len(pairs), dtype="Int64"), "a": pairs[:, 0], "b": pd.array(pairs[:, 1], dtype="Int64"), "indexed": False})
        return pd.concat([own, cold]) if len(own) else cold

    def members(entry: np.ndarray, row: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"key": pd.array((entry >> np.uint64(1)).astype(np.int64), dtype="Int64"), "a": row, "b": pd.array([None] * len(row), dtype="Int64"), "indexed": (entry & np.uint64(1)).astype(bool)})

    return stored(rows.groupBy("bucket").applyInPandas(meet, "key long, a long, b long, indexed boolean"))


def pairs_and_members(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of what met() gives: the distinct pairs a, b, and key, id of the hot keys that can give a pair; stored tables."""
    pairs = stored(found.where("b is not null").select("a", "b").distinct())
    many = found.where("b is null").select("key", F.col("a").alias("id"), "indexed")
    useful = many.groupBy("key").agg(F.max("indexed").alias("any_")).where("any_").select("key")
    return pairs, stored(many.join(useful, "key", "left_semi").select("key", "id").distinct())
