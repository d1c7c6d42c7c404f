"""Byte-level BPE encoding and decoding by recursive DuckDB queries inside each partition.

Each partition loads the merge table into its own in-memory DuckDB. Words that the worker has not met yet become
rows (word, position, token); a recursive query joins neighbouring rows with the merge table and contracts each
word's leftmost pair of least rank until no pair is left. Decoding joins ids with the vocabulary and aggregates
their bytes in order.

Nulls count as empty texts. Empty texts have no tokens; their digests are those of the empty string. Very long texts are
worked on in parts that their own words bound; a single word of more than LONG bytes is merged outside DuckDB. Repeated rows
give repeated results; rows of a null doc_id keep it; an empty table gives an empty one. Columns other than doc_id and text
are not read, and ids never leave the JVM.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, texts
from .pretokens import LONGEST, Memo, fragments, parts, pieces, runs

#: Words at a time in one recursive query, and rows of its recursion, about. Rows grow with the square of a word's length,
#: so a word of more than LONG bytes is merged on a list instead.
WORDS, ROWS, LONG = 20_000, 2_000_000, 1000
#: Fragments of a word that a worker keeps; pieces of other fragments, and as many of their words.
KEPT, APART = 800_000, 300_000

ENCODE = """
with recursive state(k, token, step) as (
  select k, token, 0 from start
  union all (
    with pair as materialized (
      select a.k, a.token, a.step, m.rank
      from state a left join state b on b.k = a.k + 1 left join merges m on m.pair = a.token * 65536::bigint + b.token),
    best as (
      select k >> 10 as word, min((rank::bigint << 32) | k) as least from pair where rank is not null group by 1)
    select k - (k > (least & 4294967295))::int, case when k = (least & 4294967295) then pair.rank else token end, step + 1
    from pair join best on word = k >> 10 where k <> (least & 4294967295) + 1)
), last as (select k >> 10 as word, max(step) as step from state group by 1)
select word, list(token order by state.k) as ids
from state join last on last.word = state.k >> 10 and last.step = state.step group by word order by word"""

#: The bytes of all ids in order, as digits, and how many each id has.
DECODE = "select string_agg(piece, '' order by place), list(length(piece) // 2 order by place) from given join vocabulary using (id)"


class Merges:
    """A vocabulary of ranks, in a DuckDB of its own."""

    def __init__(self, path: str):
        import duckdb

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.byte = [self.ranks[bytes([i])] for i in range(256)]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "250MB"})
        pairs = [(self.ranks[x[:i]] * 65536 + self.ranks[x[i:]], r) for x, r in self.ranks.items() for i in range(1, len(x)) if x[:i] in self.ranks and x[i:] in self.ranks]
        self.load("merges", pd.DataFrame(pairs, columns=["pair", "rank"]))
        self.load("vocabulary", pd.DataFrame({"id": list(self.ranks.values()), "piece": [x.hex() for x in self.ranks]}))

    def load(self, name: str, rows: pd.DataFrame) -> None:
        self.db.register("rows_", rows)
        self.db.execute(f"create or replace table {name} as select * from rows_")
        self.db.unregister("rows_")

    def looped(self, word: bytes) -> list[int]:
        """The same contraction on a linked list with a heap, for very long words."""
        import heapq

        ids, ahead, behind = [self.byte[x] for x in word], list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        span = [word[i : i + 1] for i in range(len(word))]
        heap: list[tuple[int, int, bytes]] = []

        def offer(i: int) -> None:
            if i >= 0 and ahead[i] < len(word) and (r := self.ranks.get(both := span[i] + span[ahead[i]])) is not None:
                heapq.heappush(heap, (r, i, both))

        for i in range(len(word)):
            offer(i)
        while heap:
            r, i, both = heapq.heappop(heap)
            if not span[i] or ahead[i] >= len(word) or span[i] + span[ahead[i]] != both:
                continue
            gone = ahead[i]
            ids[i], span[i], span[gone], ahead[i] = r, both, b"", ahead[gone]
            if ahead[i] < len(word):
                behind[ahead[i]] = i
            offer(i)
            offer(behind[i])
        return [x for x, s in zip(ids, span, strict=True) if s]

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, which is one match of the tokenizer's pattern."""
        raw = [x.encode("utf-8", "surrogatepass") for x in words]
        out: list = [[self.ranks[x]] if x in self.ranks else self.looped(x) if len(x) > LONG else None for x in raw]
        rest = [i for i, x in enumerate(out) if x is None]
        squares = np.cumsum([len(raw[i]) ** 2 // 2 for i in rest])
        at = 0
        while at < len(rest):
            most = int(np.searchsorted(squares, ROWS + (squares[at - 1] if at else 0), side="right"))
            some = rest[at : max(at + 1, min(at + WORDS, most))]
            at += len(some)
            n = np.array([len(raw[i]) for i in some])
            k = np.repeat(np.arange(len(some), dtype=np.int64) * 1024 - np.cumsum(n) + n, n) + np.arange(n.sum())
            self.load("start", pd.DataFrame({"k": k, "token": np.array(self.byte, np.int32)[np.frombuffer(b"".join(raw[i] for i in some), np.uint8)]}))
            for i, (_, ids) in zip(some, self.db.execute(ENCODE).fetchall(), strict=True):
                out[i] = ids
        return out

    def decode(self, lists: list[list[int]]) -> list[bytes]:
        """The bytes of each list of ids."""
        out = [b""] * len(lists)
        sizes = np.array([len(x) for x in lists])
        begins = np.flatnonzero(np.diff(np.cumsum(sizes) // (8 * WORDS), prepend=-1)) if lists else ()
        for at, to in zip(begins, [*begins[1:], len(lists)][: len(begins)], strict=True):
            some = [i for i in range(at, to) if sizes[i]]
            if some:
                ids = np.fromiter(chain.from_iterable(lists[at:to]), np.int32)
                self.db.register("given", pa.table({"id": ids, "place": np.arange(len(ids), dtype=np.int32)}))
                digits, each = self.db.execute(DECODE).fetchall()[0]
                held, ends, begin = bytes.fromhex(digits), np.cumsum(each)[np.cumsum(sizes[some]) - 1].tolist(), 0
                for i, end in zip(some, ends, strict=True):
                    out[i], begin = held[begin:end], end
        return out


@cache
def coder(path: str, pattern: str) -> tuple[Merges, Memo, Memo]:
    """One for each worker; fragments of a word, and pieces of others, give their ids as text and the bytes that these ids
    decode to."""
    import regex

    merges, matches = Merges(path), regex.compile(pattern).findall

    def of_words(words: list[str]) -> list[tuple[str, bytes]]:
        ids = merges.encode(words)
        return list(zip([" ".join(map(str, x)) for x in ids], merges.decode(ids), strict=True))

    known = Memo(of_words, APART)

    def of_fragments(new: list[str]) -> list[tuple[str, bytes]]:
        """Most are a word each and are kept as such."""
        lists = [matches(x) for x in new]
        words = list({x for xs in lists for x in xs})
        of = dict(zip(words, of_words(words), strict=True))
        return [together([of[x] for x in xs]) for xs in lists]

    def of_pieces(new: list[str]) -> list[tuple[str, bytes]]:
        return [together(x) for x in known.of([matches(p) for p in new])]

    return merges, Memo(of_fragments, KEPT), Memo(of_pieces, APART)


def together(values: list[tuple[str, bytes]]) -> tuple[str, bytes]:
    return values[0] if len(values) == 1 else (" ".join([a for a, _ in values]), b"".join([b for _, b in values]))


def looked_up(found: list[str], memo: Memo, apart: Memo) -> list[tuple[str, bytes]]:
    """What each of these distinct fragments gives; those that are long or of several words by their pieces."""
    split = [len(x) > LONGEST or x.rfind(" ") > 0 for x in found]
    short = iter(memo.distinct([x for x, y in zip(found, split, strict=True) if not y]))
    long = (together(x) for some in runs([x for x, y in zip(found, split, strict=True) if y]) for x in apart.of([pieces(x) for x in some]))
    return [next(long) if y else next(short) for y in split]


def encoded(docs: pa.Array, memo: Memo, apart: Memo) -> Iterator[tuple[str, bytes]]:
    """The ids of each text, as text, and the bytes that they decode to."""
    for part in parts(docs):
        found, at, upto = fragments(part, [])
        values = looked_up(found, memo, apart)
        ids, held = np.array([a for a, _ in values], object), np.array([b for _, b in values], object)
        begin = 0
        for end in upto.tolist():
            some = at[begin:end]
            yield " ".join(ids[some].tolist()), b"".join(held[some].tolist())
            begin = end


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int>: the ids of each whole text."""

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memos = coder(path, pattern)[1:]
        for batch in batches:
            yield pa.array([[int(i) for i in a.split()] for a, _ in encoded(batch, *memos)], pa.list_(pa.int32()))

    return texts(docs).select("doc_id", ids("text").alias("ids"))


def decode(ids: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, bytes binary of tables with doc_id, ids array<int>; null ids count as none."""

    @F.pandas_udf("binary")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        merges = coder(path, pattern)[0]
        for batch in batches:
            yield pd.Series(merges.decode([[] if x is None else [int(i) for i in x] for x in batch]), dtype=object)

    return ids.select("doc_id", decoded("ids").alias("bytes"))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, sha256 of the ids and of the bytes they decode to, without keeping a text's ids as a list."""

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memos = coder(path, pattern)[1:]
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for ids, held in encoded(batch, *memos):
                counts.append(ids.count(" ") + bool(ids))
                of_ids.append(hashlib.sha256(ids.encode()).hexdigest())
                of_bytes.append(hashlib.sha256(held).hexdigest())
            yield pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).select("doc_id", digest("text").alias("digest")).select("doc_id", "digest.*")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
