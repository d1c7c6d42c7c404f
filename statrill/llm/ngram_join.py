"""Exact Jaccard join on word n-grams by partitioning the universe of tokens.

Sets are cut into bands of size, so that two sets that link lie in one band or in neighbouring ones. In a band a hash
deals the tokens into segments of two kinds. Those of the first kind are indexed whole and with each one of their tokens
left out, which forgives 1 difference. Of the second kind a subset is indexed, whole: the fullest segments of the set.
Linked sets differ in at most H tokens. If D segments of the first kind all differ in 2 tokens or more, H - 2 D
differences are left for the W of the second kind, so W - (H - 2 D) of these are equal; two sets of W keys that have so
many in common agree in one of their H - 2 D + 1 first keys under any order of keys, here the fullest segments first.
Thus empty and nearly empty segments, which bring unrelated documents together, are left out without losing a link. D and W are
the cheapest choice for each band, by the number of keys and of pairs that are expected to meet in vain.

A set has the keys of its own band and of the next. Nodes of a key are tied to its least one, first within the chunk of
documents at hand, so that a key is shuffled once for a chunk, then over all; components of these ties hold all links. What
chance ties bring into large groups, other segments part again: sets of such a group are keyed anew within it, in ROUNDS - 1
rounds. Within a group, in blocks bounded by sets and by tokens, intersections are counted exactly, as products of incidence
matrices, and each block pair keeps a spanning forest of its links.

Only one document of each set is compared. Nulls and texts without words have an empty set, which links with nothing: such a
document is its own component. Repeated rows of a doc_id are one document of several texts: links of either count. Null
doc_ids are kept, without a component. An empty table gives an empty one; very long texts are read whole. Of equal sets the
least doc_id stands for all. Other columns are not read, and ids of documents never leave the JVM but within groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import passing, stored, table, texts
from .links import BLOCK, cells, components, small

#: Links: 100 * intersection >= PERCENT * union of sets of N-word shingles.
N, PERCENT = 3, 90
#: Of the cost model: cost of a pair that meets in vain, in keys; the share of unrelated documents that hold a given token;
#: related documents of each, and the share of tokens that they have in common.
PAIR_COST, SHARED, RELATED, OVERLAP = 5, 1e-3, 30.0, 0.7
#: Universe partitions; groups of more than BLOCK sets are dealt out anew by all but the first.
ROUNDS = 2
#: Keys that are tied at once within a task.
CHUNK = 1 << 21
U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input changes about half of the bits of the result."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


class Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, as far as they are needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << n.bit_length()
            with np.errstate(over="ignore"):
                self.up = np.concatenate([np.ones(1, U), np.cumprod(np.full(size - 1, _BASE, U), dtype=U)])
                self.down = np.concatenate([np.ones(1, U), np.cumprod(np.full(size - 1, U(pow(int(_BASE), -1, 1 << 64)), U), dtype=U)])
        return self.up, self.down


@cache
def powers() -> Powers:
    return Powers()


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased: words are what stands between characters 0x20 and 0x09-0x0D."""
    raw = _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    inside = np.concatenate([[False], ~_BLANK[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    up, down = powers().of(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, U), np.cumsum((raw.astype(U) + U(1)) * up[: len(raw)], dtype=U)])
        return mixed((total[end] - total[start]) * down[start] + (end - start).astype(U) * _BASE)


def shingles(text: str, n: int = N) -> np.ndarray:
    """The sorted set of hashes of n words in a row; with fewer words, of all of them; of nothing, none."""
    words = word_hashes(text)
    if not len(words):
        return words
    k = min(n, len(words))
    with np.errstate(over="ignore"):
        out = np.full(len(words) - k + 1, U(k))
        for i in range(k):
            out = mixed(out * _BASE + words[i : len(words) - k + 1 + i])
    return np.unique(out)


def bands(percent: int, largest: int) -> list[int]:
    """Least sizes of the bands up to one beyond the largest size: linked sets are in one band or in neighbours."""
    out = [1]
    while out[-1] <= largest:
        out.append(max(out[-1] + 1, -(-out[-1] * 100 // percent)))
    return [*out, max(out[-1] + 1, -(-out[-1] * 100 // percent))]


def differences(a: int, b: int, percent: int) -> int:
    """The most tokens in which linked sets of these sizes differ."""
    return (a + b) * (100 - percent) // (100 + percent)


@cache
def allocation(top: int, percent: int, documents: int, related: float = RELATED) -> tuple[int, int]:
    """Segments indexed with deletions, and segments of which the fullest are indexed, for a band of sizes up to top: the
    least number of keys and of pairs in vain, a pair counting as PAIR_COST keys. Unrelated documents meet in segments that
    are nearly empty; related ones, which share OVERLAP of their tokens without linking, meet by sharing all of a segment,
    or all but one token where that is forgiven. Full segments, of which deletions need fewer, keep them apart."""
    most = differences(top, top, percent)
    best = None
    for deleting in sorted({*range(min(17, (most + 3) // 2)), *((most + 1) * i // 64 for i in range(33))}):
        kept = max(0, most - 2 * deleting + 1)
        for whole in sorted({min(kept * i // 20, max(kept, top)) for i in range(20, 41)}):
            m = deleting + whole
            if not m:
                continue
            tokens, at_most = top / m, 0.0
            alike = math.exp(-tokens)
            near = related * OVERLAP ** max(0.0, tokens - 1) * (OVERLAP + tokens * (1 - OVERLAP))
            far = documents * (1 + tokens) * math.exp(-tokens * (1 - SHARED))
            cost = deleting * (1 + tokens + PAIR_COST * (near + far)) + kept * (1 + PAIR_COST * related * OVERLAP**tokens)
            for k in range(4 if kept else 0):
                at_most += alike
                cost += PAIR_COST * documents * SHARED**k * whole * min(alike, max(0.0, at_most - (1 - kept / whole)))
                alike *= tokens / (k + 1)
            if best is None or cost < best[0]:
                best = (cost, deleting, whole)
    return best[1], best[2]


def band_keys(tokens: np.ndarray, band: int, top: int, percent: int, documents: int, seed: int = 0) -> np.ndarray:
    """Keys of a set in a band of sizes up to top; the seed deals tokens to segments."""
    deleting, whole = allocation(top, percent, documents)
    kept, m = max(0, differences(len(tokens), top, percent) - 2 * deleting + 1), deleting + whole
    with np.errstate(over="ignore"):
        segment = (mixed(tokens + U(band + (seed << 32)) * _BASE) >> U(33)).astype(np.int64) % m
        order = np.argsort(segment, kind="stable")
        segment, value = segment[order], mixed(tokens[order] ^ U(0xD6E8FEB86659FD93))
        total = np.concatenate([np.zeros(1, U), np.cumsum(value, dtype=U)])
        bounds = np.searchsorted(segment, np.arange(m + 1))
        sums = total[bounds[1:]] - total[bounds[:-1]]
        some = segment < deleting
        place = np.concatenate([np.arange(m), segment[some]])
        out = np.concatenate([sums, sums[segment[some]] - value[some]])
        out = mixed(mixed(out) + place.astype(U) * _BASE + mixed(np.full(1, band, U)))
        if kept < whole:
            fullest = np.lexsort((out[deleting:m], -np.diff(bounds)[deleting:]))[:kept]
            out = np.concatenate([out[:deleting], out[deleting:m][fullest], out[m:]])
        return out


def sets(docs: DataFrame, n: int = N) -> DataFrame:
    """doc_id, n_shingles, low, high (128 bits of the set; 0 for an empty one)."""

    @F.pandas_udf("n_shingles long, low long, high long")
    def signed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(len(x), *(_sums(x) if len(x) else (0, 0))) for x in (shingles(text, n) for text in batch)]
            yield pd.DataFrame(rows, columns=["n_shingles", "low", "high"], dtype="int64")

    return texts(docs).select("doc_id", signed("text").alias("set")).select("doc_id", "set.*")


def _sums(x: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return tuple(int(np.add.reduce(mixed(x ^ s)).view(np.int64)) for s in (U(11), U(0xA5A5A5A5A5A5A5A5)))


def node(low: str) -> Column:
    """62 bits of a set's hash: what stands for the set while candidates are sought."""
    return F.shiftrightunsigned(low, 2)


def tied(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer keys that tie the same nodes: each key keeps its least node, and the rest share a key made of that node."""
    order = np.lexsort((value, key))
    k, v = key[order], value[order]
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    least = np.repeat(v[starts], np.diff(np.concatenate([starts, [len(k)]])))
    pairs = np.unique(np.stack([least, v], 1)[least != v], axis=0)
    kept = np.sort(order[starts])
    own = np.unique(pairs[:, 0])
    made = mixed(np.concatenate([own, pairs[:, 0]]).view(U) ^ U(0x5851F42D4C957F2D)).view(np.int64)
    return np.concatenate([key[kept], made]), np.concatenate([value[kept], own, pairs[:, 1]])


def keys(held: DataFrame, documents: int, n: int = N, percent: int = PERCENT, seed: int = 0) -> DataFrame:
    """key, value of texts (text, group_): the nodes to be tied, within their groups; tied nodes of a chunk have one row for
    each key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts, found, value, held, seen = np.array(bands(percent, 1 << 12)), [], [], 0, set()
        for batch in batches:
            for text, group in zip(batch["text"], batch["group_"], strict=True):
                x = shingles(text, n)
                if len(x) >= starts[-2]:
                    starts = np.array(bands(percent, 2 * len(x)))
                if not len(x):
                    continue
                node = (_sums(x)[0] & (1 << 64) - 1) >> 2
                if node in seen:
                    continue
                seen.add(node)
                band = int(np.searchsorted(starts, len(x), side="right")) - 1
                for b in (band, band + 1):
                    got = band_keys(x, b, int(starts[b + 1]) - 1, percent, documents, seed).view(np.int64) ^ group
                    found.append(got)
                    value.append(np.full(len(got), node))
                    held += len(got)
                if held >= CHUNK:
                    yield pd.DataFrame(dict(zip(("key", "value"), tied(np.concatenate(found), np.concatenate(value)), strict=True)))
                    found, value, held, seen = [], [], 0, set()
        if held:
            yield pd.DataFrame(dict(zip(("key", "value"), tied(np.concatenate(found), np.concatenate(value)), strict=True)))

    return held.select("text", "group_").mapInPandas(run, "key long, value long")


def forest(n: int, pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """(member, root) of the components of pairs, for members that are not roots."""
    up = list(range(n))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [(i, root(i)) for i in range(n) if root(i) != i]


def linked(sets: list[np.ndarray], percent: int, columns: int = 8192) -> np.ndarray:
    """Which two of the sets link, as a matrix: intersections are counted over the tokens that two sets or more have."""
    size = np.array([len(x) for x in sets])
    tokens, where, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(sets)), size)
    shared = often[where] > 1
    rows, where = rows[shared], (np.cumsum(often > 1) - 1)[where[shared]]
    order = np.argsort(where, kind="stable")
    rows, where = rows[order], where[order]
    both = np.zeros((len(sets), len(sets)), np.float64)
    for at in range(0, int(where[-1]) + 1 if len(where) else 0, columns):
        a, b = np.searchsorted(where, [at, at + columns])
        incidence = np.zeros((len(sets), columns), np.float32)
        incidence[rows[a:b], where[a:b] - at] = 1
        both += incidence @ incidence.T
    return 100 * both >= percent * (size[:, None] + size[None, :] - both)


def tied_groups(held: DataFrame, documents: int, n: int, percent: int, seed: int) -> DataFrame:
    """node, group_ of texts (text, group_): the components of the ties of their keys, of two nodes or more."""
    found = keys(held, documents, n, percent, seed)
    ties = found.select(F.col("value").alias("a"), F.min("value").over(Window.partitionBy("key")).alias("b")).where("a <> b").distinct()
    return components(ties).toDF("node", "group_")


def with_text(docs: DataFrame, some: DataFrame) -> DataFrame:
    """Rows of a stored table of narrow rows, by id, with the text of their document."""
    return texts(docs).withColumnRenamed("doc_id", "id").join(small(some), "id")


def candidate_groups(docs: DataFrame, first: DataFrame, n: int, percent: int) -> DataFrame:
    """id, n_shingles, group_ of the sets (id, n_shingles, low) that may link with another: links stay within a group."""
    documents = max(1, first.count())
    held = texts(docs).where("doc_id is not null").select("text", F.lit(0).cast("long").alias("group_"))
    of_set = first.select("id", "n_shingles", node("low").alias("node"))
    groups = stored(of_set.join(tied_groups(held, documents, n, percent, 0), "node"))
    sets = None
    for seed in range(1, ROUNDS):
        large = stored(groups.groupBy("group_").agg(F.count(F.lit(1)).alias("sets")).where(F.col("sets") > BLOCK))
        before, sets = sets, large.agg(F.sum("sets")).first()[0]
        if sets in (None, before):
            break
        again = stored(groups.join(small(large.select("group_")), "group_"))
        parted = tied_groups(with_text(docs, again.select("id", "group_")), documents, n, percent, seed)
        groups = stored(groups.join(small(large.select("group_")), "group_", "left_anti").unionByName(again.drop("group_").join(parted, "node")))
    return groups.select("id", "n_shingles", "group_")


def link_forest(docs: DataFrame, grouped: DataFrame, n: int, percent: int) -> DataFrame:
    """Links a, b that join what links within each group (id, n_shingles, group_): a spanning forest for every two blocks."""
    dealt = stored(cells(grouped, "group_", weight="n_shingles").groupBy("id", "group_").agg(F.collect_list("cell_").alias("cells_")))

    @F.pandas_udf("binary")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([shingles(t, n).tobytes() for t in batch], dtype=object)

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        pdf = pdf[pdf["tokens"].map(len) > 0]
        if len(pdf) < 2:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        ids, yes = pdf["id"].to_numpy(), linked([np.frombuffer(x, U) for x in pdf["tokens"]], percent)
        pairs = forest(len(ids), zip(*(x.tolist() for x in np.nonzero(np.triu(yes, 1))), strict=True))
        return pd.DataFrame([(ids[i], ids[j]) for i, j in pairs], columns=["a", "b"], dtype="int64")

    held = with_text(docs, dealt).select("id", "group_", "cells_", tokens("text").alias("tokens"))
    return held.select("id", "group_", F.explode("cells_").alias("cell_"), "tokens").groupBy("group_", "cell_").applyInPandas(within, "a long, b long")


def jaccard_components(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach) of every row."""
    with passing(docs.sparkSession):
        signed = stored(sets(docs, n), after=True)
        ends = stored(_components(docs, signed, n, percent).withColumnRenamed("id", "doc_id"), after=True)
    return signed.select("doc_id", "n_shingles").join(small(ends), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _components(docs: DataFrame, signed: DataFrame, n: int, percent: int) -> DataFrame:
    """id, component of the documents that a link reaches."""
    full = signed.where("n_shingles > 0 and doc_id is not null")
    first = stored(full.groupBy("low", "high", "n_shingles").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")))
    found = link_forest(docs, candidate_groups(docs, first, n, percent), n, percent)
    many = small(stored(first.where("copies > 1").drop("copies")))
    copies = full.select("doc_id", "low", "high", "n_shingles").join(many, ["low", "high", "n_shingles"]).where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    return components(found.union(copies))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


ORACLE_SQL = {
    "op4_ngram_join": rf"""
    with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
    shingles as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < {N} then [array_to_string(w, ' ')] else [array_to_string(w[i : i + {N - 1}], ' ') for i in range(1, len(w) - {N} + 2)] end) as s from words),
    sizes as (select doc_id, count(*) as n from shingles group by 1),
    shared as (select a.doc_id as x, b.doc_id as y, count(*) as n from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
    links as (select x, y from shared join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * shared.n >= {PERCENT} * (p.n + q.n - shared.n)),
    reached as (select x, y from links union select r.x, l.y from reached r join links l on l.x = r.y)
    select d.doc_id, coalesce(max(n), 0) as n_shingles, least(d.doc_id, coalesce(min(y), d.doc_id)) as component_id
    from documents d left join sizes s on s.doc_id = d.doc_id left join reached r on r.x = d.doc_id group by d.doc_id"""
}
