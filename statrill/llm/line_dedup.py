"""Line deduplication by a segment-partition edit join.

Two lines are near if few insertions, deletions or replacements of a character turn one into the other: as many as the
budget of the shorter one, which is 1, and 1 more for each `per` characters, up to `edits`. A line of budget e is cut into
e + 1 segments; one of them survives in any near line that is as long or longer, at a place that the two lengths confine.
So each distinct line is indexed by its segments and probes the index of every length from its own less `edits` up to its
own with the substrings at those places. Lines that meet in a key are verified with a banded edit distance that keeps the
band of each error count in the bits of a byte, for many pairs side by side. Keys of more than HOT lines are not paired:
their lines are dealt out in blocks, compared block by block after a bound by character counts, and give a spanning forest
of their links and the number of links of each line. A pair that shares several hot keys is counted in the cell of the
least of them, once, and not as a pair of a cold key.

Components of near lines are classes, named by the least hash of a line in them. Of each class the first line stays, by
doc_id (a null first), then by document, then by place; the others go. Lines shorter than `least` characters are near only
if they are equal; blank ones are not compared and stay. Null texts count as empty: one blank line. Rows equal in doc_id and
text are one document. An empty table gives an empty one. Very long texts and lines are read whole; the work grows with
their length. Other columns are kept as they are, whatever their names.

Lines and rows are known by 128 bits of a hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, passing, stored, table
from .links import cells, components, small
from .meeting import CHUNK, HOT, PACKED, buckets, met, packed, pairs_and_members, within_chunk
from .ngram_join import forest, jaccard_components, mixed, powers, shingles

EDITS, PER, LEAST = 3, 25, 20
_KEY = np.uint64(0x9E3779B97F4A7C15)
#: Characters of lines whose keys are made at once.
AT_ONCE = 1 << 20


def budget(length: np.ndarray, edits: int = EDITS, per: int = PER) -> np.ndarray:
    """Edits that a line so long may be away from a longer one."""
    return np.minimum(edits, 1 + length // per)


def digest(*parts: Column) -> Column:
    """128 bits that stand for a line or a row."""
    return F.unhex(F.md5(F.concat_ws("\n", *parts)))


def row_key() -> Column:
    return digest(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))


def lines(docs: DataFrame, *more: str | Column) -> DataFrame:
    """row_, more, place (from 0), line of every line that is not blank."""
    each = docs.select(row_key().alias("row_"), *more, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("place", "line"))
    return each.where(F.col("line").rlike(r"\S"))


def _segment(length: np.ndarray, i: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Place (from 0) and length of segment i of a line so long: the last ones are a character longer if need be."""
    each, short = length // (edits + 1), edits + 1 - length % (edits + 1)
    return each * i + np.maximum(0, i - short), each + (i >= short)


def keys(lines: list[str], edits: int = EDITS, per: int = PER) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Rows, keys, indexed: those that index a line, and the others with which it probes the index of lines at most as long
    (besides its own). Substrings are hashed as differences of the running sums of a polynomial."""
    length = np.array([len(x) for x in lines], np.int64)
    chars = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    up, down = powers().of(len(chars) + 1)
    first = np.cumsum(length) - length
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(chars + _KEY) * up[: len(chars)], dtype=np.uint64)])
        for e in range(1, edits + 1):
            for shorter in range(e + 1):
                near = np.flatnonzero((length >= shorter) & (budget(length - shorter, edits, per) == e))
                for i in range(e + 1) if len(near) else ():
                    start, size = _segment(length[near] - shorter, i, e)
                    about = mixed((length[near] - shorter).astype(np.uint64) * _KEY + np.uint64(i))
                    for shift in range(max(-i, shorter - e + i), min(i, shorter + e - i) + 1):
                        fits = np.flatnonzero((start + shift >= 0) & (start + shift + size <= length[near]))
                        at = near[fits]
                        begin = first[at] + start[fits] + shift
                        value = (sums[begin + size[fits]] - sums[begin]) * down[begin]
                        yield at, mixed(value + about[fits]), shorter == shift == 0


def keyed(distinct: DataFrame, n: int, edits: int, per: int, hot: int) -> DataFrame:
    """Packed keys of distinct lines (id, line), whose ids count up within a file."""

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, list[str]]]:
        """Ids and lines of neighbouring ids, of about so many characters."""
        for batch in batches:
            ids, some = batch["id"].to_numpy(), batch["line"].tolist()
            sums = np.cumsum([len(x) for x in some])
            at = 0
            while at < len(some):
                to = max(at + 1, int(np.searchsorted(sums, AT_ONCE + (sums[at - 1] if at else 0), side="right")))
                far = np.flatnonzero((ids[at:to] < ids[at]) | (ids[at:to] >= ids[at] + CHUNK))
                to = at + int(far[0]) if len(far) else to
                yield ids[at:to], some[at:to]
                at = to

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        base, size = 0, 0

        def flush() -> Iterator[pd.DataFrame]:
            if held:
                yield packed(base, *(np.concatenate([x[i] for x in held]) for i in range(3)), n, hot)
                held.clear()

        for ids, some in chunks(batches):
            if size >= 1 << 20 or held and not base <= ids[0] <= ids[-1] < base + CHUNK:
                yield from flush()
                size = 0
            if not held:
                base = int(ids[0])
            for at, key, indexed in keys(some, edits, per):
                held.append((ids[at] - base, key, np.full(len(at), indexed)))
                size += len(at)
        yield from flush()

    return distinct.select("id", "line").mapInPandas(run, PACKED)


def near(first: list[str], second: list[str], edits: int) -> np.ndarray:
    """Which pairs are within so many edits. For each number of errors, bit k of a byte says that so many errors match
    the first j characters of the longer line with the first j + k - edits of the shorter one."""
    if edits > 3:
        raise ValueError("a byte holds the band of 3 edits at most")
    short, long = zip(*((a, b) if len(a) <= len(b) else (b, a) for a, b in zip(first, second, strict=True)), strict=True) if first else ((), ())
    out = np.zeros(len(short), bool)
    size = np.array([len(x) for x in long], int)
    gap = size - np.array([len(x) for x in short], int)
    out[size <= edits] = True
    order = np.argsort(size, kind="stable")
    order = order[(size[order] > edits) & (gap[order] <= edits)]
    at = 0
    while at < len(order):
        n = max(1, min(4096, 4_000_000 // max(1, size[order[min(len(order) - 1, at + 4095)]])))
        some, at = order[at : at + n], at + n
        most = size[some[-1]]
        text = np.full((len(some), most), 0xFFFFFFFE, np.uint32)
        pattern = np.full((len(some), most + 2 * edits + 1), 0xFFFFFFFF, np.uint32)
        for row, i in enumerate(some):
            text[row, : size[i]] = np.frombuffer(long[i].encode("utf-32-le", "surrogatepass"), np.uint32)
            pattern[row, edits : edits + len(short[i])] = np.frombuffer(short[i].encode("utf-32-le", "surrogatepass"), np.uint32)
        text, pattern = np.ascontiguousarray(text.T), np.ascontiguousarray(pattern.T)
        state = [np.full(len(some), sum(1 << edits + x for x in range(d + 1)), np.uint8) for d in range(edits + 1)]
        mask, lane = np.uint8((1 << 2 * edits + 1) - 1), np.arange(len(some))
        ends, want = size[some], edits - gap[some]
        for j in range(most):
            same = np.zeros(len(lane), np.uint8)
            for k in range(2 * edits + 1):
                same |= (pattern[j + k] == text[j]).astype(np.uint8) << k
            before = state
            state = [before[0] & same]
            for d in range(1, edits + 1):
                state.append(((before[d] & same) | before[d - 1] | (before[d - 1] >> 1) | (state[d - 1] << 1)) & mask)
            done = ends == j + 1
            if done.any():
                out[some[lane[done]]] = (state[edits][done] >> want[done] & 1).astype(bool)
            alive = (state[edits] > 0) & ~done
            if 2 * alive.sum() < len(lane):
                lane, ends, want, text, pattern = lane[alive], ends[alive], want[alive], text[:, alive], pattern[:, alive]
                state = [x[alive] for x in state]
            if not len(lane):
                break
    return out


def near_lines(distinct: DataFrame, edits: int = EDITS, per: int = PER) -> DataFrame:
    """Links a, b of ids in a stored table (id, line) of distinct lines: all of cold keys, with n = 1, and a forest for hot
    ones, with n = 0; rows with a = b have the n links that a line has in hot cells. A stored table."""
    most = sum((e**2 - d**2) // 2 + e + 1 for e in (edits,) for d in range(e + 1))
    count = distinct.count()
    pairs, members = pairs_and_members(met(keyed(distinct, buckets(most * count), edits, per, within_chunk(count, HOT)), HOT))
    of_line = members.groupBy("id").agg(F.collect_set("key").alias("hot"))
    ids = stored(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(members.select("id")).distinct())
    held = distinct.join(small(ids), "id", "left_semi")
    held = stored(held.join(of_line, "id", "left").withColumn("hot", F.coalesce("hot", F.array().cast("array<long>"))))

    def close(first: list[str], second: list[str]) -> np.ndarray:
        allowed = budget(np.array([min(len(a), len(b)) for a, b in zip(first, second, strict=True)], int), edits, per)
        out = np.zeros(len(first), bool)
        for e in np.unique(allowed):
            some = np.flatnonzero(allowed == e)
            out[some] = near([first[i] for i in some], [second[i] for i in some], int(e))
        return out

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[close(batch["first"].tolist(), batch["second"].tolist())][["a", "b"]].assign(n=1)

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("id").sort_values("id")
        ids, text = pdf["id"].to_numpy(), pdf["line"].tolist()
        bags = np.zeros((len(text), 64), np.int16)
        for i, x in enumerate(text):
            bags[i] = np.minimum(np.bincount(np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) % 64, minlength=64), 30_000)
        rows, cols = [], []
        for i in range(len(text) - 1):
            hit = np.flatnonzero(np.abs(bags[i + 1 :] - bags[i]).sum(1) <= 2 * edits) + i + 1
            rows += [i] * len(hit)
            cols += hit.tolist()
        yes = close([text[i] for i in rows], [text[j] for j in cols])
        found = [x for x, y in zip(zip(rows, cols, strict=True), yes, strict=True) if y]
        key, cell, own, hot = pdf["key"].iloc[0], pdf["cell_"].iloc[0], pdf["own_"].tolist(), [set(x) for x in pdf["hot"]]
        here = [x for x in found if (own[x[0]] != own[x[1]] or cell["i"] == cell["j"]) and min(hot[x[0]] & hot[x[1]]) == key]
        links = np.bincount(np.array(here, int).ravel(), minlength=len(text))
        out = [(ids[i], ids[j], 0) for i, j in forest(len(text), found)] + [(ids[i], ids[i], links[i]) for i in np.flatnonzero(links)]
        return pd.DataFrame(out, columns=["a", "b", "n"], dtype="int64")

    sides = pairs.join(held.select(F.col("id").alias("a"), F.col("line").alias("first"), F.col("hot").alias("hot_a")), "a")
    sides = sides.join(held.select(F.col("id").alias("b"), F.col("line").alias("second"), F.col("hot").alias("hot_b")), "b").where(~F.arrays_overlap("hot_a", "hot_b"))
    cold = sides.select("a", "b", "first", "second").mapInPandas(verify, "a long, b long, n long")
    dealt = cells(members.select("id", "key"), "key", own=True).join(held, "id")
    return stored(cold.union(dealt.groupBy("key", "cell_").applyInPandas(within, "a long, b long, n long")))


def placed_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST, per: int = PER, passed: DataFrame | None = None) -> DataFrame:
    """row_, place, n (characters), at (order), class, first (its least at), links (distinct lines near this one) of every
    line whose class has more than one line, equal ones counted; a stored table. The documents of the ids `passed` (doc_id)
    have the first line of a class only if no other document has a line of it."""
    with passing(docs.sparkSession):
        return stored(_placed_lines(docs, edits, least, per, passed), after=True)


def _placed_lines(docs: DataFrame, edits: int, least: int, per: int, passed: DataFrame | None) -> DataFrame:
    distinct = lines(docs).groupBy("line").agg(F.count(F.lit(1)).alias("times"))
    distinct = stored(distinct.select(F.monotonically_increasing_id().alias("id"), digest(F.col("line")).alias("hash"), "times", "line"))
    found = near_lines(distinct.where(F.length("line") >= least).select("id", "line"), edits, per)
    ends = F.explode(F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))).alias("id")
    links = found.where("n > 0").select(ends, "n").groupBy("id").agg(F.sum("n").alias("links"))
    near = stored(components(found.select("a", "b")).join(links, "id", "left"))
    near = stored(distinct.select("id", "hash", "times").join(small(near), "id", "left").where("component is not null or times > 1").select("hash", F.coalesce("links", F.lit(0)).alias("links"), "component"))
    names = near.where("component is not null").groupBy("component").agg(F.min("hash").alias("class"))
    classes = small(stored(near.join(small(stored(names)), "component", "left").select("hash", "links", F.coalesce("class", "hash").alias("class"))))
    at = F.struct("doc_id", "row_", "place").alias("at")
    late = F.lit(False)
    if passed is not None:
        docs, late = docs.select("doc_id", "text").join(small(passed.select("doc_id", F.lit(True).alias("late_"))), "doc_id", "left"), F.coalesce("late_", F.lit(False))
    seen = lines(docs, "doc_id", late.alias("late")).select("row_", "late", "place", F.length("line").alias("n"), digest(F.col("line")).alias("hash"), at)
    seen = stored(seen.join(classes, "hash").drop("hash"))
    first = stored(seen.groupBy("class").agg(F.min(F.struct("late", "at")).alias("first")).select("class", "first.at").toDF("class", "first"))
    return seen.drop("late").join(small(first), "class")


def repeated_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST, per: int = PER, passed: DataFrame | None = None) -> DataFrame:
    """row_, removed (places of the lines that go), source (row_ of the document of a smaller doc_id in which most
    characters of these lines began; null if there is none) for documents that lose a line; a stored table."""
    with passing(docs.sparkSession):
        gone = placed_lines(docs, edits, least, per, passed).where("at <> first")
        earlier = F.when(F.col("first.doc_id") < F.col("at.doc_id"), F.col("first.row_")).alias("source")
        parts = gone.groupBy("row_", earlier).agg(F.collect_set("place").alias("places"), F.sum("n").alias("n"))
        most = F.max(F.when(F.col("source").isNotNull(), F.struct("n", "source")))["source"].alias("source")
        out = parts.groupBy("row_").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("removed"), most)
        return stored(out, after=True)


def _without(text: str, removed: str) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(removed, i)), "\n")


def near_copies(docs: DataFrame, percent: int, words: int) -> DataFrame:
    """doc_id of the documents that are not the least of those that links of similarity join; a stored table."""
    return stored(jaccard_components(docs, words, percent).where("doc_id <> component_id").select("doc_id").distinct())


def copies(docs: DataFrame, repeated: DataFrame, whole: float, words: int) -> DataFrame:
    """row_ of the documents whose sets of so many words in a row are `whole` similar to their source's, both as the
    source is and without its own repeated lines, so whichever of the two stays; a stored table."""
    percent = round(100 * whole)
    held = docs.select(row_key().alias("row_"), F.coalesce("text", F.lit("")).alias("text"))
    members = small(stored(repeated.where("source is not null").select("row_", "source")))
    own = held.join(members, "row_")
    sources = small(stored(members.select("source").distinct()))
    first = held.select(F.col("row_").alias("source"), F.col("text").alias("first")).join(sources, "source").dropDuplicates(["source"])
    cut = small(stored(repeated.select(F.col("row_").alias("source"), F.col("removed").alias("gone")).join(sources, "source")))
    first = first.join(cut, "source", "left").select("source", "first", F.when(F.col("gone").isNotNull(), _without("first", "gone")).alias("rest"))
    pairs = own.join(first, "source").select("row_", "text", "first", "rest")

    def alike(x: np.ndarray, y: np.ndarray) -> bool:
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hit = []
            for row, text, first, rest in batch.itertuples(index=False):
                x = shingles(text, words)
                if alike(x, shingles(first, words)) and (rest is None or alike(x, shingles(rest, words))):
                    hit.append(row)
            yield pd.DataFrame({"row_": pd.Series(hit, dtype=object)})

    return stored(pairs.mapInPandas(verify, "row_ binary").distinct())


def deduplicated(docs: DataFrame, edits: int = EDITS, least: int = LEAST, per: int = PER, whole: float = 2.0, words: int = 5) -> DataFrame:
    """The documents without repeated lines; n_chars, if there, follows. Verified copies of one earlier document (the
    Jaccard similarity of their words in a row is `whole` or more, see `copies`) are left as they are, for a later stage
    that drops them; above 1 there are none. What that stage would drop now has no first lines that others share, so no line
    goes here whose first goes there."""
    row, gone = free(docs, "row_"), free(docs, "removed")
    with passing(docs.sparkSession):
        passed = near_copies(docs, round(100 * whole), words) if whole <= 1 else None
        repeated = repeated_lines(docs, edits, least, per, passed)
        if whole <= 1:
            repeated = repeated.join(small(copies(docs, repeated, whole, words)), "row_", "left_anti")
        repeated = stored(repeated.select(F.col("row_").alias(row), F.col("removed").alias(gone)), after=True)
    out = docs.withColumn(row, row_key()).join(small(repeated), row, "left")
    out = out.withColumn("text", F.when(F.col(gone).isNotNull(), _without("text", gone)).otherwise(F.col("text"))).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def line_classes(docs: DataFrame, edits: int = EDITS, least: int = LEAST, per: int = PER) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (places of the lines that go), classes (place:class of the lines whose class has
    more than one), links (place:number of distinct other lines near it), each comma-joined by place."""
    counts = docs.select("doc_id", row_key().alias("row_"), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"))
    each = F.array_sort(F.collect_set(F.struct("place", "class", "links", (F.col("at") != F.col("first")).alias("goes")))).alias("each")
    each = placed_lines(docs, edits, least, per).groupBy("row_").agg(each)
    removed = F.filter("each", lambda x: x["goes"])
    joined = lambda rows, *names: F.array_join(F.transform(rows, lambda x: F.concat_ws(":", *[x[k].cast("string") for k in names])), ",")
    shown = [joined(removed, "place").alias("removed"), F.array_join(F.transform("each", lambda x: F.concat_ws(":", x["place"].cast("string"), F.lower(F.hex(x["class"])))), ",").alias("classes"), joined("each", "place", "links").alias("links")]
    found = each.select("row_", F.size(removed).cast("long").alias("n_removed"), *shown)
    return counts.join(found, "row_", "left").drop("row_").fillna({"n_removed": 0, "removed": "", "classes": "", "links": ""})


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: how many lines it has, how many go and which, and the classes and links of its lines."""
    return line_classes(table(spark, sf_dir, "documents"))
