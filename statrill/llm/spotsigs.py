"""Document fingerprints by spot signatures: an anchor word and the chain of content words that follows it.

A text's fingerprint is the sorted set of its signatures' 32-bit hashes, eight hexadecimal digits each. A text without
any signature has one of its whole self instead, so equal texts have equal fingerprints and other texts do not meet by
having none. The likeness of two fingerprints is the Jaccard similarity of their sets.

classes() deals sets out by their number of signatures, so that sets as similar as asked for are in one part or in
neighbouring ones, and pairs only sets that share one of the signatures by which such sets must meet, the rarest ones
first; rarity is counted over all sets by SIGNS buckets of signatures. Signatures that very many sets share are compared
block by block. Every pair is verified exactly.

Null texts count as empty. Repeated rows give repeated results; in the order of documents, rows of one doc_id are ordered
by text, and null doc_ids come last. An empty table gives an empty one; very long texts are read whole. Columns other than
doc_id and text are not read, and ids never leave the JVM.
"""

from __future__ import annotations

import hashlib
import math
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import passing, stored, table, texts
from .links import cells, components, small
from .meeting import CHUNK, PACKED, buckets, met, packed, pairs_and_members, within_chunk
from .ngram_join import forest, linked, mixed

#: Common words of English, French, German and Spanish at which signatures begin, and those passed over.
ANCHORS = frozenset("is was are that with this for have it est que qui dans pour avec sur ist nicht mit auf sich für con para por una su se".split())
COMMON = ANCHORS | frozenset("a an and as at be by from he his in not of on or the to you au aux ce de des du elle en et il la le les leur mais ne ou par pas plus un une y das dem den der des die du ein eine er es im in sie und von zu al como del el ha lo los las más no o pero si sus".split())
CHAIN, SIMILAR, SIGNS = 2, 0.8, 1 << 16
STRIP = string.punctuation + "«»“”„’‘–—…¿¡"


def signatures(text: str, chain: int = CHAIN) -> frozenset[str]:
    """Hashes of all spot signatures of a text; of the whole text, if it has none."""
    words = text.lower().split()
    out = set()
    for at in (i for i, w in enumerate(words) if w in ANCHORS):
        found: list[str] = []
        for word in map(words.__getitem__, range(at + 1, len(words))):
            if (bare := word.strip(STRIP)) and bare not in COMMON:
                found.append(bare)
                if len(found) == chain:
                    out.add(f"{zlib.crc32(' '.join([words[at], *found]).encode('utf-8', 'surrogatepass')):08x}")
                    break
    return frozenset(out) if out else frozenset([hashlib.sha256(b"\0" + text.encode("utf-8", "surrogatepass")).hexdigest()[:8]])


def fingerprint(signs: frozenset[str]) -> str:
    return "".join(sorted(signs))


def likeness(a: frozenset[str], b: frozenset[str]) -> float:
    """Jaccard similarity."""
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint."""

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint(signatures(t)) for t in batch], dtype=object)

    return texts(docs).select("doc_id", of("text").alias("fingerprint"))


def signs(fingerprints: pd.Series) -> list[np.ndarray]:
    """The signatures of each fingerprint, as numbers."""
    return [np.frombuffer(bytes.fromhex(x), ">u4").astype(np.uint64) for x in fingerprints]


def set_keys(x: np.ndarray, often: np.ndarray, similar: float) -> tuple[int, np.ndarray]:
    """The part of a set of signatures, and the signatures by which it meets sets as similar: all but the ceil(similar * n)
    - 1 most frequent ones. Whatever the order, two such sets share one of these."""
    n = len(x)
    order = np.lexsort((x, often[(x % np.uint64(SIGNS)).astype(np.int64)]))
    return math.floor(math.log(n) / -math.log(similar) + 1e-9), x[order[: n - math.ceil(similar * n - 1e-9) + 1]]


def near_sets(sets: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Links a, b of ids in a table (id, fingerprint), whose ids count up within a file, which join what is as similar: all
    of cold signatures, a spanning forest of each two blocks for hot ones."""
    sign = F.conv(F.substring("fingerprint", 8 * F.col("at") + 5, 4), 16, 10).cast("int")  # the last 16 of 32 bits
    each = sets.select("fingerprint", F.explode(F.sequence(F.lit(0), (F.length("fingerprint") / 8).cast("int") - 1)).alias("at"))
    counted = each.groupBy(sign.alias("sign")).agg(F.count(F.lit(1)).alias("n")).toPandas()  # SIGNS rows at most
    often = np.zeros(SIGNS, np.int64)
    often[counted["sign"].to_numpy(int)] = counted["n"]
    count = sets.count()
    n, hot = buckets(2 * count + int(2 * (1 - similar) * often.sum())), within_chunk(count)

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, found = batch["id"].to_numpy(), signs(batch["fingerprint"])
            at = 0
            while at < len(ids):
                far = np.flatnonzero((ids[at:] < ids[at]) | (ids[at:] >= ids[at] + CHUNK))
                to = at + int(far[0]) if len(far) else len(ids)
                row, key, own = [], [], []
                for i in range(at, to):
                    part, few = set_keys(found[i], often, similar)
                    for more in (0, 1):
                        key.append(mixed(few * np.uint64(0x9E3779B97F4A7C15) + np.uint64(part + more)))
                    row.append(np.full(2 * len(few), ids[i] - ids[at]))
                    own.append(np.repeat([True, False], len(few)))
                with np.errstate(over="ignore"):
                    yield packed(int(ids[at]), *map(np.concatenate, (row, key, own)), n, hot)
                at = to

    pairs, members = pairs_and_members(met(sets.select("id", "fingerprint").mapInPandas(keys, PACKED)))
    held = small(stored(sets.select("id", "fingerprint").join(small(stored(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())), "id", "left_semi")))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yes = [likeness(frozenset(x.tolist()), frozenset(y.tolist())) >= similar - 1e-9 for x, y in zip(signs(batch["x"]), signs(batch["y"]), strict=True)]
            yield batch[np.array(yes, bool)][["a", "b"]]

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["id"].to_numpy()
        yes = np.triu(linked(signs(pdf["fingerprint"]), round(100 * similar)), 1)
        return pd.DataFrame([(ids[i], ids[j]) for i, j in forest(len(ids), zip(*(x.tolist() for x in np.nonzero(yes)), strict=True))], columns=["a", "b"], dtype="int64")

    sides = pairs.join(held.toDF("a", "x"), "a").join(held.toDF("b", "y"), "b")
    dealt = cells(members, "key").join(sets.select("id", "fingerprint"), "id")
    return stored(sides.select("a", "b", "x", "y").mapInPandas(verify, "a long, b long").union(dealt.groupBy("key", "cell_").applyInPandas(within, "a long, b long")))


def classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """print_ (hash of the fingerprint), class_id: the least doc_id that links of at least that similarity reach, of the
    fingerprints that more than one document reaches; a stored table."""
    with passing(docs.sparkSession):
        prints = fingerprints(docs).where("doc_id is not null").withColumns({"id": F.monotonically_increasing_id(), "print_": F.xxhash64("fingerprint")})
        prints = stored(prints)
        sets = stored(prints.groupBy("print_").agg(F.min("id").alias("id"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("times")))
        first = prints.select("id", "fingerprint").join(small(sets.select("id")), "id", "left_semi")
        ends = small(components(near_sets(first, similar)))
        many = stored(sets.join(ends, "id", "left").where("component is not null or times > 1").select("print_", F.coalesce("component", "id").alias("component"), "least"))
        names = small(stored(many.groupBy("component").agg(F.min("least").alias("class_id"))))
        return stored(many.join(names, "component").select("print_", "class_id"), after=True)


def with_class(prints: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (doc_id, fingerprint, more) with their class_id, by what classes() gives; rows of a null doc_id have one only if
    another document's fingerprint is the same."""
    return prints.withColumn("print_", F.xxhash64("fingerprint")).join(small(known), "print_", "left").withColumn("class_id", F.coalesce("class_id", "doc_id")).drop("print_")


def near_duplicates(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, class_id: the least doc_id that links of at least that similarity reach."""
    return with_class(fingerprints(docs), classes(docs, similar)).select("doc_id", "class_id")


#: Documents of a range, about; and most ranges.
RANGE_ROWS, RANGES = 2000, 16_384


def followed(docs: DataFrame) -> DataFrame:
    """doc_id, text, after: the next document's text, where documents are in descending doc_id and the first follows the
    last.

    Documents are dealt into ranges of doc_id and sorted within them; the highest of each range also goes to the range
    above, as what follows that range's lowest. Of the ranges, RANGES at most, bounds and highest pass through the driver.
    """
    spark = docs.sparkSession
    parts = max(1, min(RANGES, docs.count() // RANGE_ROWS))
    rows = texts(docs).withColumn("key_", F.coalesce(F.col("doc_id").cast("double"), F.lit(-1e300)))
    bounds = sorted(set(rows.approxQuantile("key_", [i / parts for i in range(1, parts)], 0.25 / parts))) if parts > 1 else []
    if bounds:
        rows = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol="key_", outputCol="range_").transform(rows)
        rows = rows.withColumn("range_", F.col("range_").cast("int"))
    else:
        rows = rows.withColumn("range_", F.lit(0))
    order = F.struct("key_", F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("hash"))
    tops = rows.groupBy("range_").agg(F.max(order).alias("top")).orderBy("range_").collect()
    marks = [(r["range_"], r["top"]["id"], r["top"]["hash"], tops[(i + 1) % len(tops)]["range_"]) for i, r in enumerate(tops)]
    marks = F.broadcast(spark.createDataFrame(marks, "range_ int, top_ long, hash_ long, above_ int"))
    marked = rows.join(marks, "range_", "left")
    is_top = (F.coalesce("doc_id", F.lit(0)) == F.col("top_")) & (F.xxhash64("text") == F.col("hash_"))
    own = F.struct(F.col("range_"), F.lit(0).alias("ghost"))
    ghost = F.struct(F.col("above_").alias("range_"), F.lit(1).alias("ghost"))
    dealt = marked.select("doc_id", "text", "key_", F.explode(F.when(is_top, F.array(own, ghost)).otherwise(F.array(own))).alias("at_"))
    within = Window.partitionBy("at_.range_").orderBy("at_.ghost", F.desc("key_"), F.desc("doc_id"), F.desc(F.xxhash64("text")))
    return dealt.select("doc_id", "text", F.lead("text").over(within).alias("after"), F.col("at_.ghost").alias("ghost_")).where("ghost_ = 0").drop("ghost_")


def edited(text: str, after: str) -> str:
    """The text with its last half replaced by the beginning of the next document."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def described(docs: DataFrame) -> DataFrame:
    """The fingerprint of each text and of its edited text, and how like they and the next document's are."""

    @F.pandas_udf("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    def describe(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, after in zip(*batch, strict=True):
                changed = edited(text, after)
                own, other, later = signatures(text), signatures(changed), signatures(after)
                rows.append((len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint(own), fingerprint(other), likeness(own, other), likeness(own, later)))
            yield pd.DataFrame(rows, columns=["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return followed(docs).select("doc_id", describe("text", "after").alias("of")).select("doc_id", "of.*")


def op2_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return with_class(described(docs), classes(docs))
