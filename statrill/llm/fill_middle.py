"""Fill-in-middle transformation by an index of distinct texts.

Texts are cut into units, `[ws]*[^ws]+|[ws]+` from left to right: each word with the white space before it, and what white
space is left at the end. A document's seed picks two cuts between units; prefix, middle and suffix are written in the order
of its form behind the markers `<P>`, `<S>`, `<M>`. Documents that the seed does not pick, empty ones, and those that hold a
marker stay plain.

Identical texts are grouped by their SHA-256, in the JVM and combined before the shuffle, so of each group one text travels;
the ends of its units are listed once, as an Elias-Fano list: the low bits of each end side by side, the high bits as a bit
vector of steps, about 2 + log2(mean unit) bits for each unit. Documents travel without their text to the group's, where each
selects the ends of its cuts from the list; a cut reads the list, never the text. Groups of more than HOT documents are dealt
to several tasks with a text each. That the group is right is verified: the digest of the text rebuilt from each output is
held against the digest that its document was grouped by, and a job fails where they differ.

Null texts count as empty and stay null in `text`; a null doc_id seeds as an empty one; repeated rows give repeated results;
very long texts are read whole. An empty table gives an empty one. Other columns are kept, whatever their names, and give way
to columns of the result of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import passing, ready, stored, table

SEED, RATE, SPM = 42, 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Documents of one text that meet in a task, about, and the most texts that may be dealt out; both raise the other's bound.
HOT, MOST_HOT = 256, 200_000
_BLANK = np.zeros(33, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Bits set in each byte.
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1)


def unit_ends(text: str) -> np.ndarray:
    """Where units end, in code points."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = np.zeros(len(chars), bool)
    low = np.flatnonzero(chars <= 32)
    blank[low] = _BLANK[chars[low]]
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    return np.concatenate([ends, [len(chars)]]) if len(chars) else np.zeros(0, np.int64)


def listed(ends: np.ndarray) -> bytes:
    """An Elias-Fano list of rising numbers: the count of low bits, the low bits, the high bits."""
    if not len(ends):
        return b""
    bits = max(0, int(ends[-1] // len(ends)).bit_length() - 1)
    low = np.packbits((ends[:, None] >> np.arange(bits) & 1).astype(np.uint8))
    high = np.zeros(len(ends) + int(ends[-1] >> bits) + 1, np.uint8)
    high[(ends >> bits) + np.arange(len(ends))] = 1
    return bytes([bits]) + low.tobytes() + np.packbits(high).tobytes()


def selected(list_: bytes, n: int, k: int) -> int:
    """Number k (from 1) of a list of n; 0 for k = 0."""
    if k == 0:
        return 0
    bits = list_[0]
    size = -(-n * bits // 8)
    high = np.frombuffer(list_, np.uint8, offset=1 + size)
    sums = np.cumsum(_ONES[high])
    byte = int(np.searchsorted(sums, k))
    within = np.flatnonzero(np.unpackbits(high[byte : byte + 1]))[k - 1 - (int(sums[byte - 1]) if byte else 0)]
    first = (k - 1) * bits
    held = np.unpackbits(np.frombuffer(list_, np.uint8, offset=1 + first // 8, count=min(size - first // 8, bits // 8 + 2)))[first % 8 : first % 8 + bits] if bits else ()
    return (8 * byte + int(within) - (k - 1) << bits) + sum(int(x) << i for i, x in enumerate(held))


def _index(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ends = [unit_ends(x) for x in batch]
        yield pd.DataFrame({"n": [len(x) for x in ends], "ends": [listed(x) for x in ends]}, columns=["n", "ends"])


def _cuts(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for some in batches:
        found = [(0, 0) if x is None else (selected(x, n, a), selected(x, n, b)) for x, n, a, b in zip(*some, strict=True)]
        yield pd.DataFrame(found, columns=["first", "second"])


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: markers stand in it once each, in the order of its form."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def transformed(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """The documents with n (units), form (plain, psm, spm), prefix_chars, middle_chars (null if plain), output, restored (the
    text rebuilt from output and form). `rate` percent of the documents are cut, `spm` percent of those suffix first."""
    spark = ready(docs.sparkSession)
    index_of, cuts_of = F.pandas_udf(_index, "n long, ends binary"), F.pandas_udf(_cuts, "first int, second int")
    new = ("n", "form", "prefix_chars", "middle_chars", "output", "restored")
    others = [c for c in docs.columns if c != "text" and c not in new]
    whole = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct(*others).alias("row_"), F.col("text").isNull().alias("null_"), F.unhex(F.sha2(whole, 256)).alias("key_"), whole.alias("text_"))
    with passing(spark):
        counts = docs.groupBy(F.unhex(F.sha2(whole, 256)).alias("key_")).agg(F.count(F.lit(1)).alias("copies_"))
        least = max(HOT, -(-docs.count() // MOST_HOT))
        hot = stored(counts.where(F.col("copies_") > least).select("key_", F.ceil(F.col("copies_") / least).alias("parts_")), after=True)
    # at most MOST_HOT rows of a digest and a number, by the choice of `least`
    dealt = rows.join(F.broadcast(hot), "key_", "left").withColumn("part_", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("parts_")), F.lit(0)))
    # the shuffle of texts serves both: lists are made in Python, after which Spark no longer knows how rows are dealt
    distinct = dealt.groupBy("key_", "part_").agg(F.min("text_").alias("text_"))
    index = distinct.select("key_", "part_", index_of("text_").alias("index_"))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("row_.doc_id").cast("string"), F.lit(""))), 256)
    h = lambda i: F.conv(F.substring(hashed, 8 * i - 7, 8), 16, 10).cast("long").alias(f"h{i}_")
    met = dealt.select("key_", "part_", "row_", "null_", *map(h, (1, 2, 3, 4))).join(distinct, ["key_", "part_"]).join(index, ["key_", "part_"])
    marked = F.col("text_").contains(PREFIX) | F.col("text_").contains(SUFFIX) | F.col("text_").contains(MIDDLE)
    form = F.when((F.col("text_") == "") | marked | (F.col("h3_") % 100 >= rate), "plain").when(F.col("h4_") % 100 < spm, "spm").otherwise("psm")
    n = F.col("index_.n")
    met = met.select("key_", "row_", "null_", "text_", n.alias("n"), form.alias("form"), F.col("index_.ends").alias("ends_"), (F.col("h1_") % (n + 1)).alias("a_"), (F.col("h2_") % (n + 1)).alias("b_"))
    met = met.withColumn("at_", cuts_of(F.when(F.col("form") != "plain", F.col("ends_")), "n", F.least("a_", "b_"), F.greatest("a_", "b_")))
    first, second = F.col("at_.first"), F.col("at_.second")
    prefix, middle, suffix = F.substring("text_", F.lit(1), first), F.substring("text_", first + 1, second - first), F.substring("text_", second + 1, F.length("text_"))
    output = F.when(F.col("form") == "plain", F.col("text_")).when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)).otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    cut = lambda x: F.when(F.col("form") != "plain", x.cast("long"))
    out = met.select("key_", "row_", "n", "form", cut(first).alias("prefix_chars"), cut(second - first).alias("middle_chars"), F.when(~F.col("null_"), F.col("text_")).alias("text_"), output.alias("output"))
    out = out.withColumn("restored", restored(F.col("output"), F.col("form")))
    right = F.unhex(F.sha2("restored", 256)) == F.col("key_")
    out = out.withColumn("restored", F.when(right, F.col("restored")).otherwise(F.raise_error("a text rebuilt from its output differs from its document's")))
    kept = [(F.col("text_") if c == "text" else F.col("row_").getField(c)).alias(c) for c in docs.columns if c not in new]
    return out.select(*kept, *new)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    digest = lambda c: F.sha2(c, 256).alias(f"{c}_sha256")
    return transformed(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


def _sql() -> str:
    hex_ = lambda i: f"('0x' || substr(h, {8 * i - 7}, 8))::bigint"
    return f"""
    with d as (select doc_id, coalesce(text, '') as text, sha256('{SEED}:' || coalesce(doc_id::varchar, '')) as h from documents),
    units as (select *, regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') as units, {', '.join(f'{hex_(i)} as h{i}' for i in (1, 2, 3, 4))} from d),
    cut as (select *, len(units) as n, h1 % (len(units) + 1) as a, h2 % (len(units) + 1) as b, case when text = '' or contains(text, '{PREFIX}') or contains(text, '{SUFFIX}') or contains(text, '{MIDDLE}') or h3 % 100 >= {RATE} then 'plain' when h4 % 100 < {SPM} then 'spm' else 'psm' end as form from units),
    parts as (select *, array_to_string(units[:least(a, b)], '') as p, array_to_string(units[least(a, b) + 1 : greatest(a, b)], '') as m, array_to_string(units[greatest(a, b) + 1 :], '') as s from cut)
    select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
      sha256(case form when 'plain' then text when 'psm' then '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m else '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m end) as output_sha256, sha256(p || m || s) as restored_sha256 from parts"""


ORACLE_SQL = {"op12_fill_middle": _sql()}
