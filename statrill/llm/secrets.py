"""Secrets in text, told apart from published examples by who owns their copies. DataFrame functions only.

Patterns give candidates: `assign`, `access`, `hex`, and `opaque` (a run of 24 or more characters that mixes cases and
digits and touches no other candidate). The hash of each candidate's value is counted over the whole corpus: in how many
repositories (different texts) and under how many owners (source; a text that several have is the least one's) it stands. A
value of EXAMPLE_REPOSITORIES repositories and EXAMPLE_OWNERS owners or more is a widely copied example; any other looks
live: one owner's however often, or of copies of one document. Candidates of the first three kinds are always reported,
with that verdict and both counts; an opaque one is reported only if it looks live.

Spans are code points, end exclusive. Null texts count as empty; a null source is one more owner; of spans that touch, each
is reported, and what they cover is masked. Repeated rows give repeated results and count once as a repository. An empty
table gives an empty one; a very long text is scanned whole. Columns other than doc_id, source and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, stored, table

KINDS = ("assign", "access", "hex", "opaque")
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: A run of these is taken whole, so the least length may stand in the pattern.
ACCESS, HEX, OPAQUE = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}"
LEAST_VALUE, EXAMPLE_REPOSITORIES, EXAMPLE_OWNERS = 6, 3, 3
#: Rows of one value are dealt to so many places when they meet its verdict.
SALT = 32
SPAN = "array<struct<start: int, rank: int, kind: string, end: int, hash: string>>"


def _hits(text: Column, rank: int, pattern: str, value: int, holds) -> Column:
    """Spans of a pattern's matches: the text between matches and the matches themselves, measured one after the other."""
    none = F.lit(None).cast(SPAN)
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(KINDS[rank]).alias("kind"), end.alias("end"), F.sha2(F.regexp_extract(x["hit"], pattern, value), 256).alias("hash"))
        return F.struct(end.alias("at"), F.when(holds(x["hit"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    pairs = F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
    return F.when(F.rlike(text, F.lit(pattern)), F.aggregate(pairs, begin, step, lambda acc: acc["out"])).otherwise(none)


def candidates(docs: DataFrame, *more: Column) -> DataFrame:
    """row_ (a number of each row), copy_ (hash of its text), doc_id, source, more, spans: all candidates by start, then kind."""
    text = F.col("text")
    assign = F.when(text.contains("=") | text.contains(":"), _hits(text, 0, ASSIGN, 2, lambda h: F.length(F.regexp_extract(h, ASSIGN, 2)) >= LEAST_VALUE))
    mixed = lambda h: h.rlike("[0-9]") & h.rlike("[a-z]") & h.rlike("[A-Z]")
    base = [F.coalesce(x, F.array().cast(SPAN)) for x in (assign, _hits(text, 1, ACCESS, 0, lambda h: F.lit(True)), _hits(text, 2, HEX, 0, lambda h: F.lit(True)))]
    opaque = F.coalesce(_hits(text, 3, OPAQUE, 0, mixed), F.array().cast(SPAN))
    rows = docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"), *more).withColumns({"row_": F.monotonically_increasing_id(), "copy_": F.unhex(F.md5("text"))})
    kept = [c for c in rows.columns if c != "text"]
    rows = rows.select(*kept, F.concat(*base).alias("base"), opaque.alias("opaque"))
    apart = F.filter("opaque", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return rows.select(*kept, F.array_sort(F.concat("base", apart)).alias("spans"))


def counted(spans: DataFrame) -> DataFrame:
    """hash, repositories, owners, example of the values that stand in more than one text."""
    each = spans.select("copy_", F.coalesce("source", F.lit("")).alias("source"), F.explode(F.array_distinct(F.col("spans.hash"))).alias("hash"))
    of_text = each.groupBy("hash", "copy_").agg(F.min("source").alias("owner"))
    out = of_text.groupBy("hash").agg(F.count(F.lit(1)).alias("repositories"), F.count_distinct("owner").alias("owners"))
    return out.where("repositories > 1").withColumn("example", (F.col("repositories") >= EXAMPLE_REPOSITORIES) & (F.col("owners") >= EXAMPLE_OWNERS))


VERDICT = "array<struct<start: int, rank: int, kind: string, end: int, live: boolean, repositories: bigint, owners: bigint>>"


def judged(found: DataFrame) -> DataFrame:
    """row_, spans: start, rank, kind, end, live, repositories, owners of the reported spans of each row that has a candidate."""
    salt = F.pmod(F.xxhash64("row_", "span.start"), F.lit(SALT)).cast("int")
    each = found.select("row_", F.explode("spans").alias("span")).select("row_", "span", F.col("span.hash").alias("hash"), salt.alias("salt"))
    known = counted(found).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    one = {"repositories": F.coalesce("repositories", F.lit(1)), "owners": F.coalesce("owners", F.lit(1)), "live": ~F.coalesce("example", F.lit(False))}
    kept = each.join(known, ["hash", "salt"], "left").withColumns(one).where((F.col("span.kind") != "opaque") | F.col("live"))
    return kept.groupBy("row_").agg(F.array_sort(F.collect_list(F.struct("span.start", "span.rank", "span.kind", "span.end", "live", "repositories", "owners"))).alias("spans"))


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, spans (kind, start, end, live, repositories, owners), one row for each of the documents."""
    found = stored(candidates(docs))
    names = ("kind", "start", "end", "live", "repositories", "owners")
    spans = F.transform(F.coalesce("verdict", F.array().cast(VERDICT)), lambda x: F.struct(*[x[n].alias(n) for n in names]))
    return found.select("row_", "doc_id").join(judged(found.where(F.size("spans") > 0)).withColumnRenamed("spans", "verdict"), "row_", "left").select("doc_id", spans.alias("spans"))


def redacted(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """The documents with every live-looking span of their text replaced; examples stay. n_chars, if there, follows."""
    own, live = free(docs, "key_"), free(docs, "live_")
    key = F.unhex(F.md5(F.concat_ws("\n", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "source", "text")])))
    found = stored(candidates(docs, key.alias("key_")).where(F.size("spans") > 0))
    spans = judged(found).select("row_", F.filter("spans", lambda x: x["live"]).alias("live_")).where(F.size("live_") > 0)
    spans = found.select("row_", "key_").join(spans, "row_").groupBy(F.col("key_").alias(own)).agg(F.any_value("live_").alias(live))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        before = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"]), F.lit(mask))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] >= acc["at"], before).otherwise(acc["out"]).alias("out"))

    masked = F.aggregate(live, begin, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    out = docs.withColumn(own, key).join(spans, own, "left").withColumn("text", F.when(F.col(live).isNotNull(), masked).otherwise(F.col("text"))).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    base = F.filter(spans, lambda x: x["kind"] != "opaque")
    n = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    seen = lambda what: F.array_join(F.transform(spans, lambda x: x[what].cast("string")), ",").alias(what)
    return secret_spans(table(spark, sf_dir, "documents")).select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(spans).alias("spans"), F.size(F.filter(spans, lambda x: ~x["live"])).cast("long").alias("n_examples"), seen("repositories"), seen("owners"))


def _sql() -> str:
    """The same in DuckDB, whose case folding is spelt out and whose patterns have no look-behind: runs are taken whole."""
    either = lambda word: "".join(f"[{x.upper()}{x}]" if x.isalpha() else x for x in word)
    words = "|".join(map(either, ("password", "passwd", "secret", "token"))) + "|" + either("api") + "_?" + either("key")
    patterns = (rf"""({words})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", ACCESS, HEX, "[A-Za-z0-9+/_-]{24,}")
    each = " union all ".join(f"select row_, {i} as rank, '{KINDS[i]}' as kind, regexp_extract_all(text, '{p}') as hits, regexp_extract_all(text, '{p}', {2 if i == 0 else 0}) as held, string_split_regex(text, '{p}') as gaps from d" for i, p in enumerate(patterns))
    return f"""
    with d as (select row_number() over () as row_, doc_id, coalesce(source, '') as source, coalesce(text, '') as text from documents),
    found as ({each}),
    apart as (select row_, rank, kind, generate_subscripts(hits, 1) as i, unnest(hits) as hit, unnest(held) as held, unnest(gaps[:len(hits)]) as gap from found where len(hits) > 0),
    placed as (select *, sum(length(gap) + length(hit)) over (partition by row_, rank order by i) as stop from apart),
    spans as (select row_, rank, kind, stop - length(hit) as start, stop, held from placed where (rank <> 0 or length(held) >= {LEAST_VALUE}) and (rank <> 3 or regexp_matches(hit, '[0-9]') and regexp_matches(hit, '[a-z]') and regexp_matches(hit, '[A-Z]'))),
    kept as (select * from spans s where rank < 3 or not exists (select 1 from spans b where b.row_ = s.row_ and b.rank < 3 and b.start < s.stop and s.start < b.stop)),
    owners as (select held, text, min(source) as owner from kept join d using (row_) group by 1, 2),
    counts as (select held, count(*) as repositories, count(distinct owner) as owners from owners group by 1),
    judged as (select kept.*, repositories, owners, not (repositories >= {EXAMPLE_REPOSITORIES} and owners >= {EXAMPLE_OWNERS}) as live, kind || ':' || cast(start as bigint) || ':' || cast(stop as bigint) as name from kept join counts using (held)),
    rows_ as (select row_, count(*) filter (rank = 0) as n_assign, count(*) filter (rank = 1) as n_access, count(*) filter (rank = 2) as n_hex, coalesce(string_agg(name, ',' order by start, rank) filter (rank < 3), '') as base,
      string_agg(name, ',' order by start, rank) as spans, count(*) filter (not live) as n_examples, string_agg(repositories, ',' order by start, rank) as repositories, string_agg(owners, ',' order by start, rank) as owners from judged where rank < 3 or live group by 1)
    select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_examples, 0) as n_examples, coalesce(repositories, '') as repositories, coalesce(owners, '') as owners
    from d left join rows_ using (row_)"""


ORACLE_SQL = {"op5_secrets": _sql()}
