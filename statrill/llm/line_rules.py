"""Line-first cleaning: rules judge each line, lines that fail go, and documents that lose too much of their text are rejected.
DataFrame functions only, each document on its own.

A line with a word fails, for the first of these reasons, by
- navigation: one word of SEPARATORS or more for every LINKS words, or nothing but an entry of MENU;
- boilerplate: it holds one of PHRASES;
- punctuation: a run of two or more of SYMBOLS for MARKED of its words (the share, at least), or no sentence mark at its end
  nor at the end of any word in it.
A document is kept if MOST_LOST percent of its characters in words, at most, go with such lines, it has LEAST_WORDS words, and
at most MOST_REPEATED percent of them lie in three words in a row that stand in it twice or more.

Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return; lines end at a line feed.
Null texts count as empty, which have no word and are not kept. Repeated rows give repeated results; very long texts are read
whole. An empty table gives an empty one. Other columns are kept, whatever their names, and give way to columns of the result
of the same name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LEAST_WORDS, MOST_REPEATED, MOST_LOST = 50, 50, 50
LINKS, MARKED = 5, 0.3
WORD, BLANKS, COUNTED = r"[^\x20\x09-\x0D]", " \t\n\x0b\f\r", "#*$%&|<>"
SEPARATORS, SYMBOLS = r"[|»›•·→/]", r"[#*$%&<>@^~=+_|!?]{2,}"
END, WITHIN = r"[.!?…][\"'”’»)\]]*[\x20\x09-\x0D]*$", r"[.!?…:;][\"'”’»)\]]*[\x20\x09-\x0D]"
#: Entries of menus, and wordings that are about a page and not its text.
MENU = ("home", "menu", "search", "about us", "contact us", "log in", "sign in", "sign up", "register", "next page", "previous page", "back to top", "skip to content", "read more", "share this", "print this page")
PHRASES = ("lorem ipsum", "enable javascript", "privacy policy", "terms of use", "terms of service", "cookie policy", "uses cookies", "click here to", "subscribe to our newsletter", "all rights reserved. powered by")
REASONS = ("navigation", "boilerplate", "punctuation")


def _either(phrases: tuple[str, ...]) -> str:
    """A pattern of phrases in either case of a to z, spelt out: engines fold other letters differently."""
    return "|".join("".join(f"[{x.upper()}{x}]" if x.isalpha() else "[.]" if x == "." else x for x in p) for p in phrases)


MENU_LINE, PHRASE = rf"^[\x20\x09-\x0D]*({_either(MENU)})[\x20\x09-\x0D]*$", _either(PHRASES)


def _judged_lines(text: Column, whole: bool) -> Column:
    """Array of line, worded (it has a word), fault (a reason or null). A text without separators, symbols and phrases (not
    `whole`) is spared the rules that look for them."""
    unmarked = lambda line: ~(F.rlike(line, F.lit(END)) | F.rlike(line, F.lit(WITHIN)))
    menu = lambda line: F.rlike(line, F.lit(MENU_LINE))

    def fault(line: Column, n: Column) -> Column:
        several = lambda pattern: F.regexp_count(line, F.lit(pattern)) * LINKS >= n
        out = F.when(n == 0, F.lit(None)).when(menu(line) | several(SEPARATORS) & several(rf"(?:^|[\x20\x09-\x0D]){SEPARATORS}(?:[\x20\x09-\x0D]|$)"), REASONS[0])
        return out.when(F.rlike(line, F.lit(PHRASE)), REASONS[1]).when((F.regexp_count(line, F.lit(SYMBOLS)) >= MARKED * n) | unmarked(line), REASONS[2])

    each = F.split(text, "\n")
    if whole:
        each = F.transform(each, lambda x: F.struct(x.alias("line"), F.regexp_count(x, F.lit(WORD + "+")).alias("n")))
        return F.transform(each, lambda x: F.struct(x["line"].alias("line"), (x["n"] > 0).alias("worded"), fault(x["line"], x["n"]).alias("fault")))
    plain = lambda x, there: F.when(~there, F.lit(None)).when(menu(x), REASONS[0]).when(unmarked(x), REASONS[2])
    each = F.transform(each, lambda x: F.struct(x.alias("line"), F.rlike(x, F.lit(WORD)).alias("worded")))
    return F.transform(each, lambda x: F.struct(x["line"].alias("line"), x["worded"].alias("worded"), plain(x["line"], x["worded"]).alias("fault")))


def _without(text: Column, characters: str) -> Column:
    for x in characters:
        text = F.replace(text, F.lit(x), F.lit(""))
    return text


def judged(docs: DataFrame) -> DataFrame:
    """The documents with n_words, word_chars (code points in words), n_symbols (characters of COUNTED), n_dup_lines,
    n_repeat_words, base_failed, n_navigation, n_boilerplate, n_punctuation (lines that fail), cleaned (the text without
    them), kept_chars (code points in its words), kept."""
    new = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *(f"n_{x}" for x in REASONS), "cleaned", "kept_chars", "kept")
    others = [c for c in docs.columns if c not in new]
    out = docs.select(F.struct(*others).alias("row_"), F.coalesce("text", F.lit("")).alias("text_"))
    out = out.withColumn("words_", F.regexp_extract_all("text_", F.lit(WORD + "+"), F.lit(0)))
    lower = F.lower("text_")
    marks = F.rlike("text_", F.lit(f"{SEPARATORS}|{SYMBOLS}")) | reduce(Column.__or__, [lower.contains(x) for x in PHRASES])
    out = out.withColumn("lines_", F.when(marks, _judged_lines(F.col("text_"), True)).otherwise(_judged_lines(F.col("text_"), False)))
    failing = lambda reason: F.size(F.filter("lines_", lambda x: x["fault"] == reason)).cast("long").alias(f"n_{reason}")
    worded = F.transform(F.filter("lines_", lambda x: x["worded"]), lambda x: x["line"])
    stay = F.array_join(F.transform(F.filter("lines_", lambda x: x["fault"].isNull()), lambda x: x["line"]), "\n")
    word = lambda i: F.get("words_", i)
    three = F.transform(F.slice("words_", 1, F.size("words_") - 2), lambda w, i: F.xxhash64(w, word(i + 1), word(i + 2)))
    other = F.transform(F.slice("words_", 1, F.size("words_") - 2), lambda w, i: F.xxhash64(word(i + 2), F.lit(7), w, word(i + 1)))
    # from here on rows carry no more than is needed, as every step copies them
    out = out.select(
        "row_", F.size("words_").cast("long").alias("n_words"), F.length(F.array_join("words_", "")).cast("long").alias("word_chars"), F.regexp_count("text_", F.lit(f"[{COUNTED}]")).cast("long").alias("n_symbols"),
        (F.size(worded) - F.size(F.array_distinct(worded))).cast("long").alias("n_dup_lines"), stay.alias("cleaned"), *map(failing, REASONS), "words_", F.when(F.size("words_") > 3, three).alias("three_"),
    )
    kept = [c for c in out.columns if c not in ("three_", "words_")]
    # only what stands twice needs its places, so most texts are not sorted; there, words are known by 128 bits
    placed = F.transform(F.arrays_zip(F.col("three_").alias("a"), other.alias("b")), lambda x, i: F.struct(x["a"].alias("a"), x["b"].alias("b"), i.alias("at")))
    out = out.select(*kept, F.when(F.size(F.array_distinct("three_")) < F.size("three_"), F.sort_array(placed)).alias("sorted_"))
    same = lambda x, i: F.coalesce((F.get("sorted_", i)["a"] == x["a"]) & (F.get("sorted_", i)["b"] == x["b"]), F.lit(False))
    repeated = F.filter("sorted_", lambda x, i: same(x, i - 1) | same(x, i + 1))
    out = out.select(*kept, F.sort_array(F.transform(repeated, lambda x: x["at"])).alias("at_"))
    covered = F.aggregate(F.zip_with("at_", F.slice("at_", 2, F.size("at_")), lambda a, b: F.least(F.lit(3), b - a)), F.lit(0), lambda n, x: n + x)
    out = out.select(*kept, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    none = reduce(Column.__add__, [F.col(f"n_{x}") for x in REASONS]) == 0
    out = out.withColumn("kept_chars", F.when(none, F.col("word_chars")).otherwise(F.length(_without(F.col("cleaned"), BLANKS)).cast("long")))
    out = out.withColumn("kept", ~F.col("base_failed") & (100 * F.col("kept_chars") >= (100 - MOST_LOST) * F.col("word_chars")))
    return out.select(*[F.col("row_").getField(c).alias(c) for c in others], *new)


def accepted(docs: DataFrame) -> DataFrame:
    """The documents that are kept, without the lines that fail; n_chars, if there, follows."""
    out = judged(docs.select(F.struct(*docs.columns).alias("whole_"), "text")).where("kept").select("whole_", "cleaned")
    size = {"n_chars": F.length("cleaned").cast(dict(docs.dtypes)["n_chars"])} if "n_chars" in docs.columns else {}
    return out.select(*[{"text": F.col("cleaned"), **size}.get(c, F.col("whole_").getField(c)).alias(c) for c in docs.columns])


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *(f"n_{x}" for x in REASONS), "kept_chars")


def _sql() -> str:
    q = lambda x: "'" + x.replace("'", "''") + "'"
    n = lambda text, pattern: f"len(regexp_extract_all({text}, {q(pattern)}))"
    solid = lambda x: f"length(regexp_replace({x}, '[\\x20\\x09-\\x0D]', '', 'g'))"
    whole = rf"(?:^|[\x20\x09-\x0D]){SEPARATORS}(?:[\x20\x09-\x0D]|$)"
    return f"""
    with d as (select row_number() over () as row_, doc_id, coalesce(text, '') as text from documents),
    words as (select row_, generate_subscripts(ws, 1) as at_, unnest(ws) as word from (select row_, regexp_extract_all(text, {q(WORD + '+')}) as ws from d)),
    threes as (select *, case when lead(word, 2) over w is not null then word || ' ' || lead(word) over w || ' ' || lead(word, 2) over w end as three from words window w as (partition by row_ order by at_)),
    twice as (select *, three is not null and count(*) over (partition by row_, three) > 1 as hit from threes),
    covered as (select row_, count(*) as n_words, count(*) filter (c) as n_repeat_words from (select row_, hit or coalesce(lag(hit) over w, false) or coalesce(lag(hit, 2) over w, false) as c from twice window w as (partition by row_ order by at_)) group by 1),
    split as (select row_, generate_subscripts(ls, 1) as at_, unnest(ls) as line from (select row_, string_split(text, chr(10)) as ls from d)),
    measured as (select *, {n('line', WORD + '+')} as n from split),
    lines as (select *, case when n = 0 then null when regexp_matches(line, {q(MENU_LINE)}) or {n('line', SEPARATORS)} * {LINKS} >= n and {n('line', whole)} * {LINKS} >= n then '{REASONS[0]}' when regexp_matches(line, {q(PHRASE)}) then '{REASONS[1]}'
      when {n('line', SYMBOLS)} >= {MARKED} * n or not (regexp_matches(line, {q(END)}) or regexp_matches(line, {q(WITHIN)})) then '{REASONS[2]}' end as fault from measured),
    by_doc as (select row_, count(*) filter (n > 0) - count(distinct case when n > 0 then line end) as n_dup_lines, {', '.join(f"count(*) filter (fault = '{r}') as n_{r}" for r in REASONS)}, coalesce(sum({solid('line')}) filter (fault is null), 0)::bigint as kept_chars from lines group by 1),
    facts as (select doc_id, coalesce(n_words, 0) as n_words, {solid('text')} as word_chars, length(text) - length(translate(text, {q(COUNTED)}, '')) as n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, {', '.join(f'n_{r}' for r in REASONS)}, kept_chars from d left join covered using (row_) left join by_doc using (row_)),
    failed as (select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words as base_failed from facts)
    select *, not base_failed and 100 * kept_chars >= {100 - MOST_LOST} * word_chars as kept from failed"""


ORACLE_SQL = {"op11_quality_rules": _sql()}
