"""The registered queries and the pipeline's stages on odd and empty tables, and against brute force."""

import hashlib
import random
import re
import unicodedata

import pytest

from statrill.llm import pii, queries, spotsigs
from statrill.llm.common import free

pytest.importorskip("public_tokenizers")
BIG = 2**60
ROWS = [(BIG + 1, "one text that is here for this test"), (None, "one text that is here for this test"), (BIG + 3, None), (BIG + 5, ""), (BIG + 5, ""), (7, "word " * 20_000), (8, "x" * 60_000), (9, "a b"), (10, "é\u0000퟿😀 token=abcdefgh"), (None, None)]
#: Names that operators use for columns of their own, some in another case.
CLASHING = ("row_", "Removed", "live_", "key_", "score", "class", "hash", "id", "group_", "cell_", "at_", "spans", "print_", "class_id", "share_", "n_")


def tables(spark, folder, rows):
    df = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", None if t is None else len(t), *[k] * len(CLASHING)) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASHING))
    df.coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in rows] + [(7, None, None)] * bool(rows), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(i, [1.0, float(k)]) for k, (i, _) in enumerate(rows)], "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    turns = [(i, k, r, t) for i, _ in rows for k, (r, t) in enumerate([("user", "Hello?"), ("assistant", "Hi."), (None, None), ("user", "Hi."), ("assistant", "x" * 50_000)])] + [(7, None, "user", "Late.")] * (2 * bool(rows))
    spark.createDataFrame([(*t, 1, 1) for t in turns], "conv_id long, turn long, role string, text string, `at` int, `Fault` int").write.parquet(f"{folder}/conversations.parquet")
    return folder


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return tables(spark, str(tmp_path_factory.mktemp("odd")), ROWS)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return tables(spark, str(tmp_path_factory.mktemp("empty")), [])


@pytest.mark.parametrize("name", queries.QUERIES)
def test_every_row_keeps_its_id(spark, odd, name):
    """Ids that no double holds, beside nulls, very long and empty texts, repeated rows and columns of clashing names."""
    rows = queries.QUERIES[name](spark, odd).collect()
    order = lambda ids: sorted(ids, key=lambda x: (x is None, x or 0))
    if name.startswith("op6_"):
        assert {r.query_id for r in rows} == {i for i, _ in ROWS if i is not None and i % 50 == 0} and not any(r.vec_id is None for r in rows)
    elif name.startswith("op13_"):
        assert order(r.conv_id for r in rows) == order({i for i, _ in ROWS})
    elif name.startswith("op10_"):
        assert set(r.doc_id for r in rows) == {i for i, _ in ROWS} and sum(r.piece == 0 for r in rows) == len(ROWS)
    else:
        assert order(r.doc_id for r in rows) == order(i for i, _ in ROWS)


@pytest.mark.parametrize("name", queries.QUERIES)
def test_empty_tables_give_none(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


def test_stages_keep_columns_of_any_name(spark, odd, empty):
    import corpus_pipeline

    for folder in (odd, empty):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        held = {r["row_"]: r.asDict() for r in docs.collect()}
        for name, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, docs, folder)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
            for r in out.collect():
                assert all(r[c] == held[r["row_"]][c] for c in docs.columns if c not in ("text", "n_chars")), name
    assert corpus_pipeline.run(spark, empty).count() == 0
    assert free(docs, "removed") == "removed_" and free(docs, "new") == "new"


def luhn(digits):
    total = 0
    for i, x in enumerate(reversed(digits)):
        n = int(x) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def personal(text):
    """Base spans by the contract's patterns, by kind and start."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15]


def test_personal_data_is_that_of_brute_force(spark, tmp_path):
    rng = random.Random(12)
    some = lambda alphabet, a, b: "".join(rng.choice(alphabet) for _ in range(rng.randint(a, b)))

    def card(n):
        body = some("0123456789", n - 1, n - 1)
        whole = next(body + x for x in "0123456789" if luhn(body + x))
        return rng.choice(["", " ", "-"]).join(whole[i : i + 4] for i in range(0, n, 4))

    def piece():
        return rng.choice([lambda: card(rng.randint(13, 20)), lambda: some("ab.%+-@", 1, 8) + "@" + some("a-.", 1, 6), lambda: some("0123456789.", 4, 20), lambda: "+" + some("0123456789 ().-", 5, 22), lambda: ".".join(str(rng.randint(0, 300)) for _ in range(rng.randint(3, 5))), lambda: some("0123456789- ", 12, 30), lambda: "é😀", lambda: "DE89 3704 0044 0532 0130 00"])()

    rows = [(i, rng.choice([" ", "", "\n", "."]).join(piece() for _ in range(rng.randint(1, 7)))) for i in range(400)] + [(400, None), (401, "")]
    got = {r.doc_id: r for r in queries.QUERIES["op9_pii"](spark, tables(spark, str(tmp_path), rows)).collect()}
    seen = set()
    for i, text in rows:
        want = personal(text or "")
        seen |= {x[0] for x in want}
        listed = [":".join(map(str, x)) for x in want]
        assert got[i].base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest(), text
        assert [got[i][f"n_{k}"] for k in pii.BASE] == [sum(x[0] == k for x in want) for k in pii.BASE]
        assert set(listed) <= set(got[i].spans.split(",")) | {""} and len(got[i].scores.split(",")) == len(got[i].spans.split(","))
    assert seen == set(pii.BASE)


def test_fingerprints_are_those_of_brute_force(spark, tmp_path, monkeypatch):
    """Edited texts, likenesses and classes, with documents in several ranges of doc_id."""
    monkeypatch.setattr(spotsigs, "RANGE_ROWS", 25)
    rng = random.Random(13)
    word = lambda: rng.choice(["is", "the", "that", "with", "for", *("w" + str(i) for i in range(30)), "Ünï", "😀,"])
    texts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(90)]
    for _ in range(40):
        words = rng.choice(texts).split(" ")
        words[rng.randrange(len(words))] = word()
        texts.append(" ".join(words))
    texts += [None, None, texts[3]]
    ids = rng.sample(range(10**6), len(texts))
    got = {r.doc_id: r for r in queries.QUERIES["op2_spot_signatures"](spark, tables(spark, str(tmp_path), list(zip(ids, texts, strict=True)))).collect()}
    order = sorted(zip(ids, (t or "" for t in texts), strict=True), reverse=True)
    prints = {}
    signs = lambda x: frozenset(x[i : i + 8] for i in range(0, len(x), 8))
    like = lambda a, b: len(a & b) / len(a | b)
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[1][:half]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        prints[i] = signs(got[i].fingerprint)
        assert got[i].near_edited == pytest.approx(like(prints[i], signs(got[i].edited_fingerprint))) and got[i].near_next == pytest.approx(like(prints[i], signs(got[after[0]].fingerprint)))
        assert got[i].fingerprint == spotsigs.fingerprint(spotsigs.signatures(unicodedata.normalize("NFC", text)))
    up = {i: i for i in prints}

    def root(i):
        return i if up[i] == i else root(up[i])

    for i in prints:
        for j in prints:
            if i < j and like(prints[i], prints[j]) >= 0.8 - 1e-9:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    assert {i: r.class_id for i, r in got.items()} == {i: root(i) for i in prints} and len({root(i) for i in prints}) < len(prints) - 10


def test_quality_of_held_out_documents(spark):
    """Labels that no fit has seen: their ranks, and what the threshold keeps."""
    from pathlib import Path

    folder = "/root/testdata/sf0.01"
    if not Path(folder).exists():
        pytest.skip("no generated tables")
    scores = queries.QUERIES["op7_quality"](spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").select("score", "quality", "predicted").collect()
    good, bad = ([r for r in scores if r.quality == k] for k in (1, 0))
    assert sum((a.score > b.score) + 0.5 * (a.score == b.score) for a in good for b in bad) >= 0.97 * len(good) * len(bad)
    assert sum(r.predicted for r in good) >= 0.98 * len(good) and sum(r.predicted for r in bad) <= 0.5 * len(bad)
