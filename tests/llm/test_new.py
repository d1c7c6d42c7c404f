"""Quality rules, fill-in-middle and conversation repair against brute force."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from statrill.llm import conversations, fill_middle, line_rules

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
sha = lambda x: hashlib.sha256(x.encode("utf-8")).hexdigest()


def documents(spark, folder, rows):
    spark.createDataFrame([(i, t, "en", 1, 1) for i, t in rows], "doc_id long, text string, `N` string, row_ int, key_ int").write.parquet(f"{folder}/documents.parquet")
    return folder


# Quality rules


def base(text):
    words, lines = WORDS.findall(text), [x for x in text.split("\n") if WORDS.search(x)]
    threes = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {k + j for k in range(len(words) - 2) if threes[tuple(words[k : k + 3])] > 1 for j in range(3)}
    n = len(words)
    return n, sum(map(len, words)), sum(text.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_measures_are_those_of_brute_force(spark, tmp_path):
    rng = random.Random(21)
    word = lambda: rng.choice(["the", "a", "and", "über", "😀", "x|y", "**", "50%", "end.", "Why?", "|", "cookie", " ", "privacy policy"])
    texts = ["".join(word() + rng.choice([" ", " ", " ", "\n", "\t", "\n\n", "\r\n"]) for _ in range(rng.randint(0, 120))) for _ in range(300)]
    texts += [None, "", " ", "\n", "a", "a b c", "a b c a b c", "same same same same", "x" * 50_000, "w " * 30_000, "Home\nAbout us\n", "Lorem IPSUM dolor.\n"]
    rows = list(enumerate(texts)) + [(5, texts[5]), (None, texts[6])]
    got = line_rules.op11_quality_rules(spark, documents(spark, str(tmp_path), rows)).collect()
    assert len(got) == len(rows)
    whole = {i: base(t or "") for i, t in rows}
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == whole[r.doc_id], texts[r.doc_id or 6]
        assert not (r.kept and r.base_failed) and r.kept_chars <= r.word_chars


def test_lines_that_fail_go_and_what_is_left_decides(spark):
    rng = random.Random(22)
    prose = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(12)) + "."
    good = [prose() for _ in range(6)]
    bad = ["Home | News | Sport | About", "about us", "read more about our privacy policy here.", "Well*** that&&& is%%% odd$$$ and### more.", "no end to this line", "SO!! MANY!! MARKS!! HERE!!"]
    mixed = "\n".join(x for pair in zip(good, bad, strict=True) for x in pair)
    lost = "\n".join([*good[:5], *[" ".join(x + " |" for x in prose().split()) for _ in range(6)]])
    df = spark.createDataFrame([(0, "\n".join(good), 1, 7), (1, mixed, 1, 7), (2, lost, 1, 7), (3, None, 1, 7)], "doc_id long, text string, cleaned int, n_chars int")
    rows = {r.doc_id: r for r in line_rules.judged(df).collect()}
    assert rows[0].kept and rows[0].kept_chars == rows[0].word_chars and rows[0].cleaned == "\n".join(good)
    assert rows[1].kept and rows[1].cleaned == "\n".join(good) and (rows[1].n_navigation, rows[1].n_boilerplate, rows[1].n_punctuation) == (2, 1, 3)
    assert not rows[2].kept and not rows[2].base_failed and rows[2].n_navigation == 6 and rows[2].cleaned == "\n".join(good[:5])
    assert not rows[3].kept and rows[3].n_words == 0
    left = line_rules.accepted(df)
    assert left.dtypes == df.dtypes and sorted((r.doc_id, r.text, r.cleaned, r.n_chars) for r in left.collect()) == [(i, "\n".join(good), 1, len("\n".join(good))) for i in (0, 1)]
    ends = ["It said: “Go.”", "(It is so.)", "Wait…", "Is it?  ", "Off it goes: 5 of"]
    seen = line_rules.judged(spark.createDataFrame([(0, "\n".join(ends))], "doc_id long, text string")).first()
    assert seen.cleaned == "\n".join(ends)


# Fill-in-middle


def brute(doc_id, text):
    h = [int(sha(f"42:{'' if doc_id is None else doc_id}")[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = UNITS.findall(text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("hot", [256, 2])
def test_cuts_are_those_of_brute_force(spark, tmp_path, monkeypatch, hot):
    """Also with groups of copies dealt to several tasks, and markers that only seem to be there."""
    monkeypatch.setattr(fill_middle, "HOT", hot)
    rng = random.Random(23)
    word = lambda: rng.choice(["a", "bc", "über", "😀", "<", "<P", "S>", "<<S", "M>", " ", " ", "x" * 300])
    texts = ["".join(word() + rng.choice([" ", "  ", "\n", "\t", "", "\x0b"]) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    texts += [None, "", " ", " \n ", "a", " a", "a ", "with <P> in it", "with <M> in it", "ab " * 20_000, "z" * 70_000] + [texts[3]] * 60
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[4]), (2**60 + 1, texts[5])]
    got = fill_middle.op12_fill_middle(spark, documents(spark, str(tmp_path), rows)).collect()
    assert len(got) == len(rows)
    want = {i: brute(i, t or "") for i, t in rows}
    text_of = {i: t or "" for i, t in rows}
    for r in got:
        n, form, prefix, middle, output = want[r.doc_id]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, prefix, middle, sha(output), sha(text_of[r.doc_id])), text_of[r.doc_id][:80]
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_columns_of_any_name_and_other_settings(spark):
    df = spark.createDataFrame([(i, t, 5, "k", 1) for i, t in [(1, "one two three"), (2, None), (3, "one two three")]], "doc_id long, text string, n int, key_ string, Text_ int".replace("Text_", "`index_`"))
    rows = sorted(fill_middle.transformed(df, seed=7, rate=100, spm=0).collect())
    assert [(r.doc_id, r.text, r.key_, r.index_, r.form, r.restored) for r in rows] == [(1, "one two three", "k", 1, "psm", "one two three"), (2, None, "k", 1, "plain", ""), (3, "one two three", "k", 1, "psm", "one two three")]
    assert all(r.output.startswith("<P>") and r.n == 3 for r in rows if r.text) and fill_middle.transformed(df.limit(0)).count() == 0


def test_lists_select_every_number():
    rng = np.random.default_rng(24)
    for _ in range(200):
        ends = np.unique(rng.integers(1, int(rng.integers(2, 5000)), int(rng.integers(1, 300))))
        packed = fill_middle.listed(ends)
        assert [fill_middle.selected(packed, len(ends), k) for k in range(len(ends) + 1)] == [0, *ends.tolist()]
        mean = ends[-1] / len(ends)
        assert 8 * (len(packed) - 4) <= len(ends) * (2 + np.log2(mean) + 1)
    assert fill_middle.listed(np.zeros(0, np.int64)) == b""


# Conversations


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text, role = {1: "", 2: re.sub("[.!?]", "", text)}.get(k, text), "user" if k == 4 else role
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(k, 1)
    return out


def repair(turns):
    """turns: (turn, role, text) in order. All edits by rising cost, then audit, until the first that ends well."""
    seen, faults = set(), []
    for _, role, text in turns:
        said = text.strip(" \t\n\x0b\f\r")
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None)
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, out = heapq.heappop(heap)
        if not re.fullmatch("(s?(ua)*u?)?", roles):
            continue
        if i == len(turns) and re.fullmatch("(s?(ua)+)?", roles):
            return faults, cost, audit, out
        state = (i, roles[-1:])  # what may follow depends on the last role alone; the first to come is the least
        if state in done:
            continue
        done.add(state)
        for x in ("user", "assistant"):
            heapq.heappush(heap, (cost + 2, audit + "I", i, roles + x[0], (*out, (x, ""))))
        if i < len(turns):
            _, role, text = turns[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, roles, out))
            if faults[i] in (None, "truncated"):
                extra = int(faults[i] is not None)
                if role:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, roles + role[0], (*out, (role, text))))
                for x in ("user", "assistant"):
                    heapq.heappush(heap, (cost + extra + 2, audit + "R", i + 1, roles + x[0], (*out, (x, text))))


def write_turns(spark, folder, rows):
    spark.createDataFrame([(*r, 1, 1) for r in rows], "conv_id long, turn long, role string, text string, `AT` int, cost int").repartition(3).write.parquet(f"{folder}/conversations.parquet")
    return folder


def test_repairs_are_the_cheapest(spark, tmp_path):
    rng = random.Random(25)
    rows = []
    for conv in [None, *range(260)]:
        turn = rng.randint(-2, 3)
        for _ in range(rng.randint(1, 9)):
            rows.append((conv, None if rng.random() < 0.05 else turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "sage", "ü"]), rng.choice(["Yes.", "No!", "So it is", "  ", None, "", "Why? ", "Übel.\n", "a. ", "end.\x0b"])))
            turn += rng.choice([1, 1, 1, 0, 2])
    rows += [(1000, k, ("user", "assistant")[k % 2], f"Turn {k}.") for k in range(300)] + [(1001, 5, "user", "x" * 50_000 + ".")] * 2
    gone = next(c for c in range(2000, 3000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "Hello."))
    got = {r.conv_id: r for r in conversations.op13_conversation_repair(spark, write_turns(spark, str(tmp_path), rows)).collect()}
    assert set(got) == {r[0] for r in rows}
    spoilt, letters = damaged(rows), Counter()
    for conv, r in got.items():
        turns = sorted(((t, role, text) for c, t, role, text in spoilt if c == conv), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        faults, cost, audit, out = repair(turns)
        known = [t for t, *_ in turns if t is not None]
        initials = [role[:1] for _, role, _ in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        assert (r.gaps, r.illegal) == (max(known) - min(known) + 1 - len(set(known)) if known else 0, illegal)
        assert [r[x] for x in conversations.FAULTS] == [faults.count(x) for x in conversations.FAULTS]
        assert (r.cost, r.audit) == (cost, audit), turns
        assert r.repaired_sha256 == sha("\n".join(f"{a}:{b}" for a, b in out))
        letters.update(audit)
    assert got[gone].audit == "" and got[gone].repaired_sha256 == sha("") and set(letters) == set("DIKR")


def test_repair_keeps_texts_and_takes_empty_tables(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Well?"), (2, 0, "assistant", "So.")], "conv_id long, turn int, role string, text string")
    rows = {r.conv_id: r for r in conversations.repaired(df).collect()}
    assert (rows[1].cost, rows[1].audit) == (2, "KR") and [tuple(x) for x in rows[1].repaired] == [("user", "Hi."), ("assistant", "Well?")]
    assert (rows[2].cost, rows[2].audit) == (2, "IK") and [tuple(x) for x in rows[2].repaired] == [("user", ""), ("assistant", "So.")]
    assert conversations.repaired(df.limit(0)).count() == 0
