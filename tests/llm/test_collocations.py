"""Phrase mining against SQL and a count in the driver, and its odd cases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.llm import collocations as c
from docquarry.llm import queries as q

from ..conftest import SF
from .test_registered import odd_dir, texts  # noqa: F401

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, longest=4, fewest=30, shown=2000):
    """What op12 returns for rows (lang, text)."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(ws)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    found = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= fewest}
        within = lambda p, e: any(e[i : i + len(p)] == p for i in range(len(e) - len(p) + 1))
        best = []
        for p, a in candidates.items():
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            if not any(len(e) > len(p) and 100 * b >= 80 * a and within(p, e) for e, b in candidates.items()):
                best.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        found += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:shown], 1)]
    return sorted(found)


def returned(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_against_sql(spark, duck, same):
    same(q.op12_collocations(spark, SF), duck, q.oracle_sql()["op12_collocations"])


def test_odd_texts(spark, odd_dir):  # noqa: F811
    """A text of several megabytes, nulls and repeated rows among them."""
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{odd_dir[0]}/documents.parquet").collect()]
    assert returned(q.op12_collocations(spark, odd_dir[0])) == brute(rows)


@pytest.mark.parametrize("gathered", [c.GATHERED, 50])
def test_whole_groups(spark, monkeypatch, gathered):
    """Few words, so that everything is frequent: cuts, ties, extensions, blanks of all kinds, blocks of few n-grams."""
    monkeypatch.setattr(c, "GATHERED", gathered)
    rng = random.Random(3)
    blank = lambda: rng.choice([" ", "  ", "\t", " \t ", ", ", ".", "\n", "\r\n", "\x0b", " é "])
    rows = [(rng.choice(["en", None, "und", "x"]), "".join(rng.choice(["a", "B", "b", "ab", "日本", "c\x00", " "]) + blank() for _ in range(rng.randrange(60)))) for _ in range(150)]
    rows += [("en", None), (None, ""), ("en", " \t.")] + [("x", "one two three four five")] * 31
    frame = spark.createDataFrame(rows, "lang string, text string").withColumn("score", F.lit(1)).repartition(3)
    assert returned(c.collocations(frame, F.col("lang"), fewest=7)) == brute(rows, fewest=7)
    assert returned(c.collocations(frame, F.col("lang"), longest=2, fewest=7, shown=3)) == brute(rows, longest=2, fewest=7, shown=3)
    assert returned(c.collocations(frame.limit(0), F.col("lang"))) == []


def test_scores_past_64_bits(spark):
    rows = [("g", 1, "a", 9 * 10**17), ("g", 1, "b", 8 * 10**17), ("g", 2, "a b", 7 * 10**17)]
    found = c.scored(spark.createDataFrame(rows, "group string, words int, phrase string, a long")).first()
    assert found.score == 2_000_000 * 7 * 10**17 // (17 * 10**17)


def test_hashes_that_meet_are_told_apart(spark):
    """Two phrases that share the first hash are still two."""
    words = c.Words([b"aa bb aa bb cc"], [0], c._seeds(["g"]))
    block = c._Block(1)
    whole, (_, second) = words.grams(1)
    block.add(words, whole, [np.zeros(len(whole), np.uint64), second])
    assert {(r["phrase"], r["a"]) for b in block.rows(["g"]) for r in b.to_pylist()} == {("aa", 2), ("bb", 2), ("cc", 1)}


def test_segments_keep_every_byte(monkeypatch):
    monkeypatch.setattr(c, "AT_ONCE", 10)
    for text in (b"", b"abc", b"abc def. ghi jkl, mno pqr stu vwx yz", b"x" * 50, b"x" * 50 + b".y"):
        assert re.split(rb"[.,;:!?\n\x0b\x0c\r]", b".".join(c._segments(text))) == re.split(rb"[.,;:!?\n\x0b\x0c\r]", text)
