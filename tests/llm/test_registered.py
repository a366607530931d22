"""The registered queries whose results SQL can't tell: against libraries, brute force and definitions."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from docquarry.llm import queries as q

from ..conftest import SF
from .test_llm import brute_tree, removed


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    """A folder with a documents table of odd rows: nulls, empty texts, copies, and a text of several megabytes."""
    folder = str(tmp_path_factory.mktemp("odd"))
    many = " ".join(f"token{i * 7919 % 100003} of {i}" for i in range(150_000))
    rows = [(0, None), (1, ""), (2, "One two. " * 20), (3, "One two. " * 20), (4, many), (5, "é日本 " * 30), (6, many[1_000_000:1_002_000]), (7, " \t"), (8, "a\x00b" * 40), (9, "ONE two. " * 20)]
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return folder, {i: t or "" for i, t in rows}


@pytest.fixture(params=["sf", "odd"])
def case(request, texts, odd_dir):
    return (SF, texts) if request.param == "sf" else odd_dir


def test_op1(spark, case):
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(q.tokenizer_file("byte_bpe_50k.json").decode())
    want = {(i, len(t.encode()), n := len(library.encode(t, add_special_tokens=False)), n > 512) for i, t in case[1].items()}
    assert {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in q.op1_token_counts(spark, case[0]).collect()} == want


def test_op2(spark, case):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {(i, len(ids := library.encode(t)), sha(",".join(map(str, ids)).encode()), sha(library.decode(ids).encode())) for i, t in case[1].items()}
    assert {tuple(r) for r in q.op2_sentencepiece(spark, case[0]).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()} == want


def test_op3(spark, case):
    rows = q.op3_resharding(spark, case[0]).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in case[1].items())
    loads, largest = Counter(), max(r.size for r in rows)
    for shard in {r.shard for r in rows}:
        own = [r for r in rows if r.shard == shard]
        assert 0 <= shard < 8 and sorted(r.slot for r in own) == list(range(len(own)))
        loads[shard] = sum(r.size for r in own)
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    assert max(loads.values()) - min(loads[s] for s in range(8)) <= 2 * largest


def test_op5(spark, case):
    want = {}
    for i, x in removed(list(case[1].items())).items():
        (kept, gone), = x
        want[i] = (len(case[1][i].encode()), gone, sha(kept))
    rows = q.op5_suffix_dedup(spark, case[0]).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in rows} == want and len(rows) == len(want)
    assert all((r.n_spans > 0) == (r.n_removed > 0) and 50 * r.n_spans <= r.n_removed for r in rows)


def test_op7(spark, case):
    texts = {i: t.encode().lower() for i, t in case[1].items()}  # other letters than A-Z have no upper case in these bytes
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = Counter(w for i, t in texts.items() if not held[i] for w in t.split())
    ends = sum(not h for h in held.values())
    total, distinct = sum(counts.values()) + ends, len(counts) + 1
    rows = q.op7_context_tree(spark, case[0]).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = texts[r.doc_id].split()
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(words) + 1, sum(counts[w] > 0 for w in words) + 1, total)
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words) + math.log10((ends + 1) / (total + distinct + 1))
        assert abs(r.base_score - base) < 1e-6 * abs(base) and r.score < 0


def test_op7_scores(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(["The cat sat on the mat.", "the cat sat", "", None, "Ünïcode é", "dogs and cats and dogs"] * 6)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    raw = [(t or "").encode().replace(b"T", b"t").replace(b"D", b"d") for _, t in rows]
    want = brute_tree(raw, [t for i, t in enumerate(raw) if zlib.crc32(str(i).encode()) % 7 != 2])
    got = {r.doc_id: r.score for r in q.op7_context_tree(spark, str(tmp_path)).collect()}
    assert np.allclose([got[i] for i in range(len(rows))], want, rtol=1e-9)


def test_op9(spark):
    """Held-out accuracy on few rows, and scores that follow from texts alone."""
    folder = SF.replace("0.001", "0.01")
    rows = {r.doc_id: r for r in q.op9_toxicity(spark, folder).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").where("toxic is not null").collect()}
    held = [(labels[i], r.predicted) for i, r in rows.items() if r.held_out and i in labels]
    assert len(rows) == 1000 and len(held) > 30 and sum(a == b for a, b in held) / len(held) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    texts = {}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        texts.setdefault(r.text, set()).add(rows[r.doc_id].score)
    assert all(len(s) == 1 for s in texts.values())


def test_op9_finds_the_toxic_ones(spark):
    """Precision and recall on held-out rows: calling nothing toxic, or everything, fails."""
    folder = SF.replace("0.001", "0.1")
    rows = q.op9_toxicity(spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet").where("toxic is not null").select("doc_id", "toxic"), "doc_id").collect()
    toxic, called = [r for r in rows if r.toxic == 1], [r for r in rows if r.predicted == 1]
    both = sum(r.predicted for r in toxic)
    assert len(toxic) > 50 and both >= 0.6 * len(toxic) and both >= 0.9 * len(called)
    ranked = sorted(rows, key=lambda r: -r.score)
    found = [i for i, r in enumerate(ranked, 1) if r.toxic == 1]
    assert sum(k / i for k, i in enumerate(found, 1)) / len(found) > 0.75  # average precision; chance: the toxic share, about an eighth
