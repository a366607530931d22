"""The pipeline's stages, each held against brute force on its own input."""

import hashlib
import re

import pytest

import corpus_pipeline
from docquarry.llm import queries as q
from docquarry.llm.common import materialise

from ..conftest import SF
from .test_llm import brute_groups, removed

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output rows of every stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        result = materialise(stage(spark, docs, SF), f"test-{name}")
        out[name] = (docs.collect(), result.collect(), result.columns)
        docs = result
    return out


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near-duplicates", "suffix-dedup", "decontamination", "sentencepiece"]
    for name, (_, _, columns) in stages.items():
        assert name == "sentencepiece" or columns == COLUMNS


def test_toxic_documents_go(spark, stages):
    before, after, _ = stages["toxicity"]
    called = {r.doc_id for r in q.op9_toxicity(spark, SF).where("predicted = 1").collect()}
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == called


def test_one_of_each_group_stays(stages):
    before, after, _ = stages["near-duplicates"]
    groups = brute_groups([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in after) == sorted(i for i, _, least in groups if i == least)


def test_passages_are_removed(stages):
    before, after, _ = stages["suffix-dedup"]
    want = {i: x[0][0].decode("utf-8", "ignore") for i, x in removed([(r.doc_id, r.text) for r in before]).items()}
    assert {r.doc_id: r.text for r in after} == want
    assert all(r.n_chars == len(r.text) for r in after)


def test_contaminated_documents_go(spark, stages):
    before, after, _ = stages["decontamination"]
    words = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[s : s + 10]) for s in range(max(len(w) - 9, 1))} if w else set()
    lengths = {len(x) for x in windows}
    bad = {r.doc_id for r in before if any(tuple(w[s : s + n]) in windows for w in [words(r.text)] for n in lengths for s in range(len(w) - n + 1))}
    assert bad and {r.doc_id for r in before} - {r.doc_id for r in after} == bad


def test_texts_are_encoded(stages):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    before, after, _ = stages["sentencepiece"]
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = set()
    for r in before:
        ids = library.encode(r.text)
        want.add((r.doc_id, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids))))
    assert {tuple(r) for r in after} == want


def test_run(spark, stages):
    got = {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {tuple(r) for r in stages["sentencepiece"][1]}


def test_odd_rows(spark):
    """Nulls, empty texts, repeated rows and ids, ties, and extra columns with the names of columns that operators make: each stage's rows, by its definition."""
    long = " ".join(f"word{i * i % 97}" for i in range(400))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    texts = [(1, None), (2, ""), (None, "x"), (3, long), (3, long), (4, long), (5, long + " more"), (6, "Start " + item), (6, "Start " + item), (7, "ab " * 40 + "end"), (8, "éé " + "ab " * 40), (9, " \n\t"), (None, long)]
    names = ("key", "id", "score", "kept", "spans", "w", "begin", "ids", "class")
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names)
    odd = spark.createDataFrame([(i, t, None, None, None, *(f"{c}{k}" for c in names)) for k, (i, t) in enumerate(texts)], schema)
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs.collect(), materialise(stage(spark, docs, SF), "test-odd")
            after = docs.collect()
            if name == "sentencepiece":
                assert len(after) == len(before) and docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                continue
            assert docs.columns == odd.columns
            assert {r["key"] for r in after} <= {r["key"] for r in before} and len({r["key"] for r in after}) == len(after)  # no row is doubled, and other columns stay beside their texts
            left = {r["key"]: r for r in after}
            assert all(all(left[r["key"]][c] == r[c] for c in names) for r in before if r["key"] in left)
            if name == "near-duplicates":
                gone = {i for i, _, least in brute_groups([(r.doc_id, r.text) for r in before]) if i is not None and i != least}
                assert sorted(left) == sorted(r["key"] for r in before if r.doc_id not in gone)
            elif name == "suffix-dedup":
                want = {i: sorted(b.decode("utf-8", "ignore") for b, _ in x) for i, x in removed([(r.doc_id, r.text) for r in before]).items()}
                got = {}
                for r in after:
                    got.setdefault(r.doc_id, []).append(r.text)
                assert {i: sorted(x) for i, x in got.items() if i is not None} == want and sorted(got.get(None, [])) == sorted(r.text for r in before if r.doc_id is None)
            elif name == "decontamination" and before:
                assert {r.doc_id for r in before} - {r.doc_id for r in after} == {6}
