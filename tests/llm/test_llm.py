"""Every operator on edge cases and against brute force or its library."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docquarry.llm import context_tree, decontamination, near_duplicates, resharding, sentencepiece_codec, suffix_dedup, token_counts, topk, toxicity, warc
from docquarry.llm import queries as q
from docquarry.llm.common import Store, shared_path

from ..conftest import SF

#: Documents with every odd case: nulls, empty and blank texts, repeated rows, ties, other scripts; and columns with clashing names.
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omikron pi rho".split()
random.seed(11)
LONG = " ".join(random.choices(WORDS, k=6000))
ROWS = [
    (1, "The Quick brown fox jumps over the lazy dog. " * 3), (2, None), (3, ""), (4, " \n\t "), (5, "one"), (5, "one"), (6, "ONE two Three four"), (7, LONG), (8, LONG), (9, LONG[:400] + " other"),
    (10, "日本語 テキスト é😀 ▁▁ x"), (11, "a\x00b <|endoftext|> <s> </s>"), (None, "null id " * 20), (12, "y" * 3000), (13, " lead  and   trail  "),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "src", 0, 0.5, "x", 1) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, id int")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_against_sql(spark, duck, same, name):
    same(q.queries()[name](spark, SF), duck, q.oracle_sql()[name])


# token counts


def test_token_counts(spark, docs, none):
    from tokenizers import Tokenizer

    definition = q.tokenizer_file("byte_bpe_50k.json")
    library = Tokenizer.from_str(definition.decode())
    path = shared_path(spark, "test-cache")
    got = token_counts.count_tokens(docs, definition, path)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens"]
    want = sorted((i or -1, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for i, t in ROWS)
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in got.collect()) == want
    stored = spark.read.parquet(path).count()
    assert spark.read.parquet(path).select("digest").distinct().count() == len({t or "" for _, t in ROWS}) <= stored
    again = token_counts.count_tokens(docs.union(docs), definition, path)
    assert again.count() == 2 * len(ROWS) and spark.read.parquet(path).count() == stored
    assert token_counts.count_tokens(none, definition, shared_path(spark, "test-cache")).count() == 0


def test_token_units_are_exact():
    from tokenizers import Tokenizer

    definition = q.tokenizer_file("byte_bpe_50k.json")
    library, counter = Tokenizer.from_str(definition.decode()), token_counts.Counter(definition)
    parts = [*"ab e tT1'\n\t é日½\x00\x1c\x85\xa0 .,<", "  ", "<|endoftext|>", "'s", "'ll", "the", " \n", "​", "٣", "ñ"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 30))) for _ in range(2000)]
    assert counter.cuts and counter.count(texts) == [len(library.encode(t, add_special_tokens=False)) for t in texts]


# SentencePiece


def test_sentencepiece_is_exact(spark, docs, none):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    model = q.tokenizer_file("piece_bpe_32k.model")
    codec = sentencepiece_codec.codec_for(model)
    parts = [*"ab e tTh\n\t ▁é日x0\x00ß😀<>s", "  ", "    ", "ing", "the", "<0x41>", "<s>", "</s>", "<unk>"]
    for _ in range(3000):
        text = "".join(random.choices(parts, k=random.randint(0, 40)))
        ids = library.encode(text)
        assert codec.encode(text) == ids and codec.decode(ids) == library.decode(ids), text
    coded = sentencepiece_codec.roundtrip(docs, model)
    for r in coded.collect():
        assert r.ids == library.encode(r.text or "") and r.decoded == library.decode(r.ids)
    assert sentencepiece_codec.decode(coded.select("ids", "kept"), model).count() == len(ROWS)
    assert sentencepiece_codec.roundtrip(none, model).count() == 0


def test_backtracking_equals_merging():
    codec = sentencepiece_codec.codec_for(q.tokenizer_file("piece_bpe_32k.model"))
    for _ in range(2000):
        word = "▁" + "".join(random.choices("theaniogsrlTHE", k=random.randint(1, 60)))
        assert codec.backtrack(word) == codec.merge(word)


# resharding


def test_min_cost_flow_is_least():
    for _ in range(200):
        n, m = random.randint(1, 5), random.randint(1, 5)
        supply = [random.randint(0, 9) for _ in range(n)]
        capacity = resharding.equal_capacities(sum(supply), m)
        random.shuffle(capacity)
        flow = resharding.min_cost_flow(supply, capacity)
        assert [sum(r) for r in flow] == supply and all(sum(r[j] for r in flow) <= c for j, c in enumerate(capacity))
        stay = sum(flow[i][i] for i in range(min(n, m)))
        assert stay == sum(min(supply[i], capacity[i]) for i in range(min(n, m)))


@pytest.mark.parametrize("old", [1, 3])
def test_reshard(spark, docs, old):
    rows, plan = resharding.reshard(docs, F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(old)), 4, old)
    got = rows.collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ROWS)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    for shard in range(4):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_reshard_evens_out(spark):
    docs = table(spark, "documents")
    rows, plan = resharding.reshard(docs, F.pmod(F.xxhash64("source"), F.lit(3)), 8, 3)
    got = rows.groupBy("shard").agg(F.sum("size").alias("b"), F.max("size").alias("m")).collect()
    total, largest = sum(r.b for r in got), max(r.m for r in got)
    assert len(got) == 8 and max(abs(r.b - total / 8) for r in got) <= largest
    moved = rows.where("shard <> old_shard").agg(F.sum("size")).first()[0]
    assert abs(moved - sum(plan.flows[i][j] for i in range(3) for j in range(8) if i != j)) <= 8 * largest


def test_reshard_empty(spark, none):
    rows, _ = resharding.reshard(none, F.lit(0), 4, 1)
    assert rows.count() == 0


# top-k


def test_topk_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [-1.0, 0.5]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (None, [1.0, 1.0]), (8, [1.0])]
    vectors = spark.createDataFrame([(i, v, 9) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = [tuple(r) for r in topk.search(vectors, vectors.where("vec_id in (1, 3, 8)"), 3).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 2, 65536), (1, 2, 7, 65536), (1, 3, 7, 65536)]
    assert [r.score for r in topk.search(vectors, vectors.where("vec_id = 1"), 9).orderBy("rank").collect()] == [65536, 65536, 65536, -65536]
    assert topk.search(vectors.limit(0), vectors, 3).count() == 0 and topk.search(vectors, vectors.limit(0), 3).count() == 0


def test_topk_large_numbers_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 4)
    rng = np.random.default_rng(3)
    data = [(int(i), [float(np.float32(x)) for x in rng.normal(size=6) * (1e6 if i % 2 else 1)]) for i in range(40)]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(3)
    whole = {i: [math.floor(256 * x) for x in v] for i, v in data}
    for r in topk.search(vectors, vectors, 4).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("x")).collect():
        best = sorted(((-sum(a * b for a, b in zip(whole[r.query_id], v)), i) for i, v in whole.items() if i != r.query_id))[:4]
        assert [(x.vec_id, x.score) for x in r.x] == [(i, -s) for s, i in best]


def test_topk_beyond_64_bits(spark):
    rows = [(i, [float(np.float32(3e15 * (i + 1))), 1.0]) for i in range(6)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.vec_id, int(r.score)) for r in topk.search(vectors, vectors.where("vec_id = 0"), 3).orderBy("rank").collect()]
    whole = [[math.floor(256 * x) for x in v] for _, v in rows]
    assert got == [(i, sum(a * b for a, b in zip(whole[0], whole[i]))) for i in (5, 4, 3)] and got[0][1] > 2**63


# suffix arrays


def removed(rows):
    """The bytes that go, by looking at every 50-byte string."""
    seen, out, at = set(), {}, None
    waiting = set()
    for i, text in sorted(((i, (t or "").encode()) for i, t in rows if i is not None)):
        if i != at:
            seen |= waiting
            waiting, at = set(), i
        grams = [text[p : p + 50] for p in range(len(text) - 49)]
        gone = bytearray(len(text))
        for p, g in enumerate(grams):
            if g in seen:
                gone[p : p + 50] = b"\x01" * 50
        waiting |= set(grams)
        out.setdefault(i, []).append((bytes(b for b, g in zip(text, gone) if not g), sum(gone)))
    return {i: sorted(x) for i, x in out.items()}


@pytest.mark.parametrize("block, hot", [(300, 4096), (300, 3), (20_000, 4096), (4 << 20, 4096)])
def test_suffix_dedup(spark, docs, monkeypatch, block, hot):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    random.seed(block)
    passage = "".join(random.choices("abc ", k=120))
    extra = [(20 + i, "".join(random.choices("ab", k=random.randint(0, 80))) + passage[random.randint(0, 40) : random.randint(60, 120)] + "é" * random.randint(0, 60)) for i in range(60)]
    rows = [(i, t) for i, t in ROWS] + extra
    done = suffix_dedup.remove_repeats(spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, kept string").repartition(3)).collect()
    assert len(done) == len(rows)
    got = {}
    for r in done:
        if r.doc_id is not None:
            got.setdefault(r.doc_id, []).append((bytes(r.kept), sum(s.end - s.begin for s in r.spans)))
            assert all(a.end < b.begin for a, b in zip(r.spans, r.spans[1:]))
    assert {i: sorted(x) for i, x in got.items()} == removed(rows)


def test_suffix_dedup_as_text_and_empty(spark, docs, none):
    assert suffix_dedup.remove_repeats(none).count() == 0 and suffix_dedup.repeat_groups(none).count() == 0
    rows = suffix_dedup.remove_repeats(docs, as_text=True).where("doc_id = 8").first()
    assert rows.kept == ""
    with pytest.raises(TypeError):
        suffix_dedup.remove_repeats(docs.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_pieces_meet(monkeypatch):
    """Anchors don't depend on where a text is divided for hashing, and zeros in texts are bytes like any other."""
    body = bytes(random.choices(b"ab\x00", k=5000))
    whole = suffix_dedup.Texts([body, body[100:900]])
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    parts = suffix_dedup.Texts([body, body[100:900]])
    assert (whole.at == parts.at).all() and (whole.hashes == parts.hashes).all()


def test_maximal_repeats_equal_their_definition():
    rng = random.Random(3)
    side, width = suffix_dedup.SIDE, suffix_dedup.WIDTH
    for _ in range(100):
        n = rng.randint(2, 30)
        base, rows = bytes(rng.choices(b"ab\x00", k=width)), []
        for _ in range(n):
            x = bytearray(base)
            for _ in range(rng.randint(0, 2)):
                x[rng.choice([*range(side), *range(suffix_dedup.LENGTH, width)])] = rng.choice(b"ab\x00")
            rows.append(bytes(x))
        contexts, owner = np.frombuffer(b"".join(rows), np.uint8).reshape(n, width), np.array([rng.randint(0, 6) for _ in range(n)])
        want = set()
        for left in range(side + 1):
            for right in range(suffix_dedup.LENGTH - left, suffix_dedup.LENGTH + 1):
                groups = {}
                for i, r in enumerate(rows):
                    groups.setdefault(r[side - left : side + right], []).append(i)
                for m in groups.values():
                    diverse = (left == side or len({rows[i][side - left - 1] for i in m}) > 1) and (right == suffix_dedup.LENGTH or len({rows[i][side + right] for i in m}) > 1)
                    if diverse and len({owner[i] for i in m}) > 1:
                        want |= {(i, left, right, bool(owner[i] > min(owner[j] for j in m))) for i in m}
        sets = [set(zip(*[x.tolist() for x in suffix_dedup.maximal_repeats(contexts, owner, every)])) for every in (True, False)]
        covers = [{(i, p) for i, a, b, later in s if later for p in range(side - a, side + b)} for s in sets]
        assert sets[0] == want and sets[1] <= want and covers[0] == covers[1]


def test_interval_tree():
    depth, parent, leaf = suffix_dedup.interval_tree(np.array([0, 2, 3, 1, 0, 2, 2, 5, 0], np.uint8), 2)
    nodes = {int(i): (int(depth[i]), int(depth[parent[i]])) for i in set(leaf.tolist())}
    assert [nodes[i] for i in leaf.tolist()] == [(2, 0), (3, 2), (3, 2), (0, 0), (2, 0), (2, 0), (5, 2), (5, 2), (0, 0)]


@pytest.mark.parametrize("block", [300, 4 << 20])
def test_repeat_groups(spark, monkeypatch, block):
    """All occurrences of each group, and a group for every maximal repeat that anchors see whole."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    rng = random.Random(block)
    letters = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    shared = [letters(56) for _ in range(4)]
    rows = [(i, letters(rng.randint(0, 90)) + rng.choice(shared) + letters(rng.randint(0, 90)) + rng.choice(shared)[3:]) for i in range(40)] + [(50, None), (51, "")]
    found = {}
    for r in suffix_dedup.repeat_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        found.setdefault(r.group, []).append((r.doc_id, r.begin, r.end))
    texts = dict(rows)
    strings = set()
    for name, places in found.items():
        string, = {texts[i][b:e] for i, b, e in places}
        assert hashlib.md5(string.encode()).hexdigest() == name and len(string) >= 50
        every = {(i, b, b + len(string)) for i, t in rows for b in range(len(t or "")) if t.startswith(string, b)}
        assert every == set(places) and len({i for i, _, _ in places}) > 1
        strings.add(string)
    windows = {}
    for i, t in rows:
        for p in range(len(t or "") - 49):
            windows.setdefault(t[p : p + 50], set()).add(i)
    shared = {w for w, i in windows.items() if len(i) > 1}
    assert shared == {s[p : p + 50] for s in strings for p in range(len(s) - 49)} and any(len(s) > 50 for s in strings)


# WARC


def test_warc(spark):
    big = "<html>é" + "x" * 200
    rows = [(1, "http://www.Example.com:80/a?b=1#c", big), (2, "https://example.com/b", big), (2, "https://example.com/b", big), (3, None, None), (4, "not a url\r\nX: y", "short"), (5, "http://example.com/s", "short"), (None, "http://n.org", "z" * 150)]
    pages = spark.createDataFrame([(i, u, h, "extra") for i, u, h in rows], "page_id long, url string, html string, digest string")
    root = shared_path(spark, "test-archives")
    directory = warc.build_index(warc.write(pages, root), root, 3)
    found = warc.find(spark, directory, root, warc.url_keys(pages), 3)
    got = Counter((r.page_id, r.record_type, r.payload_bytes, r.refers_to, r.payload_digest) for r in warc.read(spark, root, found).collect())
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == Counter([
        (1, "response", 208, None, digest(big)), (2, "revisit", 208, 1, digest(big)), (2, "revisit", 208, 1, digest(big)), (3, "response", 0, None, digest("")),
        (4, "response", 5, None, digest("short")), (5, "response", 5, None, digest("short")), (None, "response", 150, None, digest("z" * 150)),
    ])
    archive = warc.Archive([tuple(r) for r in directory.collect()], root)
    (fields, payload), = archive.lookup("http://www.example.com/a?b=1")
    assert payload.decode() == big and fields["warc-type"] == "response"
    assert len(archive.lookup("https://example.com/b")) == 2 and archive.lookup("http://absent.org/") == []
    empty = shared_path(spark, "test-archives")
    none = warc.build_index(warc.write(pages.limit(0), empty), empty, 2)
    assert warc.read(spark, empty, warc.find(spark, none, empty, warc.url_keys(pages), 2)).count() == 0


@pytest.mark.parametrize("entries", [1, 2, 3, 2000])
def test_lookups_across_index_blocks(spark, monkeypatch, entries):
    """Each key finds all its records, wherever index blocks end, and absent keys find none."""
    monkeypatch.setattr(warc, "ENTRIES", entries)
    monkeypatch.setattr(warc, "BLOCK", 500)
    urls = [f"http://h{i % 7}.org/{i % 5}" for i in range(60)]
    pages = spark.createDataFrame([(i, u, "x" * (i * 9 % 200)) for i, u in enumerate(urls)], "page_id long, url string, html string")
    root = shared_path(spark, "test-archives")
    directory = warc.build_index(warc.write(pages, root), root, 4)
    wanted = spark.createDataFrame([(u,) for u in [*urls[:9], "http://absent.org/", "http://h0.org/9", "http://zz/"]], "url string")
    got = Counter((r.page_id, r.url) for r in warc.read(spark, root, warc.find(spark, directory, root, warc.url_keys(wanted), 3)).collect())
    assert got == Counter((i, u) for i, u in enumerate(urls) if u in urls[:9])


def test_url_keys():
    assert warc.url_key("http://www.Example.com:8080/a?b#c") == "com,example,www:8080)/a?b"
    assert warc.url_key(None) == "" and warc.url_key("http://[bad") == "http://[bad"


def test_damaged_records_are_refused():
    raw = warc.record(1, "http://a.b/", b"x" * 10, hashlib.sha256(b"x" * 10).hexdigest(), None)
    assert warc.parsed(raw)[1] == b"x" * 10
    for bad in (raw[:-1], raw[:50], b"nothing"):
        with pytest.raises((ValueError, KeyError)):
            warc.parsed(bad)


# language model


def test_context_tree_scores(spark, docs, none):
    training = F.coalesce(F.col("doc_id"), F.lit(0)) % 3 != 1
    scored = context_tree.score(docs, training).collect()
    assert len(scored) == len(ROWS)
    low = lambda t: (t or "").encode().lower().split()
    learnt = [t for i, t in ROWS if (i or 0) % 3 != 1]
    counts = Counter(w for t in learnt for w in low(t))
    total, distinct = sum(counts.values()) + len(learnt), len(counts) + 1
    want = {}
    for i, t in ROWS:
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in low(t)) + math.log10((len(learnt) + 1) / (total + distinct + 1))
        want[i] = (len(low(t)) + 1, sum(counts[w] > 0 for w in low(t)) + 1, total, base)
    for r in scored:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3] and abs(r.base_score - want[r.doc_id][3]) < 1e-6 * abs(want[r.doc_id][3])
        assert r.score < 0
    assert context_tree.score(none, training).count() == 0
    assert all(r.n_known == 0 for r in context_tree.score(docs, F.lit(False)).collect())


def brute_tree(texts, learnt):
    """Context-tree weighting by its definition: log10 of the probability of each text, by a model of those that are learnt."""
    depth, end, pad = context_tree.DEPTH, 256, -1
    counts, children = {}, {}

    def steps(t):
        line = [pad] * depth + list(t)
        for p, symbol in enumerate([*t, end]):
            context = tuple(reversed(line[p : p + depth]))
            for level in range(9 if symbol < end else 1):
                yield context, (level, symbol >> (9 - level)), (symbol >> (8 - level)) & 1

    for t in learnt:
        for context, which, bit in steps(t):
            for d in range(depth + 1):
                counts.setdefault((which, context[:d]), [0, 0])[bit] += 1
                if d:
                    children.setdefault((which, context[: d - 1]), set()).add((which, context[:d]))
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    weights = {}
    for node in sorted(counts, key=lambda x: -len(x[1])):
        own = kt(*counts[node])
        weights[node] = own if len(node[1]) == depth else float(np.logaddexp(own, sum(weights[c] for c in children[node]))) - math.log(2)

    def chance(which, context, d=0):
        node = (which, context[:d])
        a, b = counts.get(node, (0, 0))
        own = (b + 0.5) / (a + b + 1)
        if d == depth or (which, context[: d + 1]) not in counts:
            return own
        stop = math.exp(kt(a, b) - math.log(2) - weights[node])
        return stop * own + (1 - stop) * chance(which, context, d + 1)

    return [sum(math.log10(p if bit else 1 - p) for context, which, bit in steps(t) for p in [chance(which, context)]) for t in texts]


@pytest.mark.parametrize("block", [2000, 8 << 20])
def test_context_tree_equals_its_definition(spark, monkeypatch, block):
    monkeypatch.setattr(context_tree, "BLOCK", block)
    monkeypatch.setattr(context_tree, "PARTITION", block)
    rng = random.Random(3)
    texts = ["The same line again. " * 300] * 3 + ["".join(rng.choices("abcdefgh ", k=200)) for _ in range(12)] + [None, "", "日本語 é\x00 é\x00", "never seen ÿ", "日本"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    got = {r.doc_id: (r.score, r.bits_per_byte) for r in context_tree.score(docs, F.col("doc_id") % 5 != 2).collect()}
    raw = [(t or "").encode().lower() for t in texts]
    want = brute_tree(raw, [t for i, t in enumerate(raw) if i % 5 != 2])
    assert np.allclose([got[i][0] for i in range(len(texts))], want, rtol=1e-9)
    assert all((got[i][1] is None) == (not t) for i, t in enumerate(raw))
    none = {r.doc_id: r.score for r in context_tree.score(docs, F.lit(False)).collect()}
    assert np.allclose([none[i] for i in range(len(texts))], brute_tree(raw, []), rtol=1e-9)


@pytest.mark.parametrize("buckets", [8, 1000, 1 << 16])
def test_byte_pairs_reach_all_buckets(buckets):
    pairs = np.bincount(context_tree.bucket_of_gram(buckets), minlength=buckets)
    assert pairs.sum() == 1 << 16 and pairs.max() - pairs.min() <= 1


def test_words_and_counts_of_blocks():
    texts = [" A b\x0bc\x1f  ", "", None, "b É b", "\t\n", "a\x00 a\x00 a"]
    of, word, words = context_tree.words_of(context_tree.lowered(pa.array(texts)))
    names = words.cast(pa.binary()).to_pylist()
    assert [(i, names[w]) for i, w in zip(of, word)] == [(i, w) for i, t in enumerate(texts) for w in (t or "").encode().lower().split()]
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 50, dtype=np.uint64))
    back = context_tree.grams_unpacked(context_tree.grams_packed(keys, np.arange(50)))
    assert (back[0] == keys).all() and (back[1] == np.arange(50)).all()
    n = np.array([0, 1, 5000, 70000])
    want = [math.lgamma(a + 0.5) + math.lgamma(a // 3 + 0.5) - math.lgamma(a + a // 3 + 1) - math.log(math.pi) for a in n.tolist()]
    assert np.allclose(context_tree.log_kt(n, n // 3), want)


def test_context_tree_beats_the_words(spark):
    """On texts that it hasn't seen, the model is better than word frequencies."""
    docs = spark.read.parquet(SF.replace("0.001", "0.1") + "/documents.parquet").select("doc_id", "text").where("doc_id < 3000")
    held = context_tree.score(docs, F.col("doc_id") % 7 != 2).where("not training").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[1] < held[0] < 0


# decontamination


def test_decontamination(spark, docs, none, monkeypatch):
    items = spark.createDataFrame([(1, "lazy dog the quick", 0), (2, " ".join(LONG.split()[100:115]), 0), (3, None, 0), (4, "...", 0), (4, "ONE", 0), (5, "absent words here", 0), (6, "dog dog", 0)], "item_id long, text string, id int")
    rows = docs.select("doc_id", "text").collect()

    def brute(t, width=10):
        import re

        words = lambda x: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or "")) if w]
        w, hit, found = words(t), set(), set()
        for i, text, _ in [tuple(r) for r in items.collect()]:
            x = words(text)
            for s in range(max(len(x) - width + 1, 1) if x else 0):
                p = x[s : s + width]
                for at in range(len(w) - len(p) + 1):
                    if w[at : at + len(p)] == p:
                        hit |= set(range(at, at + len(p)))
                        found.add(str(i))
        return len(w), len(hit), sorted(found)

    want = {(r.doc_id, *map(str, brute(r.text))) for r in rows}
    path = shared_path(spark, "test-index")
    index = decontamination.build_index(docs, path)
    for limit in (1 << 21, 0):
        monkeypatch.setattr(decontamination, "BROADCAST_TEXT_BYTES", limit)
        got = decontamination.hits(index, decontamination.phrase_matches(index, items)).collect()
        assert {(r.doc_id, str(r.n_words), str(r.n_hit), str(r["items"])) for r in got} == want
        left = {r.doc_id for r in decontamination.decontaminate(docs.withColumn("key", F.lit(1)).withColumn("w", F.lit(2)), items, index_path=path).collect()}
        assert left == {r.doc_id for r in rows} - {r.doc_id for r in rows if brute(r.text)[1]}
        near = {(r.id, r["item"]) for r in decontamination.proximity_matches(index, items, 6).collect()}
        assert (1, 1) in near and (1, 6) in near and not any(i == 5 for _, i in near)
    empty = decontamination.build_index(none, shared_path(spark, "test-index"))
    assert decontamination.phrase_matches(empty, items).count() == decontamination.hits(empty, decontamination.phrase_matches(empty, items)).count() == 0
    assert decontamination.hits(index, decontamination.phrase_matches(index, items.limit(0))).where("n_hit > 0").count() == 0
    files = sorted(decontamination.build_index(docs, path).inputFiles())
    assert files == sorted(index.inputFiles())  # a second call reads what the first has written


def test_windows_of_few_words(spark, monkeypatch):
    """Texts of three words that repeat everywhere, windows of all sizes, on both paths, against every place of every window."""
    import random

    rng = random.Random(8)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(25))) for _ in range(40)]
    tests = [" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 14))) for _ in range(25)] + ["a", "a a", "c b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(tests)), "item_id long, text string")
    index = decontamination.build_index(docs, shared_path(spark, "test-index"))
    for width, limit in ((1, 1 << 21), (2, 0), (3, 1 << 21), (4, 1 << 21), (10, 0), (10, 1 << 21)):
        monkeypatch.setattr(decontamination, "BROADCAST_TEXT_BYTES", limit)
        want = set()
        for i, x in enumerate(tests):
            x = x.split()
            for p in {tuple(x[s : s + width]) for s in range(max(len(x) - width + 1, 1))}:
                want |= {(d, i, at, at + len(p)) for d, t in enumerate(texts) for at in range(len(t.split()) - len(p) + 1) if tuple(t.split()[at : at + len(p)]) == p}
        got = [(r.id, r["item"], r.begin, r.end) for r in decontamination.phrase_matches(index, items, width).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_items_without_an_id_contaminate(spark, docs):
    items = spark.createDataFrame([(None, "lazy dog the quick")], "item_id long, text string")
    index = decontamination.build_index(docs, shared_path(spark, "test-index"))
    hit = {r.doc_id for r in decontamination.hits(index, decontamination.phrase_matches(index, items)).where("n_hit > 0").collect()}
    left = {r.doc_id for r in decontamination.decontaminate(docs, items).collect()}
    assert hit == {1} and left == {i for i, _ in ROWS} - hit


# toxicity


def test_toxicity_learns_and_locates(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        toxic = i % 4 == 0
        sentences = [" ".join(rng.choices(WORDS, k=8)) for _ in range(6)]
        if toxic:
            sentences[rng.randrange(6)] += " " + rng.choice(["dreadfool", "dreadfoolish"])
        rows.append((i, ". ".join(sentences), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(500, None), (501, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [(y, got[i]) for i, _, y in rows if i % 5 == 0]
    assert sum((s >= 0.5) == bool(y) for y, s in held) / len(held) > 0.97 and got[500] == got[501] < 0.5
    found = toxicity.locate(docs, model).collect()
    assert found and sum("dreadfool" in r.text for r in found) / len(found) > 0.9
    empty = toxicity.fit(docs, labels.limit(0), F.lit(True))
    assert all(r.score < 0.5 for r in toxicity.score(docs.limit(3), empty).collect())
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_noisy_or_adds_up():
    model = toxicity.fit_bags([([np.array(toxicity.features("bad"), np.int32)], 1), ([np.array(toxicity.features("good"), np.int32)], 0)] * 4)
    scorer = toxicity.Scorer(model)
    for text in ("bad. good! bad", "", "...", "good good good", "bad"):
        assert abs(scorer.score(text) - (1 - math.prod(1 - p for *_, p in scorer.of_sentences(text)))) < 1e-9


# near duplicates


def brute_groups(rows, percent=75):
    sets = {}
    for k, (i, t) in enumerate(rows):
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[s : s + 5]) for s in range(max(len(w) - 4, 1))} if w else set()
    group = {k: k for k in sets}

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in sets:
        for b in range(a):
            if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                group[find(a)] = find(b)
    least = {}
    for k in sets:
        if rows[k][0] is not None:
            least[find(k)] = min(least.get(find(k), rows[k][0]), rows[k][0])
    return Counter((rows[k][0], len(sets[k]), None if rows[k][0] is None else least[find(k)]) for k in sets)


def test_near_duplicates(spark, docs, none):
    rng = random.Random(9)
    base = [rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(120)]
    extra = []
    for i in range(120):  # a group of near copies around the least similarity, so that links and misses mix
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(1000))
        extra.append((100 + i, " ".join(w)))
    extra += [(300 + i, " ".join(base[i % 7 : i % 7 + 4 + i % 5])) for i in range(30)]
    rows = ROWS + extra
    got = near_duplicates.near_duplicates(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string")).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_groups(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_duplicates.near_duplicates(none).count() == 0


@pytest.mark.parametrize("size", [600, 1 << 22])
def test_large_sets_and_many_chunks(spark, monkeypatch, size):
    """True links between sets of several hundred shingles, and buckets that are divided into many chunks."""
    monkeypatch.setattr(near_duplicates, "CHUNK_BYTES", size * 8)
    monkeypatch.setattr(near_duplicates, "EDGES", 3)
    rng = random.Random(21)
    rows = []
    for family in range(3):
        base = [f"{rng.choice(WORDS)}{rng.randrange(500)}" for _ in range(400)]
        for k in range(25):
            w = list(base)
            for _ in range(rng.randrange(2, 16)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
            rows.append((1000 * family + k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_groups(rows)


def test_recall_of_the_bands():
    """Of pairs at the least similarity, all share a bucket."""
    rng, least = np.random.default_rng(4), 1.0
    for _ in range(1500):
        n = int(rng.integers(40, 600))
        common = rng.integers(0, 1 << 64, 3 * n, dtype=np.uint64)
        x, y = (np.sort(np.concatenate((common, rng.integers(0, 1 << 64, n // 2, dtype=np.uint64)))) for _ in range(2))
        least = min(least, 3 * n / (3 * n + 2 * (n // 2)))
        assert set(near_duplicates.bands(x).tolist()) & set(near_duplicates.bands(y).tolist())
    assert 0.74 < least < 0.78


def test_ids_that_are_no_integers_are_refused(spark):
    with pytest.raises(TypeError):
        near_duplicates.near_duplicates(spark.createDataFrame([("x", "a b")], "doc_id string, text string"))


def test_row_without_an_id_takes_no_links(spark):
    """A row with a null id stands before one with the same set, in the same slice, that is near another."""
    words = [f"w{i}" for i in range(100)]
    rows = [(None, " ".join(words)), (1, " ".join(words)), (2, " ".join([*words[:-1], "other"]))]
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_groups(rows)
    assert sorted(r.component_id for r in got if r.doc_id) == [1, 1]


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(5, 5)]
    got = {r.id: r.component for r in near_duplicates.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    group = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            group[a] = group[b] = min(group[a], group[b])
    assert got == {x: g for x, g in group.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_attempts_have_files_of_their_own(spark):
    """Two attempts of a task, with their rows in another order: what each one's name leads to is its own."""
    store = Store(shared_path(spark, "attempts"))
    rows = [["a", "b", "c"], ["c", "a", "b"]]
    names = [store.write_new(pa.table({"text": pa.array(r)}), "0-0") for r in rows]
    assert [store.read(n).column("text").to_pylist() for n in names] == rows


def test_token_counts_and_groups_over_shuffled_input(spark, docs):
    for run in (near_duplicates.near_duplicates, lambda d: token_counts.count_tokens(d, q.tokenizer_file("byte_bpe_50k.json"), shared_path(spark, "shuffled"))):
        assert sorted(map(repr, run(docs.repartition(5, "text")).collect())) == sorted(map(repr, run(docs).collect()))
