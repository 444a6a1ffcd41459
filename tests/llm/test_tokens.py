import base64
import random

import numpy as np
import pytest

from folioscope.llm import byte_bpe, packing

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def public():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_the_public_library(public):
    rnd = random.Random(3)
    letters = "''''srtvelmd  \n\t\r  aZé٣1.!-\"م😀​　"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(40))) for _ in range(4000)]
    texts += ["", " ", "\n", "'s", "'sound", "it's  'll we've", "<|endoftext|>", "a" * 20_000, " " * 5000, "x\n\n\ny", "قال «نعم» ١٢٣", "日本語テキスト", "é‍"]
    own = byte_bpe.tokenizer()
    ids, counts = own.encode(texts)
    at = 0
    for text, n in zip(texts, counts):
        assert ids[at : at + n].tolist() == public.encode_ordinary(text), repr(text)
        assert own.decode(ids[at : at + n].tolist()) == text
        at += n
    assert at == len(ids)


def test_null_and_empty(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "hello world", 5), (3, "hello world", 5)]
    found = byte_bpe.encode_corpus(spark.createDataFrame(rows, "doc_id BIGINT, text STRING, ids INT")).collect()
    assert sorted((r.doc_id, list(r.ids)) for r in found) == [(1, []), (2, []), (3, [31373, 995]), (3, [31373, 995])]
    assert byte_bpe.encode_corpus(spark.createDataFrame([], "doc_id BIGINT, text STRING")).count() == 0


def test_offsets():
    pairs = byte_bpe.tokenizer().encode_with_offsets("one two\n three")
    assert [("one two\n three"[a:]).split()[0] for _, a in pairs][:2] == ["one", "two"] and pairs[0][1] == 0


def test_packing_is_whole_and_close(spark):
    rnd = random.Random(5)
    lengths = [(i, rnd.choice([0, 3, 40, 90, 130, 250, 511, 512, 513, 1400])) for i in range(900)] + [(1000, None)]
    kinds = spark.createDataFrame([("s", 512), ("m", 2048)], "container_kind STRING, capacity INT")
    rows = packing.pack(spark.createDataFrame(lengths, "doc_id BIGINT, tokens INT"), kinds).collect()
    for kind, capacity in (("s", 512), ("m", 2048)):
        bins, parts = {}, {}
        for r in rows:
            if r.container_kind == kind:
                bins[r.container_id] = bins.get(r.container_id, 0) + r.tokens
                parts.setdefault(r.doc_id, []).append((r.part, r.token_start, r.tokens))
        assert max(bins.values()) <= capacity
        for doc, tokens in lengths:
            own = sorted(parts[doc])
            assert [p for p, _, _ in own] == list(range(len(own))) and sum(t for _, _, t in own) == (tokens or 0)
            assert len(own) == 1 or tokens > capacity
            assert all(start == p * capacity for p, start, _ in own)
        assert sum(bins.values()) / (len(bins) * capacity) > 0.95
    assert packing.pack(spark.createDataFrame([], "doc_id BIGINT, tokens INT"), kinds).count() == 0


def test_crossover_keeps_every_item():
    import numpy as np

    rng = np.random.default_rng(1)
    sizes = [int(s) for s in rng.integers(0, 300, 200)]
    a, b = packing.best_fit(sizes, 512, list(range(200))), packing.best_fit(sizes, 512, list(range(199, -1, -1)))
    child = packing.crossed(sizes, 512, a, b, rng)
    assert sorted(i for x in child for i in x) == list(range(200)) and max(sum(sizes[i] for i in x) for x in child) <= 512


@pytest.mark.parametrize("low, high", [(280, 390), (250, 500)])
def test_evolution_beats_best_fit_near_a_third_of_the_capacity(low, high):
    """Where three items fill a container, best fit by size pairs the large ones and leaves room; whole bins of others mend it."""
    rng = np.random.default_rng(5)
    sizes = [int(x) for x in rng.integers(low, high, 600)]
    plain = packing.best_fit(sizes, 1000, sorted(range(600), key=lambda i: -sizes[i]))
    evolved, _ = packing.evolve(sizes, 1000, [], 1)
    assert len(evolved) < len(plain) and sorted(i for b in evolved for i in b) == list(range(600)) and all(sum(sizes[i] for i in b) <= 1000 for b in evolved)
