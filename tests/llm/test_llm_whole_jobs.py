"""Operators on training data do the whole job: each test here fails on a cut of it."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest


def chain(r, n=60):
    """Words of which each has two that may follow."""
    at, out = r.randrange(40), []
    for _ in range(n):
        out.append("w" + "abcdefghij"[at // 10] + "abcdefghij"[at % 10])
        at = (at * 3 + r.choice([1, 8])) % 40
    return out


def test_quality_sees_the_order_of_words(spark):
    pytest.importorskip("public_tokenizers")
    from siftwork.llm import quality

    r = random.Random(3)
    trusted = [[*chain(r), *["hm"] * (i % 4)] for i in range(400)]
    mixed = [r.sample(words, len(words)) for words in trusted[:100]]
    rows = [(i, " ".join(words), "en") for i, words in enumerate(trusted + mixed)] + [(900, "", "en"), (901, "waa", "en"), (902, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(400)], "doc_id long, quality int")
    kept = {x["doc_id"]: x["kept"] for x in quality.classify(docs, labels).collect()}
    assert sum(kept[i] for i in range(400)) > 380 and sum(kept[i] for i in range(400, 500)) <= 5

    words = quality.train(docs.where("doc_id < 400"), order=2)
    table, keys = words.model.table(), {}
    seen, spell = Counter(), {}
    for i, text, _ in rows:
        data, key, row, start, length = quality.words_in(pa.array([text], pa.string()))
        keys[i] = key.tolist()
        spell.update(zip(keys[i], np.exp2(quality.spelled(data, start, length, table)).tolist(), strict=True))
        if i < 400:
            seen.update(zip(keys[i][-1:] + keys[i][:-1], keys[i], strict=True))

    def discounted(counts):
        n1, n2, n3, n4 = (max(sum(c == k for c in counts.values()), 1) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d = [min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        return {x: min(d[min(c, 3) - 1], c) for x, c in counts.items()}

    contexts = Counter(w for _, w in seen)
    cut_word, cut_pair = discounted(contexts), discounted(pairs := Counter({x: n for x, n in seen.items() if x[0] != int(quality.REPEATED)}))
    total, freed = Counter(), Counter()
    for (v, w), n in pairs.items():
        total[v] += n
        freed[v] += cut_pair[v, w]
    low = lambda w: (contexts[w] - cut_word.get(w, 0)) / contexts.total() + sum(cut_word.values()) / contexts.total() * spell[w]
    for x in quality.score(docs, words).collect():
        own = keys[x["doc_id"]]
        bits = [np.log2((pairs[v, w] - cut_pair.get((v, w), 0)) / (total[v] or 1) + (freed[v] / total[v] if total[v] else 1) * low(w)) for v, w in zip(own[-1:] + own[:-1], own, strict=True)]
        assert np.isclose(x["perplexity"], 2 ** (-sum(bits) / max(x["n_symbols"], 1)), rtol=1e-3)


def test_packing_of_texts_with_the_added_token(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from siftwork.llm import packing

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["plain first text", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext|", "", "é<|endoftext|>\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    found = {}
    for r in packing.pack(docs, path, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect():
        found.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    library = Tokenizer.from_file(path)
    for i, text in enumerate(texts):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, packing.END], "<u4")
        assert sorted(found[i]) == [(a, n, zlib.crc32(ids[a : a + n].tobytes()), len(ids)) for a, n, *_ in sorted(found[i])]
        assert sum(n for _, n, *_ in found[i]) == len(ids)


@pytest.mark.parametrize("times", [1, 6, 10])
def test_top_k_of_a_repeated_query(spark, monkeypatch, times):
    """As in the SQL, each row of a query meets each row of other ids; its own rows take no place."""
    from siftwork.llm import topk

    monkeypatch.setattr(topk, "PARTS_AT_LEAST", 1)
    r = random.Random(2)
    rows = [(i, [r.randint(-40, 40) / 256 for _ in range(8)]) for i in range(1, 50)]
    rows += [(50, [0.5] * 8)] * times + [(i, [0.5] * 8) for i in (51, 52, 77)] + [(60, [0.25] * 8)] * 4 + [(100, [0.4] * 8), (150, [0.5] * 8)]
    want = []
    ints = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows]
    for q in (50, 100, 150):
        best = sorted((-int(own @ v), c) for i, own in ints if i == q for c, v in ints if c != q)[:5]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in topk.search(df).collect()) == sorted(want)
