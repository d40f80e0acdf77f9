"""Operators on single rows: exact round trips, brute force and held-out accuracy, with edge cases."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from siftwork.llm import html_crf, jpeg, packing, pii, piece_bpe, quality, sharding, toxicity  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, score double, _text string"
EDGE = ["", None, " ", "a", "a a a", "Ä é 中 😀 x", "same text here", "same text here", "word " * 40_000, "x" * 60_000, "7" * 30_000, "\x00\n\t"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "s", None, 1, 0.5, "clash") for i, t in enumerate(EDGE)]
    rows.append((6, "same text here", "en", "s", 1, 1, 0.5, "clash"))  # a repeated row
    return spark.createDataFrame(rows, SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_media_round_trip(docs):
    found = by_id(jpeg.media_digests(docs))
    for i, text in enumerate(EDGE):
        raw = (text or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        row = found[i]
        assert (row["n_bytes"], row["payload_bytes"]) == (len(raw), len(payload))
        assert row["payload_sha256"] == hashlib.sha256(payload).hexdigest() and row["tail_crc32"] == zlib.crc32(payload[-64:])
    assert found[6]["media_sha256"] == found[7]["media_sha256"]
    assert jpeg.media_digests(docs.limit(0)).count() == 0


def test_jpeg_decoder_reads_other_tables_and_no_restarts():
    """A file of two blocks with several code lengths, zero runs and an early end of block."""
    bits = ""
    dc = {0: "00", 3: "01", 4: "10"}
    ac = {0x00: "00", 0x02: "01", 0x11: "100", 0xF0: "101"}
    bits += dc[3] + "101" + ac[0x02] + "10" + ac[0x11] + "0" + ac[0x00]  # dc 5; 2; one zero, -1; end
    bits += dc[4] + "0111" + ac[0xF0] + ac[0x02] + "00" + ac[0x00]  # dc 5 - 8; sixteen zeros, -3; end
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    m = jpeg._marker
    head = b"\xff\xd8" + m(0xDB, b"\x00" + b"\x02" * 64) + m(0xC0, b"\x08\x00\x08\x00\x10\x01\x01\x11\x00")
    head += m(0xC4, b"\x00" + bytes([0, 3] + [0] * 14) + bytes([0, 3, 4])) + m(0xC4, b"\x10" + bytes([0, 2, 2] + [0] * 13) + bytes([0x00, 0x02, 0x11, 0xF0]))
    ((info, found),) = jpeg.coefficients([head + m(0xDA, b"\x01\x01\x00\x00\x3f\x00") + scan + b"\xff\xd9"])
    want = np.zeros((2, 64), int)
    want[0, [0, 1, 3]] = 5, 2, -1
    want[1, [0, 17]] = -3, -3
    assert (found == want).all()
    assert jpeg.thumbnail(info, found).tolist() == [[(5 * 2 + 4) // 8 + 128, (-3 * 2 + 4) // 8 + 128]]


def test_pieces_equal_the_library(docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = piece_bpe.load(path).library
    found = by_id(piece_bpe.piece_digests(docs, path))
    for i, text in enumerate(EDGE):
        ids = lib.encode(text or "", add_eos=True)
        assert found[i]["n_tokens"] == len(ids) and found[i]["library_agrees"]
        assert found[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_agenda_alone_equals_the_library():
    model, r = piece_bpe.load(public_tokenizers.path("piece_bpe_32k.model")), random.Random(1)
    for _ in range(150):
        text = "".join(r.choice("ab c▁😀\né.") for _ in range(r.randint(0, 250)))
        ids = model.encode(text)
        assert ids == model.library.encode(text, add_eos=True) and model.decode(ids) == model.library.decode(ids)


def test_packing_covers_every_token_once(docs):
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    enc = packing.encoder(*paths)
    rows = packing.pack(docs, *paths).collect()
    sizes, used = {}, {}
    for r in rows:
        used.setdefault((r["doc_id"]), []).append(r)
        sizes.setdefault(r["sequence_id"], []).append(r)
    for i, text in enumerate(EDGE):
        ids = enc.slow.encode(text or "", add_special_tokens=False).ids + [1]
        times = 2 if i == 6 else 1
        assert sum(p["length"] for p in used[i]) == times * len(ids)
        for p in used[i]:
            own = np.array(ids[p["start"] : p["start"] + p["length"]], "<u4")
            assert p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(own.tobytes())
    for pieces in sizes.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048 and pieces[0]["padded_length"] in (2048, at)


def test_best_cuts_against_brute_force():
    r = random.Random(3)
    for _ in range(60):
        place = np.cumsum([r.randint(1, 6) for _ in range(9)])
        penalty = np.array([r.choice([0.0, 1.0, 4.0]) for _ in place])
        cost = lambda chain: sum(10 - (b - a) + penalty[list(place).index(b)] for a, b in zip([0, *chain[:-1]], chain, strict=True))  # noqa: B023, E731
        every = [[int(p) for k, p in enumerate(place) if m >> k & 1 or k == 8] for m in range(256)]
        valid = [c for c in every if all(b - a <= 10 for a, b in zip([0, *c[:-1]], c, strict=True))]
        assert cost(packing.best_cuts(place, penalty, 10)) == pytest.approx(min(map(cost, valid)))


def test_sharding_law(spark, docs):
    rows = sharding.assign(docs.union(spark.range(1000, 5000).selectExpr("id", "'t'", "'en'", "'s'", "1L", "1", "0.5D", "''"))).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 8
    assert max(map(len, slots.values())) < 1.25 * len(rows) / 8
    found = by_id(sharding.assign(docs))
    assert found[1]["size"] == 1 and found[1]["text_crc32"] == 0 and found[5]["text_crc32"] == zlib.crc32(EDGE[5].encode())
    assert sharding.assign(docs.limit(0)).count() == 0


def test_base_spans_against_plain_patterns(docs):
    plain = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    r = random.Random(2)
    for _ in range(1500):
        text = "".join(r.choice(["a", "@", "b.c", "1.2.3.4", "+1 ", "4", "-", " ", "(", ")", "4111111111111111", ".", "300.1.1.1", "+123 456 7890", "x@y.z", "é"]) for _ in range(r.randint(1, 12)))
        want = []
        for k, p in enumerate(plain):
            for m in re.finditer(p, text):
                digits = re.sub(r"\D", "", m.group())
                ok = [True, k != 1 or all(int(x) <= 255 for x in m.group().split(".")), 14 <= len(digits) <= 19 and pii.luhn(digits), 10 <= len(digits) <= 15][k]
                if ok:
                    want.append((m.start(), k, m.end()))
        assert pii.base_spans(text) == sorted(want), text


def test_network_adds_spans_and_leaves_clean_text(docs):
    model = pii.model()
    held_out = pii.labelled_sentences(300, seed=123)
    found = pii.network_spans([t for t, _ in held_out], model)
    right = sum(len(set(a) & set(b)) for a, (_, b) in zip(found, held_out, strict=True))
    assert right > 0.85 * sum(len(b) for _, b in held_out) and right > 0.85 * sum(map(len, found))
    text = "call +1 (578) 555-6437 4918187128635271 now, or x.12@mail.example.com"
    (base, every), (_, clean) = pii.all_spans([text, "On 12.05.2020 version 2.0. cost 300 coins"], model)
    assert set(base) <= set(every) and not clean
    assert "[PHONE]" in pii.mask(text, every) and "4918187128635271" not in pii.mask(text, every)
    rows = by_id(pii.find(docs))
    assert all(rows[i]["spans"] == "" for i in (0, 1, 2, 3, 4, 5, 8, 9))
    masked = by_id(pii.masked(docs))
    assert masked[1]["text"] is None and masked[4]["text"] == "a a a" and masked[4]["_text"] == "clash"


def test_main_text(spark):
    weights = html_crf.model()
    pages = ["<html><body><nav><a>Home</a></nav><article><h1>T &amp; U</h1><p>One <b>bold</b>er.<br>Two<p>Three&nbsp;x</article><div class=ad>Buy</div><footer>&copy; z</footer>", "", "plain words only"]
    assert html_crf.extract(pages, *weights) == ["T & U One bolder. Two Three x", "", "plain words only"]
    held_out = [html_crf.Page(x) for x in html_crf.labelled_pages(80, seed=5)]
    nodes = html_crf.encode(held_out)
    gold = nodes["gold"]
    gold[nodes["start"][:-1]] = 1
    for level in range(1, int(nodes["depth"].max()) + 1):
        at = np.flatnonzero((nodes["depth"] == level) & (gold < 0))
        gold[at] = gold[nodes["parent"][at]]
    assert ((html_crf.marginals(nodes, *weights)[0] > 0.5) == gold).mean() > 0.98
    rows = html_crf.main_text(spark.createDataFrame([(1, None, None, "x"), (2, "u", pages[0], "y")], "page_id long, url string, html string, text string")).collect()
    assert [(r["page_id"], r["text"], r["n_chars"]) for r in rows] == [(1, "", 0), (2, "T & U One bolder. Two Three x", 29)]


PROSE = "Plenty of plain words stand here, so that this is a paragraph of prose, with commas and a full stop at its end. " * 3


@pytest.mark.parametrize(
    "inner,kept",
    [
        ('<p>More at <a href="/x">this place</a>.</p>', "More at this place."), ("<ul><li><a href=1>one thing</a></li><li><a href=2>another</a></li></ul>", "one thing another"),
        ("<p><a href=3>A paragraph that is a link</a></p>", "A paragraph that is a link"), ('<p class="more">More of it</p>', "More of it"), ('<div class="content-footer"><p>The end of it.</p></div>', "The end of it."),
        ("<button>Click me</button>", ""), ("<p>before <button>Go</button> after</p>", "before after"), ("<form><label>Mail</label><input><button>Join</button></form>", ""),
        ('<article class="comment"><header>Bob</header><p>I like it</p></article>', ""), ('<div class="comment"><header><h4>Bob</h4></header><p>Nice one</p></div>', ""),
        ('<div class="ad">Buy now</div>', ""), ('<div data-gold="x">Odd</div>', "Odd"), ("<div data-gold>Odd</div>", "Odd"),
    ],
)
def test_what_stands_in_an_article(inner, kept):
    page = f'<html><body><header><h1>Site</h1></header><nav><a href="/">Home</a></nav><article><h1>Title of it</h1><p>{PROSE}</p>{inner}<p>{PROSE}</p></article><aside><p>Side text</p></aside><footer>&copy; z</footer></body></html>'
    want = " ".join(x for x in ("Title of it", PROSE.strip(), kept, PROSE.strip()) if x)
    assert html_crf.extract([page], *html_crf.model()) == [want]


@pytest.mark.parametrize("piece", ['<a "', '<p class="x', "<noscript>", "<svg>", "<a '>", "<p><b>", "<!--", "<li>", "</p>", "<td>x", "<a \"x\" ' >", "<", "&#"])
def test_a_hostile_page_takes_seconds(piece):
    began = time.process_time()
    html_crf.extract([piece * (500_000 // len(piece))], *html_crf.model())
    assert time.process_time() - began < 15


def test_marginals_against_enumeration():
    r = np.random.default_rng(0)
    parent = np.array([-1, 0, 0, 1, 1])
    nodes = {"parent": parent, "depth": np.array([0, 1, 1, 2, 2]), "kind": r.integers(0, 5, 5), "x": r.normal(size=(5, 3))}
    weights, edges = r.normal(size=3), r.normal(size=(6, 2, 2))
    total, one = 0.0, np.zeros(5)
    for state in range(32):
        s = np.array([state >> k & 1 for k in range(5)])
        score = np.exp((nodes["x"] @ weights * s).sum() + sum(edges[nodes["kind"][k], s[parent[k]], s[k]] for k in range(1, 5)))
        total += score
        one += score * s
    p, _, log_z = html_crf.marginals(nodes, weights, edges)
    assert np.allclose(p, one / total) and np.isclose(log_z, np.log(total))


def _toxic(spark, n=400):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    rows = []
    for i in range(n):
        bad = r.random() < 0.4
        words = [word() for _ in range(30)]
        if bad:
            words[r.randrange(30)] = "vileword"
        rows.append((i, " ".join(words), "en", int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")


def test_toxicity_held_out(spark, docs):
    made = _toxic(spark)
    model = toxicity.fit(made, made.select("doc_id", "toxic"))
    truth = {r["doc_id"]: r["toxic"] for r in made.collect()}
    rows = toxicity.score(made, model).collect()
    held = [r for r in rows if r["held_out"]]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(docs, model).collect())
    none = toxicity.fit(docs, made.select("doc_id", "toxic").limit(0))
    assert toxicity.keep_clean(docs, none).count() == docs.count()


def test_kneser_ney_sums_to_one_and_rejects_junk(spark, docs):
    r = random.Random(6)
    word = lambda: "".join(r.choice(["ba", "de", "ki", "lo"]) for _ in range(r.randint(1, 3)))
    rows = [(i, " ".join(word() for _ in range(60)) + ".", "en") for i in range(200)] + [(500, "XQ!! " * 60, "en"), (501, "baba " * 60, "en"), (502, None, None), (503, "ba de ki lo", None)]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(150)] + [(500, 0), (None, 1)], "doc_id long, quality int")
    words = quality.train(quality.trusted_rows(made, labels))
    table = words.model.table()
    sums = np.exp2(table.astype(float)).reshape(-1, quality.SYMBOLS).sum(axis=1)
    assert np.allclose(sums, 1, atol=1e-3)
    share = {r["key"]: r["share"] for r in words.shares.collect()}
    assert abs(sum(share.values()) + words.mass - 1) < 1e-9
    twice = made.union(made.limit(3)).union(spark.createDataFrame([(900, "long " + "ba de " * 70_000, "en")], made.schema))
    got = {}
    for r in quality.score(twice, words).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == twice.count()
    for row in twice.collect():  # word by word
        data, key, _, start, length = quality.words_in(pa.array([row["text"]], pa.string()))
        bits = [np.log2(share.get(k, 0) + words.mass * 2**s) for k, s in zip(key.view(np.int64).tolist(), quality.spelled(data, start, length, table), strict=True)]
        size = int((length + 1).sum())
        assert all(r["n_symbols"] == size and np.isclose(r["perplexity"], 2 ** (-sum(bits) / max(size, 1)), rtol=1e-3) for r in got[row["doc_id"]])
    kept = {r["doc_id"]: r["kept"] for r in quality.classify(made, labels).collect()}
    assert np.mean([kept[i] for i in range(200)]) > 0.95 and not kept[500] and not kept[501] and not kept[502]
    assert quality.keep_good(made, labels).count() == sum(kept.values())
    nothing = quality.classify(docs, labels.limit(0)).collect()
    assert sum(r["kept"] for r in nothing) == sum(bool(r["n_symbols"]) for r in nothing)


def test_repeated_words_become_empty_words():
    _, key, row, start, length = quality.words_in(pa.array(["ab ab  ab c", None, "ab"]))
    assert length.tolist() == [2, 0, 0, 1, 2] and row.tolist() == [0, 0, 0, 0, 2] and start.tolist() == [0, 3, 7, 10, 11]
    assert key[1] == key[2] == quality.REPEATED and key[0] == key[4] != key[3]
