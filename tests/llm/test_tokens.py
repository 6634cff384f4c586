import base64
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkseek.llm import bpe as B
from sparkseek.llm import mixing as M

RANKS = B.read_ranks(open(B.vocabulary_path(), "rb").read())
MINE = B.Transducer(RANKS)
THEIRS = tiktoken.Encoding("own", pat_str=B.PATTERN, mergeable_ranks=RANKS, special_tokens={})
BACK = B.Decoder(RANKS)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_same_ids_and_round_trip(text):
    text = text.encode("utf-8", "replace").decode()
    ids = MINE.encode(text)
    assert ids == THEIRS.encode_ordinary(text) and BACK.decode(ids) == text


@pytest.mark.parametrize("alphabet", ["ab", "etaoinsr", "ÃÂ", "あいう漢字", " ", "\n ", "-=", "0123456789", "한국어텍스트", "🙂👍🏽"])
def test_long_pieces(alphabet):
    rng = random.Random(alphabet)
    text = "".join(rng.choice(alphabet) for _ in range(3000))
    assert MINE.encode(text) == THEIRS.encode_ordinary(text)


@pytest.mark.parametrize("text", ["<|endoftext|>", "a<|startoftext|>b</s>", "", None, "it's  two   spaces \n\n x", "﻿bom", "é"])
def test_odd_texts(text):
    assert MINE.encode(text) == (THEIRS.encode_ordinary(text) if text else [])


def test_stream_memory_stays_bounded():
    """Tokens come out while the piece still goes on; what is held back never passes the lookahead by more than a chunk and two tokens."""
    held = 0
    for unit in (b"the", b"abcde", b"ab", "漢字".encode()):
        fed = done = 0

        def chunks():
            nonlocal fed
            for _ in range(300):
                part = unit * 20
                fed += len(part)
                yield part

        for token in MINE.stream(chunks()):
            done += len(token)
            if fed < 300 * len(unit) * 20:
                held = max(held, fed - done)
        assert done == fed
    assert held <= MINE.lookahead() + len(unit) * 20 + 2 * MINE.longest


def odd_text(rng, n):
    parts = ["it's", " we'll", "'re", "  ", "\n\n ", " don", "'", "...", "12345", "é漢字", "🙂", " the", "x" * 40, " " * 30, "a'", "\u3000"]
    return "".join(rng.choice(parts) for _ in range(n))


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1000])
def test_text_in_chunks_has_the_same_ids(size):
    rng = random.Random(size)
    for text in (odd_text(rng, 300), "a " * 50 + "q" * 20_000 + " b", " " * 20_000 + "x", "x" + " " * 20_000, "-=" * 9000 + "'s", "7" * 17_000 + "\n"):
        if size < 4 and len(text) > 15_000:
            text = text[:2000]
        assert list(MINE.ids_of_chunks(text[i : i + size] for i in range(0, len(text), size))) == THEIRS.encode_ordinary(text)


def test_long_texts_take_the_chunked_way():
    text = odd_text(random.Random(3), 60_000)
    assert len(text) > 3 * B.CHUNK and MINE.encode(text) == THEIRS.encode_ordinary(text)


def test_memory_does_not_grow_with_the_text():
    """Texts of characters, with runs without any blank among them: the peak is the same, and far below either."""
    import tracemalloc

    t = B.Transducer(RANKS)
    t.lookahead()
    unit = "the quick brown fox's 12 dogs, " * 600 + "abcde" * 1700 + " " * 9000

    def peak(n):
        tracemalloc.start()
        for _ in t.ids_of_chunks(unit for _ in range(n)):
            pass
        found = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return found

    peak(1)  # fills the caches
    small, large = peak(2), peak(8)
    assert large < 1.2 * small + 100_000 and large < 2_000_000


def test_boundaries_a_lookahead_back_are_stable():
    """Paths that never meet: the bound of the merge list alone lets tokens out."""
    base = {bytes([b]): i for i, b in enumerate(b"ab")}
    t = B.Transducer(base | {b"aa": 2, b"bb": 3, b"ab": 4, b"abab": 5})
    for data in (b"a" * 3000, b"ab" * 1500, b"aab" * 1000):
        s = B.PieceStream(t)
        out = [x for i in range(0, len(data), 50) for x in s.feed(data[i : i + 50])]
        assert len(s.window) <= t.lookahead() + 3 * t.longest + 50
        assert out + s.end() == t.merge(data)


def test_lookahead_of_a_small_list():
    base = {bytes([b]): i for i, b in enumerate(b"abcd")}
    t = B.Transducer(base | {b"ab": 6, b"bc": 5, b"cd": 4})  # each next letter changes all tokens before it
    assert t.merge(b"abc") == [b"a", b"bc"] and t.merge(b"abcd") == [b"ab", b"cd"]
    assert t.lookahead() == 7 and B.Transducer(base | {b"ab": 4, b"bc": 5, b"cd": 6}).lookahead() == 3
    assert list(t.stream([b"a", b"bc", b"d"])) == [b"ab", b"cd"]
    with pytest.raises(ValueError):
        list(t.stream([b"x"]))


def test_any_cut_into_chunks_is_the_same():
    rng = random.Random(4)
    data = "".join(rng.choice("etaoinshrdlu") for _ in range(2000)).encode()
    want = list(MINE.stream([data]))
    assert all(list(MINE.stream(data[i : i + n] for i in range(0, len(data), n))) == want for n in (1, 7, 333))


def test_decoder_holds_back_incomplete_characters():
    ids = MINE.encode("漢字🙂")
    parts = list(BACK.stream(ids))
    assert "".join(parts) == "漢字🙂" and all("�" not in p for p in parts)


def test_columns(spark):
    texts = [None, "", "Hello, world", "漢字 🙂", "x" * 200_000]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    t = B.Tokenizer(spark)
    rows = df.select("doc_id", t.encode(F.col("text")).alias("e"), t.count(F.col("text")).alias("n"), t.decode(t.encode(F.col("text"))).alias("back")).orderBy("doc_id").collect()
    for r, text in zip(rows, texts):
        assert list(r["e"]) == (THEIRS.encode_ordinary(text) if text else []) and r["n"] == len(r["e"]) and r["back"] == (text or "")
    assert df.limit(0).select(t.encode(F.col("text"))).count() == 0


def test_rank_file_format():
    data = b"\n".join(base64.b64encode(k) + b" %d" % v for k, v in [(b"a", 0), (b"\xff", 1)]) + b"\n\n"
    assert B.read_ranks(data) == {b"a": 0, b"\xff": 1}


def mixture(spark, docs, targets, **options):
    df = spark.createDataFrame([(i, s, n, "clash") for i, s, n in docs], "doc_id long, source string, size long, copies string")
    return M.Mixture(df, targets, **options)


def test_shares_and_caps(spark):
    rng = random.Random(6)
    docs = [(i, rng.choices(["big", "mid", "small", None, "other"], [70, 25, 5, 3, 3])[0], rng.choice([0, 5, 50, 400])) for i in range(6000)]
    m = mixture(spark, docs, {"big": (0.5, 1), "mid": (0.3, 2), "small": (0.15, 4), "gone": (0.05, 3)}, seed=3)
    out = m.documents()
    rows = out.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) and out.columns == ["doc_id", "source", "size", "copies"]
    cap = {"big": 1, "mid": 2, "small": 4}
    assert all(1 <= r["copies"] <= cap[r["source"]] for r in rows)
    report = {r["source"]: r for r in m.report(out).collect()}
    assert report["gone"]["tokens"] == 0 and report["gone"]["documents"] == 0
    for s in cap:
        assert abs(report[s]["actual_share"] - report[s]["wanted_share"]) < 0.005
    assert max(report[s]["expected_copies"] / cap[s] for s in cap) == pytest.approx(1)
    size = {s: sum(n for _, x, n in docs if x == s) for s in cap}
    for s in cap:
        assert abs(report[s]["tokens"] - report[s]["expected_copies"] * size[s]) <= 400


def test_copies_against_plain_prefix_sums(spark):
    docs = [(i, "a" if i % 3 else "b", i % 7) for i in range(300)]
    m = mixture(spark, docs, {"a": (0.4, 3), "b": (0.6, 2)}, seed=8, total=700)
    got = {(r["source"], r["size"]): 0 for r in m.documents().collect()}
    for r in m.documents().collect():
        got[r["source"], r["size"]] += r["copies"]
    for share in m.shares:
        u, before = M._offset(share.source, 8), 0
        for size in range(7):
            n = sum(1 for _, s, z in docs if (s, z) == (share.source, size))
            want = int(share.copies * (before + n) + u) - int(share.copies * before + u)
            assert got.get((share.source, size), 0) == want
            before += n


def test_split_stretches_and_bands_are_the_same_line(spark):
    """Stretches of at most five rows, sizes over several bands: copies per source follow from the plain prefix sums just as well."""
    rng = random.Random(5)
    docs = [(i, rng.choice("ab"), rng.choice([3, 3, 3, 900, 1500, 5000])) for i in range(400)]
    m = mixture(spark, docs, {"a": (0.4, 3), "b": (0.6, 2)}, seed=8, stretch=5)
    rows = m.documents().collect()
    for share in m.shares:
        mine = [r for r in rows if r["source"] == share.source]
        n, u = share.documents, M._offset(share.source, 8)
        assert sum(r["copies"] for r in mine) == int(share.copies * n + u) - int(u) and len({r["doc_id"] for r in mine}) == len(mine)
        assert {r["copies"] for r in mine} <= {int(share.copies), int(share.copies) + 1}
        before = 0
        for size in (3, 900, 1500, 5000):
            c = sum(1 for _, s, z in docs if (s, z) == (share.source, size))
            assert sum(r["copies"] for r in mine if r["size"] == size) == int(share.copies * (before + c) + u) - int(share.copies * before + u)
            before += c


def test_same_seed_same_mixture(spark):
    docs = [(i, "a", 3) for i in range(100)]
    pick = lambda seed: {(r["doc_id"], r["copies"]) for r in mixture(spark, docs, {"a": (1.0, 1)}, seed=seed, total=90).documents().collect()}
    assert pick(1) == pick(1) and len(pick(1)) == 30


def test_edge_cases(spark):
    assert mixture(spark, [], {"a": (1.0, 1)}).documents().count() == 0
    assert mixture(spark, [(1, "a", 0)], {"a": (1.0, 1)}).documents().count() == 0
    m = mixture(spark, [(1, "a", 5), (2, "b", 5)], {"a": (0.5, 0), "b": (0.5, 3)})
    assert [tuple(r) for r in m.documents().collect()] == [(2, "b", 5, 3)]
    targets = spark.createDataFrame([("a", 0.5, 2), ("a", 0.25, 1), (None, 0.2, 1), ("b", None, None)], "source_name string, target_share double, max_repeats int")
    assert M.targets_of(targets) == {"a": (0.75, 1), "b": (0.0, 0)}
