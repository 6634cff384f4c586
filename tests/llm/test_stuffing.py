import random

from sparkseek.llm import stuffing as S

REVIEW = "I have used this kettle for about ten days and the stitching is still well made. It does what it should, and the handle feels solid."
REVIEWS = {
    "en": REVIEW,
    "de": "Nach drei Tagen ist die Bedienung immer noch schön. Ich habe vorher zwei andere verglichen und es war nicht so gut.",
    "es": "El anterior me duró tres años. Lo compré para la cocina y la tapa es mejor de lo que pensaba.",
    "fr": "C'est le deuxième que je prends, cette fois pour les enfants. La couture est très solide et nous sommes contents.",
    "ja": "最初は迷いましたが、手触りは静かです。二週間使いましたが、縫い目は思ったより良いです。ふたもとても良いです。旅行にも好評でした。",
}
SPAM = [
    "buy kettle online, cheap kettle sale, best price kettle, kettle free shipping, discount kettle store, new kettle deal",
    "kettle kettle kettles KETTLE kettle kettle cheap kettle kettle kettle buy kettle kettle kettle kettle kettle kettle",
    "#KettleSale#buyKettle#cheapKettle#KettleOnline#bestKettle#KettleDeal#discountKettle#KettleStore#newKettle",
    "www.a-deals.test, shop[.]kettle24[.]example m dot best24 dot invalid https://x.example/?ref=1 hxxp://y.test/p/5 www.more24.test",
    "<li><a href='https://shop.a.example'>kettle cheap</a></li>\n[best kettle](http://b.test)\n[url=www.c.invalid]kettle deal[/url]\n<a href=\"d.example\">buy kettle</a>",
    "EAN: kettle SKU: 3402732 Type: black Model: X36 Pack: S || EAN: mixer | SKU: 2346048 | Type: red | Model: X37 | Pack: M",
    "送料無料 ケトル - 激安 デスクライト - クーポン コーヒーミル - 通販 コーヒーミル - 最安値 ケトル - おすすめ 人気 - 新品 在庫あり セール 割引 通販 送料無料 楽々",
]


def corpus(spark, odd=()):
    rng = random.Random(1)
    rows = []
    for lang, text in REVIEWS.items():
        words = text.split()
        for _ in range(150):
            a = rng.randint(0, 3)
            body = text if lang == "ja" else " ".join(words[a:])
            rows.append((body + rng.choice(["", " https://shop.example/p/5", " #review", ""]), rng.choice([lang, lang.upper(), f"{lang}-XX"])))
    rows += [(t, "en") for t in SPAM] + list(odd)
    return spark.createDataFrame([(i, t, lang, "clash", 0) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, language string, length int"), len(rows) - len(SPAM) - len(odd)


def test_spam_is_found_and_reviews_are_not(spark):
    half = SPAM[0][:90] + "\n" + REVIEW
    mostly = REVIEW[:60] + "\n" + SPAM[0] + ", " + SPAM[0]
    mojibake = REVIEWS["ja"].encode().decode("latin-1")
    odd = [(mostly, None), (half, "en"), (mojibake, "ja"), ("kettle cheap buy", "en"), (None, "en"), ("", None), ("   ", "en"), (REVIEW.lower().replace(".", "").replace(",", ""), "??"), (REVIEW + " #a #b #c http://x.test http://y.test", "en")]
    df, base = corpus(spark, odd)
    found = {r["doc_id"] for r in S.stuffed(df).collect()}
    assert found == set(range(base, base + len(SPAM))) | {base + len(SPAM)}
    assert S.spam_scores(df).count() == base + len(SPAM) + len(odd)


def test_empty_table(spark):
    df, _ = corpus(spark)
    assert S.stuffed(df.limit(0)).count() == 0


def test_features_are_linear_in_length():
    for text in ("a" * 300_000, "a." * 150_000, "<a " * 60_000, "[x" * 60_000, "é\x80" * 100_000, "the " * 60_000, "www." * 60_000):
        assert len(S.features(text)) == 5


def test_sentence_share():
    assert S.features(REVIEW)[4] > 0.95 and all(S.features(t)[4] < 0.1 for t in SPAM)
    assert S.features("prix en ligne kettle en ligne promo en ligne")[4] == 0


def test_function_words_of_other_languages_are_learned(spark):
    rng = random.Random(2)
    nouns = [f"naamwoord{i}" for i in range(60)]
    review = lambda: " ".join(f"ik heb de {rng.choice(nouns)} nu al {rng.randint(2, 9)} weken en het is nog goed" for _ in range(2))
    rows = [(review(), "nl") for _ in range(120)] + [(" ".join(rng.choice(nouns[:6]) + " kopen" for _ in range(20)), "nl") for _ in range(5)]
    df = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    words = S.learned_words(df)
    assert {"ik", "het", "nog"} <= words and not words & {"kopen", *nouns}
    assert {r["doc_id"] for r in S.stuffed(df).collect()} == set(range(120, 125))
    assert S.learned_words(df.limit(20)) == frozenset()


def test_robust_scatter_against_numpy(spark):
    """The concentration steps on the table's sums equal those on the rows, up to the width of a bin."""
    import numpy as np

    rng = np.random.default_rng(4)
    x = np.clip(rng.normal(0.5, 0.08, (3000, 5)), 0, 1)
    x[:200] = np.clip(rng.normal(0.9, 0.02, (200, 5)), 0, 1)
    rows = spark.createDataFrame([("en", *map(float, r)) for r in x], "language string, " + ", ".join(f"{f} double" for f in S.FEATURES)).repartition(3)
    got = S.RobustScatter(rows)
    center, inverse = np.median(x, 0), np.diag(1 / ((np.quantile(x, 0.75, 0) - np.quantile(x, 0.25, 0)) / 1.349) ** 2)
    for _ in range(S.STEPS):
        square = S._squared(x, center, inverse)
        near = x[square <= np.quantile(square, S.KEPT)]
        center, inverse = near.mean(0), np.linalg.inv(np.cov(near.T, bias=True) + S.FLOOR**2 * np.eye(5))
    inverse = inverse * min(S.CHI2_MEDIAN / np.median(S._squared(x, center, inverse)), 1)
    assert np.allclose(got.center["en"], center, atol=0.01) and np.allclose(np.diag(got.inverse["en"]), np.diag(inverse), rtol=0.15)
    scored = got.score(rows).toPandas()
    assert (scored.loc[scored["sentences"] > 0.8, "distance2"] > S.CHI2_CUTOFF).mean() > 0.95
