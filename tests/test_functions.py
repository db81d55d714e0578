import random
import re

import pytest
from pyspark.sql import functions as F

from quire.config import Routing
from quire.functions import text as tx
from quire.functions.identity import identity
from quire.functions.stem import stem
from quire.functions.vectors import cosine, fingerprint, hashed_vector, hashing_embedder, unit


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "text,reason",
    [
        ("short", "too short to assess"), ("The quick brown fox jumps over the lazy dog and sleeps a while.", "reads as language"), ("x" * 60, "space"),
        ("a\x01\x02\x03\x04" * 12 + " and some words here to read", "broken"), ("bcdfg hjklm npqrs tvwxz bcdfg hjklm npqrs tvwxz", "vowel"), ("", "too short to assess"), ("�" * 30 + " replaced characters of a text", "broken"),
    ],
)
def test_text_quality(spark, text, reason):
    q = one(spark, text, tx.text_quality)
    assert q.reason == reason and 0 <= q.score <= 1
    assert (q.score > 0) == (reason in ("space", "broken", "vowel"))


def test_sentences_and_tail(spark):
    text = 'First one. Second one! "Quoted third?" (Fourth.) fifth goes on. Sixth.'
    want = [s.strip() for s in re.split("(?<=[.!?])\\s+(?=[A-Z(\"'“])", text) if s.strip()]
    assert one(spark, text, tx.sentences) == want
    assert one(spark, text, lambda c: tx.overlap_tail(c, 1)) == want[-1]
    assert one(spark, text, lambda c: tx.overlap_tail(c, 10_000)) == " ".join(want)
    assert one(spark, text, lambda c: tx.overlap_tail(c, 0)) == ""


def test_tail_is_the_longest_end_that_fits(spark):
    def tail(text, budget):
        every = [x.strip() for x in re.split("(?<=[.!?])\\s+(?=[A-Z(\"'“])", text) if x.strip()]
        fits = [n for n in range(len(every) + 1) if sum(max(1, len(x) // 4) for x in every[len(every) - n :]) <= budget]
        return " ".join(every[len(every) - max(max(fits), min(1, len(every))) :])

    rng = random.Random(1)
    for _ in range(8):
        text = " ".join("Word " * rng.randint(1, 30) + "end." for _ in range(rng.randint(0, 12)))
        budget = rng.randint(1, 60)
        assert one(spark, text, lambda c: tx.overlap_tail(c, budget)) == tail(text, budget)


@pytest.mark.parametrize(
    "text,want",
    [("```markdown\n# A\ntext\n```", "# A\ntext"), ("a\n```\ncode\n```", "a\n```\ncode\n```"), ("```\na\n```\nb\n```", "```\na\n```\nb\n```"), ("```", "```"), ("no fence", "no fence")],
)
def test_unfence(spark, text, want):
    assert one(spark, text, tx.unfence) == want


def test_images_links_tables_repeats(spark):
    assert one(spark, " ![a](b) text [l](u) ", tx.strip_images) == "text [l](u)"
    assert one(spark, "| a | b |\n| c | d |\nx\n| e | f |\n\n| g |\n| h |", tx.table_runs) == 2
    assert one(spark, "| a |\n|---|\n| b |", tx.separator_rows) == 1
    loop = "\n".join(["a title line of it"] * 20)
    assert one(spark, loop, tx.degenerate_repeat) == 20
    assert one(spark, "\n".join(f"line number {i} of it" for i in range(20)), tx.degenerate_repeat) == 0
    assert one(spark, "\n".join(["|---|---|---|---|"] * 20), tx.degenerate_repeat) == 0


def test_contents_table(spark):
    assert one(spark, "| 1.1 Purpose | 3 |\n|---|---|\n| 1.2. Scope | ... |\n| Annexure A | |", tx.is_contents_table)
    assert not one(spark, "| Name | Amount |\n|---|---|\n| Fee | 100 |\n| Tax | 20 |", tx.is_contents_table)


def test_furniture_key_and_slug(spark):
    assert one(spark, "* PAGE 6 OF 11 *", tx.furniture_key) == "PAGE # OF #"
    assert one(spark, "  A--B c! ", tx.slug) == "a-b-c"
    assert one(spark, "../x/My <Report>?.PDF", tx.safe_filename) == "My _Report__.pdf"


@pytest.mark.parametrize(
    "name,year,circular,family",
    [
        ("A-INST-2022-07- Encl. Harbour Safety Policy.pdf", 2022, "A-INST-2022-07", "harbour-safety-policy"), ("Donations Policy 2023 - Portal Version.pdf", 2023, "", "donations-policy"),
        ("Donations Policy 2025.pdf", 2025, "", "donations-policy"), ("BCP Framework-2021.pdf", 2021, "", "business-continuity-framework"), ("KYC Manual (1).pdf", None, "", "know-your-customer-manual"), ("Gift 2019 and 2022 Rules.pdf", 2022, "", "gift-and-rules"),
    ],
)
def test_identity(spark, name, year, circular, family):
    i = one(spark, name, identity)
    assert (i.year, i.circular, i.policy_family) == (year, circular, family) and i.source_name == name


def test_vectors(spark):
    assert hashed_vector("", 16).sum() == 0
    assert abs((hashed_vector("some words", 64) ** 2).sum() - 1) < 1e-12
    rows = spark.createDataFrame([("Some  Words",), ("some words",), ("",)], "t string").select(hashing_embedder(32)("t").alias("v")).collect()
    assert rows[0].v == rows[1].v and len(rows[2].v) == 32
    assert fingerprint("/models/big/name", 8) == "name:8"
    r = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>").select(cosine(F.col("a"), F.col("a")).alias("s"), cosine(F.col("a"), F.col("b")).alias("z"), unit(F.col("a")).alias("u")).first()
    assert abs(r.s - 1) < 1e-12 and r.z == 0 and [round(x, 4) for x in r.u] == [0.6, 0.8]


def test_stems_as_published():
    pairs = "caresses:caress ponies:poni ties:ti cats:cat feed:feed agreed:agre plastered:plaster motoring:motor sing:sing conflated:conflat sized:size hopping:hop falling:fall happy:happi sky:sky relational:relat conditional:condit digitizer:digit operator:oper feudalism:feudal formalize:formal electrical:electr hopeful:hope revival:reviv adoption:adopt probate:probat rate:rate cease:ceas controll:control"
    for p in pairs.split():
        word, want = p.split(":")
        assert stem(word) == want, word


def test_defaults():
    assert (Routing().scan_density, Routing().raster_share, Routing().garble, Routing().text_density) == (12.0, 0.2, 0.45, 3.0)


FILE_NAMES = (
    "A-INST-2022-07- Encl. Harbour Safety Policy.pdf", "Donations Policy 2023 - Portal Version.pdf", "Donations Policy 2025.pdf", "BCP Framework-2021.pdf", "KYC Manual (1).pdf",
    "Gift 2019 and 2022 Policy.pdf", "Undated  Notes.pdf", "B-OPS-2024-12 Encl KYC FAQ.pdf", "archive.v2.pdf",
)


def test_identity_beside_sql(spark):
    import duckdb

    from quire.functions.identity import identity
    from quire.plans.catalogue import _IDENTITY_SQL

    rows = spark.createDataFrame([(n,) for n in FILE_NAMES], "name string").withColumn("i", identity(F.col("name"))).select("name", "i.doc_id", "i.title", "i.policy_family", "i.year", "i.circular").collect()
    want = duckdb.sql(f"WITH names AS (SELECT unnest({list(FILE_NAMES)}) AS name) {_IDENTITY_SQL}").fetchall()
    assert sorted(map(tuple, rows)) == sorted(want)


def test_token_counts_by_words_are_those_of_whole_texts():
    import random

    import public_tokenizers

    from quire.functions import tokens

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    assert tokens.by_words(spec)
    count, rng = tokens.Counter(spec), random.Random(5)
    some = ["loan", "Bank's", "<|endoftext|>", "<|ENDOFTEXT|>x", "́a", "á", "!\x1c!", "12.5", " x", "ΣΑΣ", " ", "\n\n", "\t", "  ", "x" * 80, "ﬁ", "日本"]
    texts = ["", *("".join(rng.choice([*some, " "]) for _ in range(rng.randrange(1, 40))) for _ in range(600))]
    asked: list[str] = []
    whole, count.whole = count.whole, lambda words: asked.extend(words) or whole(words)
    assert count(texts) == whole(texts)
    asked.clear()
    assert count(["loan 12.5 loan\nBank's"] * 50) == whole(["loan 12.5 loan\nBank's"] * 50) and asked.count("loan") == 0  # kept
    other = spec.replace('"invert":true', '"invert":false').replace('"invert": true', '"invert": false')
    assert other != spec and not tokens.by_words(other)
