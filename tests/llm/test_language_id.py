import base64
import random

import numpy as np
import pyarrow as pa
import pytest

from pagemill.llm import language_id as L

ALPHABETS = {"aa": "abcdef", "bb": "ghijklé", "cc": "ñopqrst"}


def text(language, rng, n):
    return " ".join("".join(rng.choice(ALPHABETS[language]) for _ in range(rng.randrange(2, 9))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    rows = [(k, text(lang, rng, rng.randrange(1, 60)), lang) for k, lang in enumerate(sorted(ALPHABETS) * 60)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


@pytest.fixture(scope="module")
def model(corpus):
    return L.fit(corpus.filter("doc_id % 4 <> 2"))


def test_held_out(corpus, model):
    found = L.identify(corpus.filter("doc_id % 4 = 2"), model).collect()
    assert sum(r.lang == r.lang_pred for r in found) / len(found) > 0.95
    assert not any(r.rejected for r in found) and all(0 <= r.score <= 1 for r in found)


def test_far_texts_are_rejected(spark, model):
    rows = [(1, "ωψχφυ τσρπο " * 30), (2, "12 34 !!"), (3, None), (4, ""), (5, "ab")]
    found = {r.doc_id: r for r in L.identify(spark.createDataFrame(rows, "doc_id bigint, text string"), model).collect()}
    assert found[1].rejected and found[1].lang_pred in ALPHABETS
    assert all(found[k].lang_pred == "und" and found[k].score == 0 and found[k].rejected for k in (2, 3, 4))
    assert not found[5].rejected  # too short to tell


def test_awkward(awkward, empty, model):
    found = L.identify(awkward, model)
    assert found.columns == [*[c for c in awkward.columns if c not in ("lang_pred", "score", "rejected")], "lang_pred", "score", "rejected"]
    assert found.count() == awkward.count()
    assert L.identify(empty, model).count() == 0
    L.fit(awkward)
    nothing = L.fit(empty)
    assert {r.lang_pred for r in L.identify(awkward, nothing).collect()} == {"und"}


def test_pieces_count_like_wholes(monkeypatch):
    rng = random.Random(4)
    texts = pa.array([text("bb", rng, 400), "", None, text("cc", rng, 90), "é"])
    whole = L.gram_counts(texts)
    monkeypatch.setattr(L, "CHUNK_BYTES", 97)
    assert (L.gram_counts(texts) == whole).all()
    assert np.array_equal(L.gram_counts(texts.slice(3, 1))[0], whole[3])


TURKISH = (
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı "
    "kardeşlik zihniyeti ile hareket etmelidirler. Herkes, ırk, renk, cinsiyet, dil, din, siyasi veya diğer herhangi bir "
    "akide farkı gözetilmeksizin bu haklardan istifade edebilir. "
)
FINNISH = (
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja "
    "heidän on toimittava toisiaan kohtaan veljeyden hengessä. Jokainen on oikeutettu kaikkiin tässä julistuksessa "
    "esitettyihin oikeuksiin ja vapauksiin ilman minkäänlaista erotusta. "
)


def test_bounds_by_length(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    learned = L.fit(docs.filter("doc_id % 4 <> 2"))
    rng = random.Random(9)
    strange = []
    for size in (600, 4000, 30_000):
        strange += [(TURKISH * 120)[:size], (FINNISH * 120)[:size], base64.b64encode(rng.randbytes(size)).decode()[:size]]
        strange.append("".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(size)))
    strange += [base64.b64encode(rng.randbytes(30)).decode() for _ in range(20)]  # short ones too
    found = L.identify(spark.createDataFrame(list(enumerate(strange)), "doc_id bigint, text string"), learned)
    kept = {r.doc_id for r in found.filter("not rejected").collect()}
    assert not kept & set(range(12)) and len(kept) <= 2
    # Short or long, no document of a language is lost, nor the first words of one.
    held = docs.filter("doc_id % 4 = 2 and text rlike '[a-zA-Z]'")
    assert L.identify(held, learned).filter("rejected").count() == 0
    cut = held.filter("length(text) > 200").selectExpr("doc_id", "substring(text, 1, 20 + doc_id % 100) as text")
    assert L.identify(cut, learned).filter("rejected").count() <= 0.01 * cut.count()


def test_few_texts_have_one_bound():
    sizes, cosines = np.array([40.0, 900.0, 7.0]), np.array([0.4, 0.8, 0.2])
    assert np.allclose(L.bounds_by_length(sizes, cosines), L.MARGIN * 0.2)
