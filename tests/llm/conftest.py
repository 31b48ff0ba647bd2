"""Tables with every awkward row: nulls, empty and long texts, repeats, and extra columns of clashing names."""

import pytest

#: Names that the operators use inside, and used to; a table may have them all.
NAMES = """text_hash start ids name score node row found hash own n kept _found _hash _n _kept _doc _marked marks marked left _hit_id
_hit_text _hits hits doc rejected lang_pred part place key size asks root sent u v _text words hashes n_words n_rows items item known
spans span n_bytes pieces piece n_tokens end first last order rank least component_id n_shingles _left _row weight n_features
_down _id _part _at able term terms tf n df bucket block label predicted held_out string""".split()
EXTRA = ", ".join(f"{c} {'int' if c == 'start' else 'string'}" for c in dict.fromkeys(NAMES))
AWKWARD = [
    (1, "one two three four five six seven eight nine ten eleven twelve"),
    (1, "one two three four five six seven eight nine ten eleven twelve"),
    (2, "ONE two three four five six seven eight nine ten eleven twelve"),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (None, "one two three four five six seven eight nine ten eleven twelve"),
    (None, None),
    (6, "été über año 日本語 😀 " * 40),
    (7, "x" * 30_000),
    (8, "word " * 20_000),
    (9, "short"),
    (9, "another text of the same id"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """`doc_id`, `text`, `lang` and columns that operators might want to name so."""
    extra = [7 if c == "start" else f"own {c}" for c in dict.fromkeys(NAMES)]
    rows = [(i, t, "en" if k % 3 else None, *extra) for k, (i, t) in enumerate(AWKWARD)]
    return spark.createDataFrame(rows, f"doc_id bigint, text string, lang string, {EXTRA}")


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)
