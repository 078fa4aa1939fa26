from __future__ import annotations

import random

import pytest

WORDS = {
    "en": "the of and a in that is was for it with as his on be at by had not are but from or have an they".split(),
    "fr": "le la les des une est dans que pour qui sur avec ce il ne pas plus par été être où très après".split(),
    "ru": "и в не на я быть он с что а по это она этот к но они мы весь который из у так за".split(),
}
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, label string, key long"


def sentence(rng: random.Random, lang: str, n: int) -> str:
    return " ".join(rng.choice(WORDS[lang]) + str(rng.randrange(30) or "") for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with every awkward case; extra columns clash with names used inside operators."""
    rng = random.Random(1)
    out = []
    for i in range(90):
        lang = ("en", "fr", "ru")[i % 3]
        text = "\n".join(sentence(rng, lang, rng.randrange(8, 30)) for _ in range(rng.randrange(1, 6)))
        out.append((i, text, lang, f"s{i % 4}" if i % 11 else None))
    base = sentence(rng, "en", 120).split(" ")
    for i in range(90, 110):  # near copies of one text
        w = list(base)
        w[rng.randrange(len(w))] = f"x{i}"
        out.append((i, " ".join(w), "en", "s0"))
    out += [(i, " ".join(base), "en", "s1") for i in range(110, 114)]  # exact copies
    out.append((114, " ".join(base).upper(), "en", "s1"))
    out += [(115, None, "en", "s2"), (116, "", None, "s2"), (117, " \t\n\x0b ", "fr", None), (118, "one two", "en", "s3"), (119, "one  two", "en", "s3")]
    out.append((120, sentence(rng, "fr", 30000), "fr", "s0"))  # very long
    out += [out[5], out[5]]  # repeated rows
    out += [(None, "no id here at all, but some words", "en", "s1"), (None, None, None, None)]
    out.append((121, "1234 %% 5678 \U0001f600", "en", "s2"))
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), 0.5, "x", 7) for r in rows], COLUMNS).repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)
