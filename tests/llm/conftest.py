import random

import pytest

WORDS = {
    "en": "the of and to in that is was for it with as his on be at by had not are but from or have an they which one you were her all she there would their".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei".split(),
}


@pytest.fixture(scope="session")
def make():
    """make(lang, n, seed): n words of a language, with content words made of its own syllables."""

    def text(lang: str, n: int, seed: int) -> str:
        r = random.Random(f"{lang}{n}{seed}")
        parts = {"en": ["th", "ing", "wh", "ly", "ou", "er"], "de": ["sch", "ung", "ö", "ich", "kei", "ß"]}[lang]
        return " ".join(r.choice(WORDS[lang]) if r.random() < 0.5 else "".join(r.choice(parts) for _ in range(r.randint(2, 4))) for _ in range(n))

    return text


DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    def build(rows):
        return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in rows], DOC)

    return build
