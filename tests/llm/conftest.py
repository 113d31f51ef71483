import random

import pytest

SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, component_id LONG, n STRING, digest STRING"
VOCABULARY = {
    "en": "the of and to in river house window never always morning street paper light green under over again",
    "de": "der die und das nicht auch sehr strasse wieder morgen fenster über grün licht papier haus immer unter",
    "fr": "le la les et des rivière maison fenêtre toujours jamais matin rue papier lumière vert sous encore",
}
ODD = [
    None, "", " ", "\n\n", "a", "A", "one two", "One Two", "12345 !!!", "MIT License", "x mit license y apache license",
    "Licensed under the Apache License, Version 2.0.", "general public license general public license", "it's we'll don't",
    "foo<|endoftext|> bar <|startoftext|>", "x\x1cy z", "a  b\t\tc \n d", "İstanbul ΣΑΣ", "日本語 テキスト", "é é", "🎉🎉", " a ",
]


def make_rows(seed: int = 3, n: int = 120) -> list[tuple]:
    """Odd texts, plain ones of three languages, exact and near copies, a long text, a repeated row and null ids."""
    rng = random.Random(seed)
    texts = [(t, "en") for t in ODD]
    for k in range(n):
        lang = list(VOCABULARY)[k % 3]
        words = VOCABULARY[lang].split()
        texts.append((" ".join(rng.choice(words) for _ in range(rng.randint(3, 80))).capitalize() + ".", lang))
    base = " ".join(rng.choice(VOCABULARY["en"].split()) + str(rng.randint(0, 99)) for _ in range(400))
    texts += [(base, "en"), (base.upper(), "en"), (base.replace(" ", "  ", 1), None), (base + " end", "en"), ("word " * 9000, "en")]
    rows = [(i, t, lang, f"s{i % 3}", len(t or ""), -1, "n", "d") for i, (t, lang) in enumerate(texts)]
    return [*rows, rows[30], (None, "text without id", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "source")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id LONG, quality INT, toxic INT")
