import random

import pytest

SYLLABLES = "er in th an on ti es re nd ou ha st ea sh ing le".split()


def prose(rng: random.Random, words: int) -> str:
    out = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 5))) for _ in range(words)]
    return " ".join(w.capitalize() + "." if rng.random() < 0.05 else w for w in out)


@pytest.fixture(scope="session")
def messy_rows():
    """(doc_id, text, lang, source): nulls everywhere, empty and long texts, ties, copies, repeated rows, odd letters."""
    rng = random.Random(11)
    shared = [prose(rng, 60) for _ in range(4)]
    rows = [(None, None, None, None), (1, None, "en", "a"), (2, "", "en", None), (3, "   \n\t ", None, "b"), (None, "no id, one two three", "en", "a")]
    for i in range(10, 60):
        parts = [prose(rng, rng.randrange(1, 40)) for _ in range(rng.randrange(1, 6))]
        if i % 3 == 0:
            parts.insert(rng.randrange(len(parts)), shared[i % 4])
        rows.append((i, "\n".join(parts), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None])))
    copy = "\n".join([*shared, "last line of it"])
    rows += [(k, copy, "en", "hot") for k in range(100, 112)]
    rows += [(k, copy.replace("last", f"word{k}"), "en", "hot") for k in range(120, 126)]
    rows += [(7, "repeated row of six words", "en", "a")] * 3
    rows += [(8, prose(rng, 40_000), "en", "long"), (9, "x" * 30_000, "en", "long"), (90, "ab " * 9_000, "de", "long")]
    rows += [(91, "ΣΑΣ É é Ᲊ 日本 <|endoftext|> 'S don't #### %%%", "xx", "a"), (92, "one", "en", "b"), (93, "one two", "en", "b"), (94, "Released under the MIT Licence.\nCopyright (c) 2020 Nobody\nAll rights reserved!", "en", "b")]
    return rows


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    """As a table whose extra columns have the operators' own names."""
    extra = "row string, h string, v int, size string, digest string, hash int, score double, position int, own int"
    rows = [(*r, "x", "y", 1, "z", "d", 2, 0.5, 3, 4) for r in messy_rows]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {extra}").repartition(5)


@pytest.fixture(scope="session")
def empty(messy):
    return messy.filter("false")
