import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, extra string, size int, rank int"

PASSAGE = " ".join(f"shared{k}word" for k in range(60)) + "."


def near(k: int, edits: int) -> str:
    """A text of 120 words of its own number, with some words of another."""
    words = [f"base{i}" for i in range(120)]
    for e in range(edits):
        words[(k * 7 + e * 31) % 120] = f"edit{k}x{e}"
    return " ".join(words)


def rows() -> list[tuple]:
    texts = [
        None, "", " ", "one", "One  two", "one two three four", "one two three four five",
        "A b\tc\nd e f g", "a B c d e f g", "<|im_end|> \\ <\\| <|x|>", "é è ü ß 日本 😀 " * 5, "\u0085 a   b  c",
        "word " * 400, "x" * 5000, "<|endoftext|> in a text", "same text of some five words", "same text of some five words",
    ]
    texts += [near(k, k % 4) for k in range(12)]
    texts += [f"intro{k} unlike the rest here {PASSAGE} outro{k} ends otherwise than others" for k in range(4)]
    texts += [" ".join(f"only{k}v{i}" for i in range(3000)) for k in range(2)]
    made = [
        (i, t, "en", None if i % 9 == 0 else f"s{i % 4}", None if t is None else len(t), None if i % 2 else "e", i, -i)
        for i, t in enumerate(texts)
    ]
    made += [made[6], made[6]]  # repeated rows
    made += [(None, "a row without an id", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return made


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, long, tied and repeated rows, and columns with names the operators use themselves."""
    return spark.createDataFrame(rows(), DOCUMENTS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="module")
def labels(spark):
    some = [(i, int(i % 3 != 0), int(i % 5 == 0)) for i in range(0, 30)] + [(None, 1, 1), (3, None, None), (5000, 1, 0)]
    return spark.createDataFrame(some, "doc_id long, quality int, toxic int")
