import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    # Extra columns whose names the operators use themselves.
    + [T.StructField(n, T.StringType()) for n in ("n_words", "score", "kept", "component_id", "found", "topic", "weight", "drop_keys", "version", "edge")]
)

PASSAGE = " ".join(f"Wort{n}" for n in range(60))
LINE = "This line is in many documents."


def texts():
    """Awkward documents: null, empty, blanks, ties, repeats, near copies, long and odd ones; ids are distinct but two null ones."""
    base = [f"word{n} and{n % 7} the{n % 3}" for n in range(120)]
    near = list(base)
    near[5] = "changed here now"
    out = [
        (10, None), (11, ""), (12, " \t\n\x0b\x0c\r "), (13, "one"), (14, "ONE"), (15, "a b c"), (16, "a b c d"), (17, "A b C d"), (18, " ".join(base)), (19, " ".join(base)), (20, " ".join(near)),
        (21, " ".join(base).upper()), (22, f"{LINE}\n{PASSAGE}\n{LINE}"), (23, f"x\n  {LINE.upper()} \nshort\n{PASSAGE} tail"), (24, f"head {PASSAGE}"), (25, "\n\n\n"), (26, "###\u00a0$$$ é\u2003ü 123 <s> </s>"),
        (27, "to be " * 4000), (28, "to be " * 4000), (29, ("lorem ipsum " * 7 + "\n") * 5), (30, " ".join(f"u{n}" for n in range(30_000))), (31, "Ünï " * 11 + "\u0085x"), (32, "a\x1cb\x1fc " * 9),
        (-5, f"{LINE}\nnegative ids come first\n{PASSAGE}"), (33, "x" * 50_000), (34, "same same same same same same same same same same same same same"), (35, "same " * 40),
        (36, "😀 emoji words 😀 " * 6), (37, "tail\n"), (38, "a&amp;b [INST] \\ </s>"),
    ]
    return out


@pytest.fixture(scope="session")
def rows():
    return texts()


def frame(spark, rows):
    return spark.createDataFrame([(d, t, ("en", None, "de")[i % 3], (None, "src0", "src1")[i % 3], None if t is None else len(t)) + ("clash",) * 10 for i, (d, t) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def repeated(spark):
    """Null ids and a doc_id in several rows, once with its own text and once with another."""
    return frame(spark, [(None, PASSAGE), (None, None), (1, f"{LINE}\n{PASSAGE}"), (1, f"{LINE}\n{PASSAGE}"), (1, LINE), (2, f"{LINE}\n{PASSAGE} more"), (2, f"{LINE}\n{PASSAGE} more"), (0, None)])
