import pytest
from pyspark.sql import types as T

SENTENCES = [
    "the quick brown fox jumps over the lazy dog while the calm river runs past the old stone mill and under the bridge",
    "a storm moved in from the west during the night and by the morning every road in the valley was covered with snow",
    "seven small boats left the harbour before dawn carrying nets and lamps and enough bread for the whole of the week",
    "nobody could say when the clock in the tower had stopped but everyone agreed that it had been right twice a day",
]
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(4000))
#: (doc_id, text): nulls, empties, repeats, ties, near copies, accents, a long text.
ROWS = [
    (1, SENTENCES[0]), (2, SENTENCES[0]), (3, SENTENCES[0] + " today"), (4, SENTENCES[1]), (5, None), (6, ""), (7, " \n\t "), (8, "one two"), (9, "one two"),
    (10, SENTENCES[2] + "\n" + SENTENCES[3] + "\nlast line\nx"), (11, "start\n" + SENTENCES[2] + "\n" + SENTENCES[3] + "\nlast line\nend"), (12, LONG), (13, LONG + " tail"),
    (14, "Éclair naïve façade \U0001f600 漢字 \r\n\r\n ends  "), (15, "\xff\x00ÿ" * 3), (None, SENTENCES[1]), (None, None), (4, SENTENCES[1]), (4, "another text under one id"), (16, SENTENCES[0].upper()),
    (17, SENTENCES[3] + " " + SENTENCES[1]), (18, "x" * 700), (19, "ab" * 400),
]
CLASHING = ["batch", "bucket", "body", "second", "row", "node", "kept", "list", "members", "n", "held_out", "ids"]


@pytest.fixture(scope="session")
def rows():
    return ROWS


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with every awkward case, and extra columns whose names clash with inner ones."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in CLASHING]])
    return spark.createDataFrame([(i, t, len(t or ""), *["clash"] * len(CLASHING)) for i, t in ROWS], schema).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
