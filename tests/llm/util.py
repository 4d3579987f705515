"""Small inputs with the awkward cases every operator has to take."""
import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])
# names that operators use for columns of their own
CLASHING = ["size", "key", "unit", "target", "copies", "score", "fp", "row_key", "n", "range", "found", "keys",
            "chunk", "bucket", "kept", "component_id", "item_id", "overlap", "id", "held", "node", "root"]


def docs(spark, rows, clash=True):
    """rows: (doc_id, text, lang, source)."""
    df = spark.createDataFrame([(i, t, l, s, None if t is None else len(t)) for i, t, l, s in rows], DOCS)
    if clash:
        from pyspark.sql import functions as F
        df = df.select("*", *[F.lit("x").alias(c) for c in CLASHING])
    return df


def words(rng: random.Random, n: int, vocab: int = 400) -> str:
    return " ".join(f"w{min(int(rng.paretovariate(0.7)), vocab)}" for _ in range(n))


def awkward(seed: int = 0, n: int = 60):
    """Random documents with nulls, empties, copies, ties and a long text."""
    rng = random.Random(seed)
    rows = [(i, words(rng, rng.randint(1, 60)), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None]))
            for i in range(n)]
    rows += [(n, None, "en", "a"), (n + 1, "", "en", None), (n + 2, " \t\n ", None, "b"), (n + 3, "one", "en", "a"),
             (n + 4, "one two", "de", "b"), (None, "no id at all here", "en", "a"), (None, None, None, None),
             (n + 5, words(rng, 20000), "en", "c")]
    rows += [(n + 10 + i, rows[3][1], "en", "a") for i in range(12)]  # a group of copies
    rows += [rows[5], rows[5]]  # repeated rows
    return rows
