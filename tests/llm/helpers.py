"""Small inputs with nulls, empty and long texts, ties, repeated rows and extra columns."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
#: Extra columns named like the operators' own.
CLASHING = T.StructType([*SCHEMA.fields, *[T.StructField(n, T.StringType()) for n in ("kept", "shard", "digest", "row", "salt", "fp", "score", "piece")]])


def texts(n=60, seed=5):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "gämma", "delta,", "eps-1", "ZETA", "eta", "x", "42", "…"]
    out = []
    for _ in range(n):
        sep = rng.choice([" ", " ", "  ", "\n", "\t "])
        out.append(sep.join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 9, 10, 40, 80]))))
    passage = " ".join(f"w{i}" for i in range(60))
    out += [passage, "start " + passage, passage + " end", out[5], out[5], out[7] + " tail"]
    out += [None, None, "", " ", "\x00a b", "a " * 3000, "z" * 20000]
    return out


def rows(n=60, seed=5):
    out = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts(n, seed))]
    return [*out, out[3], out[3], (None, "no id", None, None, None), (None, None, None, None, None)]


def frame(spark, data=None, clashing=False):
    data = rows() if data is None else data
    if clashing:
        return spark.createDataFrame([(*r, *["x"] * 8) for r in data], CLASHING).repartition(3)
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def table(df, *keys):
    return sorted((tuple(r) for r in df.collect()), key=repr)
