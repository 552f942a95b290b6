from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int, letters: str = "abcdeh") -> str:
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(n))


def odd_texts() -> list[str | None]:
    """Nulls, empty and blank texts, odd white space, long words and texts, ties."""
    rng = random.Random(5)
    long = prose(rng, 30_000)
    twin = prose(rng, 60)
    return [None, "", " \n\t", "one", "One tWo", "a b c d", "x" * 5000, long, long, twin, twin, twin + " more", "\x1c\x85 　 é ß 日本 𝔘😀 ▁ a  b\n\n c ", "<|endoftext|> a<|endoftext|>", "end. Stop, now.", "é. ü, ×. 1."]


def table(spark, texts=None, **columns):
    texts = odd_texts() if texts is None else texts
    rows = [(i, t, ("en", "fr", None)[i % 3], ("s1", "s2", None)[i % 3], len(t) if t is not None else None) for i, t in enumerate(texts)]
    out = spark.createDataFrame(rows, SCHEMA)
    for name, value in columns.items():
        out = out.withColumn(name, value)
    return out


def clashing(spark, texts=None):
    """Extra columns with the names that operators use themselves."""
    from pyspark.sql import functions as F

    names = ("size", "n", "key", "host", "h", "rid", "comp", "cid", "pieces", "src", "held_out", "base_failed", "kept", "part", "grp", "bits", "epochs", "target")
    return table(spark, texts, **{c: F.lit("x") for c in names})


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()
