"""What the tests of this folder share."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, rows, schema=SCHEMA):
    """Documents of (doc_id, text) or full rows, over two partitions."""
    full = [r if len(r) > 2 else (r[0], r[1], "en", "src0", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, schema).repartition(2, "doc_id")


def prose(rng, n):
    syllables = ["an", "er", "th", "on", "in", "re", "ou", "st", "ha", "ti"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) + rng.choice(["", "", ",", "."]) for _ in range(n))
