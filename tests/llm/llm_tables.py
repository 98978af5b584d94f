"""Documents with further columns whose names operators use inside."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, name string, rid long, block int, bucket int, key string, cls string, k int, row string, s string, n string, w int, part int, _at int, body string"


def table(spark, rows):
    full = [(i, t, "en", s, None, "x", 1, 2, 3, "y", "z", 4, "r", "s", "n", 5, 6, 7, "b") for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))
