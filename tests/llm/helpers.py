import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns with names that the operators use themselves, and a null in each.
EXTRA = "score string, gone string, bucket int, ids string, hashes string, a long, b long, n long, rep long, members string, part string, counts string, found string, family long, digest string, unit string, t string, c string, v string, ids_ string, keys string"


def words(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("bcdfgklmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(n))


def change(text: str, share: float, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(words(1, r.randrange(10**9)) if r.random() < share else w for w in text.split(" "))


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


def clashing(spark, df):
    """The documents with null extra columns of names that clash."""
    from pyspark.sql import functions as F

    for c in EXTRA.split(", "):
        name, kind = c.split(" ")
        df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)
