"""Tables with every odd case, and small brute-force helpers."""

import numpy as np

ODD = [
    (1, "The MIT License covers this. " + "alpha beta gamma delta " * 3, "en", "src1"),
    (2, "the mit license covers THIS. " + "alpha beta gamma delta " * 3, "en", "src1"),
    (2, "the mit license covers THIS. " + "alpha beta gamma delta " * 3, "en", "src1"),      # a repeated row
    (3, None, "en", "src2"),
    (4, "", None, None),
    (5, " \t\n ", "fr", "src3"),
    (None, "Un texte sans identifiant, avec des accents éàü", "fr", "src3"),
    (6, "12345 67890 !!", "de", None),
    (7, "long " * 30000 + "end", "en", "src1"),                                              # a very long text
    (8, "ein kleiner Text über die Welt und das Leben", "de", "src2"),
    (9, "\x1c odd\x00control   space İ", "es", "src2"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def odd(spark):
    """ODD with extra columns whose names operators use inside."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit("x") for c in ("n", "fp", "digest", "kept", "row", "body", "leaf", "part", "rid", "item", "score")})


def empty(df):
    return df.where("false")


def reach(links):
    """The smallest index each row reaches in a boolean matrix with a true diagonal."""
    low = np.arange(len(links))
    while True:
        new = np.array([low[row].min() for row in links])
        if (new == low).all():
            return low
        low = new
