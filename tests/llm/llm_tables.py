"""Small tables with the awkward cases that every operator has to take."""

from pyspark.sql import functions as F

#: Names that operators use for columns of their own.
CLASHES = ("score", "kept", "key", "part", "id", "row", "anchor", "node", "label", "block", "gone_id", "value", "digest")


def documents(spark, rows, clashes=CLASHES):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    rows = [(r[0], r[1], r[2] if len(r) > 2 else "s", "en", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    return df.withColumns({c: F.lit(f"own {c}") for c in clashes})


def pages(spark, rows, clashes=CLASHES):
    """rows: (page_id, url, html)."""
    df = spark.createDataFrame(list(rows), "page_id long, url string, html string")
    return df.withColumns({c: F.lit(f"own {c}") for c in clashes})


def rows_of(df, *columns):
    """Rows as tuples, sorted with nulls first."""
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    return sorted(got, key=lambda t: tuple((v is not None, v) for v in t))
