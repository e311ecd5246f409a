"""Small documents with the odd cases every operator must stand, and a brute-force union-find."""

from __future__ import annotations

SF = "/root/testdata/sf0.001"

# Names that operators use inside, to see that columns of the input don't get in their way.
CLASHES = ("doc", "n", "token", "digest", "keep_id", "kept", "score", "label", "bucket", "rows", "text_sha256", "host", "v")

ODD_TEXTS = [
    None, "", " ", "\n\t", "one", "one", "One two  three", "a b c d e", "a b c d e f", "é ö ß 漢字 𝄞", "x" * 40_000,
    "word " * 5_000, "tie", "tie", " tie ", "The quick, brown fox. " * 30, "\x00 zero \x01", "a b",
]


def documents(spark, texts=ODD_TEXTS, first: int = 0):
    names = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
    rows = [(first + k, t, "en", None, None, *["clash"] * len(CLASHES)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, names)


def empty(spark):
    return documents(spark).limit(0)


def smallest(nodes, links) -> dict:
    """Smallest node that links reach, per node."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
