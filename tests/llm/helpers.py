"""Small tables with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from pyspark.sql import functions as F

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "fp long, size long, taken long, place int, spans string, _row string, _words string, component_id long, m long, doc long"
)
LONG = " ".join(f"word{i % 5000} and" for i in range(30_000))
BASE = " ".join(f"alpha{i} beta{i * 7 % 13}" for i in range(40))
TEXTS = [
    None, "", " \n\t ", "one", "one two", "One TWO three", BASE, BASE, BASE + " tail", BASE.replace("alpha3 ", "other "),
    "x " * 40, LONG, "mail a@b.org now", "é ß İ Σ 中文 \u00a0 text", BASE.upper(), "|" * 50, "a\nb\na\nb c d",
]


def awkward(spark, texts=TEXTS):
    """The texts, the last one also as a repeated row, as one with a null id, and with null columns."""
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[-1], (None, texts[-1], None, None, None), (len(texts), texts[-1], None, None, None)]
    full = [(*r, 1, 2, 3, 4, "5", "6", "7", 8, 9, 10) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def same_columns(a, b):
    return a.columns == b.columns and [t for _, t in a.dtypes] == [t for _, t in b.dtypes]


def empty(spark):
    return awkward(spark).where(F.lit(False))
