"""Small tables with the awkward rows."""

import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, line string, words int"
ODD = [
    (9001, None), (9002, ""), (9003, " \n\t\n "), (9004, "\n"), (9005, "one"), (9006, "one two"),
    (9007, "x" * 70_000), (9008, "word " * 30_000), (9009, "<|endoftext|> <|im_end|> \\ <\\| \\\\n"),
    (9010, "İΣ ßſ é é 日本語 🎉🎉 \x00\x01 \x1c \x85 \xa0　"), (9011, "twice the same row"), (9011, "twice the same row"),
    (9012, "one id, two texts: a"), (9012, "one id, two texts: b"), (None, "no id"), (None, None), (9013, "\r\nA line with more than twenty characters\r\n" * 3),
    (9014, "a line with more than twenty characters"), (9015, "\t A LINE with more than twenty characters \x0b"), (9016, "don't we'll 'S 'll  've12ab_c"), (9017, "0123456789" * 300),
]


def rows(base: int = 120):
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).slice(0, base)
    return [*zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True), *ODD]


def docs(spark, pairs=None):
    pairs = rows() if pairs is None else pairs
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "clash", 3) for i, t in pairs], DOC_SCHEMA)


def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def tuples(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
