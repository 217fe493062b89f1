"""Odd rows that every operator on documents must take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kinds string, row_key int, fp double"
LONG = " ".join(f"word{i % 977}" for i in range(40_000))
TEXTS = [None, "", "   \n\t ", "one", "two words", "Grüße aus Köln", LONG, "same text in two rows", "same text in two rows", "a\x1cb İΣ <|endoftext|> é", "tabs\tand  double  blanks \n\n", "!" * 300]


def odd_docs(spark):
    rows = [(i, t, "en", None, None if t is None else len(t), "k", 1, 0.5) for i, t in enumerate(TEXTS)]
    rows += [(None, "no id here", None, None, None, None, None, None), rows[7], (3, "one id, two texts", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
