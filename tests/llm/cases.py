"""Tables that every text operator must survive."""

ODD_TEXTS = [
    None,
    "",
    " ",
    "\n\n",
    "one",
    "One two\tthree\x0bfour\r\nfive",
    "a  b   c\n\n\nd ",
    "naïve café   日本語 テキスト 😀",
    "é x\x1cy\x85z​   end",
    "<|endoftext|> and <|startoftext|>",
    "it's WE'LL 'tis 12345 a1b2 x²",
    "*** ### $$$ | < > & %",
    "same line\nsame line\n\n\nsame line",
    "w " * 400,
    "ab" * 3000,
    " ".join(f"w{i % 97}x{i % 13}" for i in range(30_000)),
    "same text in two rows with a few more words than before",
    "same text in two rows with a few more words than before",
]


def odd_documents(spark, texts=None):
    """Odd texts with an extra column, another named like an output, and null languages and sources."""
    rows = [(i * 3, t, None if i % 3 else "en", None if i % 4 else "s", i, f"x{i}") for i, t in enumerate(ODD_TEXTS if texts is None else texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, extra string")


def python_words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
