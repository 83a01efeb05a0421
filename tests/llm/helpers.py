"""Fixtures that every operator's tests share: odd rows, and brute-force building blocks."""

import re

#: Names that operators might use inside.
CLASHING = "_id long, _key string, _size int, _spans string, _h long, _source string, _text string, _new string, _text_h long, _fits boolean, _cut_spans int, _kept_id long, id long, h string, start int, `a.b` int"
DOC_SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, extra string, ids int, words string, {CLASHING}"
_MORE = (1, "k", 2, "s", 3, "so", "te", "ne", 4, True, 5, 6, 7, "h", 8, 9)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
ODD_TEXTS = [
    None,
    "",
    " \t\n",
    "one",
    "one two three four",
    "one two three four five",
    "One  TWO\tthree\nfour five six",
    "tie tie tie tie tie tie tie tie tie tie tie tie",
    "line a b c d e\nline a b c d e\n\nline a b c d e\nother",
    "non breaking 　 wide é \U0001f600 İI <s> </s> <|endoftext|> \\ ▁x",
    LONG,
    LONG,
]


def rows(texts, first=0):
    return [(first + i, t, None, None if i % 3 == 0 else f"s{i % 2}", None if t is None else len(t), "x", i, "w", *_MORE) for i, t in enumerate(texts)]


def odd_documents(spark):
    """Nulls in every column, empty, blank and long texts, exact copies, a repeated row and clashing extra columns."""
    out = rows(ODD_TEXTS)
    nothing = (None,) * (6 + len(_MORE))
    out += [out[5], out[5], (None, "one two three four five six", *nothing), (None, None, *nothing)]
    return spark.createDataFrame(out, DOC_SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def words(text):
    return WORD.findall(text or "")


def shingles(text, n=5):
    ws = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))} if ws else set()
