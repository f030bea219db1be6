"""Plain versions of the operators, and documents that try their edges."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=False):
    text = text or ""
    return WORD.findall(text.translate(LOWER) if lower else text)


PASSAGE = "the quick brown fox jumps over the lazy dog while seven tired sailors sing an old song about rain"
ODD_TEXTS = [
    None,
    "",
    " \t\n\r\x0b\x0c ",
    "one",
    "one two",
    PASSAGE,
    PASSAGE,
    PASSAGE.upper(),
    f"Before it. {PASSAGE} and after it,\nmore words follow here.",
    f"x {PASSAGE}",
    "l\n" * 30 + "l",
    "a b c " * 400,
    "naïve café — “quoted” e\u0301 ΑΒΓ 日本語 テキスト\u3000wide\u00a0space <|endoftext|> it's we're",
    "### $$$ %%% &&& ||| <> *** " * 20,
    "word " * 5000 + PASSAGE,
    "\x1c\x1d unit separators \x85 are words",
    "You are an idiot. He said not a moron, not stupid! kill you",
    "trailing blanks   \n\n",
]


def documents(spark, texts=None, extra=True):
    """Rows with ids out of order, one repeated and one null, and columns with names that operators use inside."""
    texts = ODD_TEXTS if texts is None else texts
    ids = [7 * k % 101 for k in range(len(texts))]
    rows = [(i, t, "en" if k % 3 else None, f"s{k % 2}", len(t or "")) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    rows += [rows[5], (None, PASSAGE, "en", None, None)] if extra else []
    clash = ("word", "token", "count", "fp", "key", "bucket", "hash", "length")
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {c} int" for c in clash)
    return spark.createDataFrame([(*r, *range(len(clash))) for r in rows], schema)


def collected(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
