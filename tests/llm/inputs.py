"""Small inputs with every awkward case, and plain versions of what they should give."""

import zlib

import duckdb

TABLES = "/root/testdata/sf0.001"
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, digest int, "
    "text_key string, keep_id string, fingerprint string, component_id int, found int, label string, bucket int, "
    "number int, rows int, shard string, size string, row_id int, item string, key_id int, key_text int, doc int, "
    "tree int, edits int, x int, copies int, ids string, at string"
)
CLASHES = (0.5, "yes", 1, "k", "k", "f", 7, 8, "l", 2, 3, 4, "s", "z", 5, "i", 1, 2, 3, 4, 5, 6, 7, "i", "a")

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma".split()


def sentence(start, count=40):
    return " ".join(WORDS[(start * 7 + i * i + i * start) % len(WORDS)] + str((i * start) % 5) for i in range(count))


TEXTS = [
    (1, sentence(1), "en", "a"),
    (2, sentence(1).replace(" ", "\n  ", 3), "en", "a"),  # the same but for white space, and longer
    (3, sentence(1).upper(), "en", "b"),
    (4, None, "en", "a"),
    (5, "", None, "a"),
    (6, " \t\n\x0b\x0c\r", "en", None),
    (7, sentence(7), None, "b"),
    (7, sentence(7), None, "b"),  # the same row twice
    (7, sentence(8), "de", "b"),  # the same id, another text
    (None, sentence(9), "de", None),
    (None, sentence(9), "de", None),
    (11, "élan ÀÉ 日本語 ½ ² İstanbul ΣΑΣ 😀 <|endoftext|> x", "fr", "c"),
    (12, "123 456 !!!", "fr", "c"),
    (13, sentence(13, 30_000), "en", "a"),  # very long
    (14, sentence(13, 30_000) + " tail", "en", "a"),
    (15, sentence(2), "en", "a"),
    (16, sentence(2) + " one", "en", "a"),
    (17, "word", "en", "a"),
    (18, "Word", "en", "a"),
    (19, "a b c", "en", "a"),
]


def documents(spark, rows=TEXTS):
    full = [(i, t, lang, source, None, *CLASHES) for i, t, lang, source in rows]
    return spark.createDataFrame(full, SCHEMA)


def table(name, tables=TABLES):
    return duckdb.sql(f"SELECT * FROM '{tables}/{name}.parquet'").fetchall()


def columns(name, *wanted, tables=TABLES):
    return duckdb.sql(f"SELECT {', '.join(wanted)} FROM '{tables}/{name}.parquet'").fetchall()


def share(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


def plain(text):
    """Text without the white space that exact dedup ignores."""
    return (text or "").translate({c: None for c in (32, 9, 10, 11, 12, 13)})


def spaces_to_one(text):
    """The text with each character of the normalised white space as a space."""
    return "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text)
