"""Plain versions and awkward rows, shared by the tests of this folder."""

import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, component string, place int"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
AWKWARD = [
    (1, None, "en", "s", None, "x", None, 1),
    (2, "", None, None, 0, None, "c", None),
    (3, " \t\n\x0b ", "en", "s", 5, "x", "c", 2),
    (4, "one two three", "en", "s", 13, "x", "c", 2),
    (4, "one two three", "en", "s", 13, "x", "c", 2),
    (5, "One  two\nthree", "de", "s", 13, "x", "c", 2),
    (6, LONG, "en", "s", len(LONG), "x", "c", 2),
    (7, LONG + " tail", "en", "s", len(LONG) + 5, "x", "c", 2),
    (8, "퟿ ſecret ünïcode \U0001f600 " * 30, "de", "s", 10, "x", "c", 2),
    (9, "a\nb\nc\nd\na\nb\nc\n\n\nb\nc\nd", "en", "s", 10, "x", "c", 2),
    (None, "a b c d e f g h i j k l m n o p q r s t u v w x y z", "en", "s", 51, "x", "c", 2),
]
