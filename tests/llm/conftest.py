import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus():
    """Random documents over four made-up vocabularies; rows (id, text, lang, source, length)."""
    r = random.Random(5)
    syllables = {"en": ["the", "ing", "wh", "ou", "st", "er"], "de": ["sch", "ung", "ei", "ü", "keit", "ver"], "fr": ["eau", "é", "qu", "tion", "oi", "è"], "es": ["ción", "ñ", "ll", "os", "rr", "ado"]}

    def words(lang, n):
        return " ".join("".join(r.choices(syllables[lang], k=r.randint(1, 4))) for _ in range(n))

    rows = []
    for k in range(160):
        lang = list(syllables)[k % 4]
        text = words(lang, r.randint(20, 300))
        rows.append((k, text, lang, f"s{k % 3}", len(text)))
    return rows, words


@pytest.fixture(scope="session")
def odd():
    """Nulls in any column, empty and blank and very long texts, ties and repeated rows."""
    long = "Long word. " * 60_000
    return [
        (1, None, "en", "a", None), (2, "", "en", None, 0), (3, "  \n\t ", None, "b", 5), (None, "some words here for you", "en", "a", 23), (4, "some words here for you", "en", "a", 23),
        (4, "some words here for you", "en", "a", 23), (5, long, "en", "a", len(long)), (6, "a", None, None, 1), (7, "12 34 !!", "fr", "b", 8), (None, None, None, None, None), (8, "é", "fr", "b", 1),
    ]
