"""Small tables for the operators' tests."""

import random

SYLLABLES = "the of and in er ion tion ing ha re th an on at es ou nt st en ed".split()


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n)]


def prose(rng: random.Random, n: int) -> str:
    out = words(rng, n)
    for i in range(8, n, 9):
        out[i] += "."
    return " ".join(out)


def touched(rng: random.Random, text: str, changes: int) -> str:
    """The text with some words replaced."""
    parts = text.split(" ")
    for _ in range(changes):
        parts[rng.randrange(len(parts))] = words(rng, 1)[0]
    return " ".join(parts)


EDGES = [None, "", " \t\n ", "one", "one two three", "ONE two  THREE", "w " * 30_000, "x" * 50_000, "Zoë naïve 漢字 🙂 " * 20]


def documents(seed: int = 0, groups: int = 12, copies: int = 6) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): groups of exact and near copies, singles and edge cases."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(20, 120)) for _ in range(25)]
    for _ in range(groups):
        base = prose(rng, rng.randint(40, 150))
        texts += [touched(rng, base, rng.choice([0, 0, 1, 1, 2, 3, 6, 12])) for _ in range(copies)]
    texts += EDGES
    rng.shuffle(texts)
    return [(7 * i, t, rng.choice(["en", "de", None]), rng.choice(["src0", "src0", "src3", "src12", "other", None]), len(t or "")) for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
