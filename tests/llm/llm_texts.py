"""Invented texts."""

import random

WORDS = "the of and to in that it on with as for was his her they have from this an but not are which were".split()


def prose(seed: int, n: int) -> str:
    """Invented words, the same for a seed."""
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(WORDS, k=rng.randrange(1, 4))) for _ in range(n))


ODD_COLUMNS = ("row bigint, fp bigint, doc string, kept string, copy string, block string, mark string, sequence_id string, "
               "offset string, id string, key string, n_words string, mix_row string, text_ string")
