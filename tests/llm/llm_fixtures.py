"""Small invented texts shared by the tests of this folder."""

import random


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    out = ["".join(rng.choice(("ba", "ke", "lo", "mi", "tu", "ra", "so", "né")) for _ in range(rng.randint(1, 4))) for _ in range(words)]
    return " ".join(out)


def messy_texts() -> list[tuple[int | None, str | None]]:
    """Nulls, empty, blank, short, long, equal, nearly equal and shared texts; a repeated row and a null key."""
    base = prose(1, 120)
    words = base.split()
    near = [" ".join(words[:k] + ["changed"] + words[k + 1 :]) for k in (10, 60, 110)]
    shared = prose(2, 110)
    rows: list[tuple[int | None, str | None]] = [
        (1, base), (2, base), (3, near[0]), (4, near[1]), (5, near[2]), (6, None), (7, ""), (8, "  \n\t "), (9, "one"),
        (10, "one two three"), (11, "ONE two Three"), (12, prose(3, 60) + " " + shared + " " + prose(4, 50)),
        (13, prose(5, 70) + "\n" + shared), (14, prose(6, 5000)), (15, "no letters? 123 ?!"), (15, "no letters? 123 ?!"),
        (None, prose(7, 30)), (16, "ééé 日本 😀 tail"), (17, "a" * 3000), (18, "12345"),
    ]
    return rows
