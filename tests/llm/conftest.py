import random

import pytest

VOCABULARY = [f"w{i}" for i in range(400)] + ["of", "the", "and", "in", "éa", "ß", "字"]


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, nulls, empty and short ones, shared lines, and a long one."""
    rng = random.Random(5)
    words = lambda n: " ".join(rng.choice(VOCABULARY) for _ in range(n))
    base = words(120)
    rows = [(i, "\n".join(words(rng.randint(1, 30)) for _ in range(rng.randint(1, 6)))) for i in range(60)]
    for i in range(60, 100):
        w = base.split(" ")
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
        rows.append((i, " ".join(w) + "\nAll rights are reserved here\nPage %d of 40 in all" % i))
    rows += [(i, base) for i in range(100, 140)]
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "the"), (204, "THE"), (205, "of the"), (206, words(20_000)), (207, "a  b\r\n c\x0bd é f <|im_end|> %%% !!!")]
    return rows
