import random

import pytest


@pytest.fixture
def corpus():
    """Documents with exact copies, near copies (one group larger than any threshold), shared passages, empty, null and long texts."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    out = []
    base = text(120).split(" ")
    for _ in range(60):  # near copies: one to twelve words changed
        t = base[:]
        for _ in range(rng.randint(1, 12)):
            t[rng.randrange(len(t))] = rng.choice(words)
        out.append(" ".join(t))
    passage = text(30)
    for _ in range(50):  # unlike texts with a common passage
        out.append(text(rng.randint(5, 80)) + " " + passage + " " + text(rng.randint(5, 80)))
    for _ in range(15):  # short texts, mostly the passage
        out.append(" ".join(passage.split(" ")[: rng.randint(1, 30)]))
    out += [text(40)] * 20
    long = text(4000)
    out += [long, long + " " + text(300), text(3000)]
    out += [" ", "", None, "one", "two words", "ONE", "x" * 500, "a\nb\n\nc", "aé b"]
    rng.shuffle(out)
    return [(3 * k, t) for k, t in enumerate(out)]
