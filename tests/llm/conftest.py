import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture
def prose():
    """Texts of random words, with copies, near copies, shared passages, empty and odd ones."""
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    out = [text(r.choice([3, 20, 60, 200])) for _ in range(60)]
    for base in out[:12]:
        out.append(base)
        w = base.split()
        w[len(w) // 2] = "changed"
        out.append(" ".join(w))
    hot = text(90)
    for _ in range(40):
        w = hot.split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice(words)
        out.append(" ".join(w))
    passage = text(55)
    out += [f"{text(100)} {passage}" for _ in range(15)]
    return [*out, "", None, " \t\n ", "one", "One", "two words", "word " * 500, text(4000)]
