import random

import pytest
from llm_helpers import prose


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, nulls, empties and a long one."""
    rng = random.Random(3)
    base = [prose(rng, rng.randrange(3, 260)) for _ in range(40)]
    passage = prose(rng, 70)
    rows = list(base)
    rows += [base[0], base[0].upper(), base[1], None, "", " \n\t ", "one", "one two", "one two"]
    for k in range(30):
        words = base[5].split() or ["x"]
        words[rng.randrange(len(words))] = f"edit{k}"
        rows.append(" ".join(words))
    rows += [prose(rng, 30) + "\n" + passage + "  " + prose(rng, 20) for _ in range(6)]
    rows += [prose(rng, 4000), "same same " * 60, "line a\nline a\nline a\nb"]
    rng.shuffle(rows)
    return [(k, t, f"s{k % 3}" if k % 5 else "hot") for k, t in enumerate(rows)]
