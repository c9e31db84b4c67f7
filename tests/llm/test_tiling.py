"""Greedy string tiling against a search of all places at all lengths."""

import random
import time

import numpy as np

from fleetrisk.llm.decontaminate import tiles


def brute(item, text, least):
    marked_i, marked_t, found = set(), set(), []
    for n in range(min(len(item), len(text)), least - 1, -1):
        for j in range(len(text) - n + 1):
            if any(p in marked_t for p in range(j, j + n)):
                continue
            for i in range(len(item) - n + 1):
                if item[i : i + n] == text[j : j + n] and not any(p in marked_i for p in range(i, i + n)):
                    marked_i.update(range(i, i + n))
                    marked_t.update(range(j, j + n))
                    found.append((i, j, n))
                    break
    return found


def test_against_all_places():
    rng = random.Random(4)
    for k in range(400):
        letters = rng.choice([1, 2, 3, 9])
        item = [rng.randrange(letters) for _ in range(rng.randrange(1, 26))]
        text = [rng.randrange(letters) for _ in range(rng.randrange(1, 26))]
        if k % 3 == 0:  # reordered passages
            cut = rng.randrange(len(item))
            text = text[: rng.randrange(len(text))] + item[cut:] + text[:2] + item[:cut]
        for least in (1, 2, 4):
            assert tiles(np.array(item), np.array(text), least) == brute(item, text, least)


def test_long_items_are_quick():
    rng = np.random.default_rng(1)
    item = rng.integers(0, 3000, 10_000)
    parts = np.array_split(item, 7)
    text = np.concatenate([np.concatenate([p, rng.integers(0, 3000, 50)]) for p in parts[::-1]])
    start = time.process_time()
    found = tiles(item, text, 4)
    assert sum(n for _, _, n in found) == 10_000 and time.process_time() - start < 5
