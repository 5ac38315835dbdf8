"""External induction against sorting by comparison, within little memory and in small chunks."""

import numpy as np
import pytest

from tidemark.llm import induced


def checked(text, most, memory):
    about = {}
    out = list(induced.suffixes(text, 256, most, memory, about))
    order, shared = (np.concatenate([x[k] for x in out]).tolist() if out else [] for k in (0, 1))
    raw = text.tobytes()
    assert sorted(order) == list(range(len(raw)))
    before = None
    for i, n in zip(order, shared):
        own = raw[i : i + most]
        if before is not None:
            same = next((k for k, (x, y) in enumerate(zip(before, own)) if x != y), min(len(before), len(own)))
            assert before <= own and same == n
        before = own
    return about.get("spilled", 0)


@pytest.mark.parametrize("memory", [64, 2000, 1 << 20])
def test_suffixes_of_all_kinds(monkeypatch, memory):
    r = np.random.default_rng(memory)
    for i in range(120):
        monkeypatch.setattr(induced, "CHUNK", (7, 50, 1 << 18)[i % 3])
        text = r.integers(0, r.integers(1, 6), r.integers(0, 200)).astype(np.uint8)
        if i % 4 == 0:
            text = np.concatenate([text, text[: len(text) // 2], text])
        if i % 5 == 0:
            text = np.append(np.repeat(text, r.integers(1, 9)), 0).astype(np.uint8)
        checked(text, (100, 5, 2)[i // 3 % 3], memory)


def test_a_text_far_larger_than_memory_goes_through_disk(monkeypatch):
    monkeypatch.setattr(induced, "CHUNK", 256)
    r = np.random.default_rng(1)
    words = [bytes(r.integers(97, 105, r.integers(1, 7)).astype(np.uint8)) for _ in range(40)]
    text = np.frombuffer(b" ".join(words[k] for k in r.integers(0, 40, 6000)), np.uint8)
    text = np.concatenate([text, text[:3000]])
    assert checked(text, 100, 8 << 10) > 8 * len(text) > 16 * (8 << 10)
    # nothing that grows with the text stays in memory: text, seeds and names are mapped
    level = induced.Level(text, 256, 100, 8 << 10)
    assert isinstance(level.text, np.memmap) and isinstance(level.seeds(), np.memmap) and isinstance(level.named(level.seeds())[0], np.memmap)
