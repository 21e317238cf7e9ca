import numpy as np
import pytest
from pitwall.llm import suffix as X


def padded(b):
    return np.concatenate([np.frombuffer(b, np.uint8), np.zeros(X.PAD, np.uint8)])


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("letters", [1, 2, 5, 200])
def test_two_stage_order_is_the_suffix_order(seed, letters):
    rng = np.random.default_rng(seed)
    text = bytes(rng.integers(97 - 60, 97 - 60 + letters, 700).astype(np.uint8))
    text += text[100:420]
    wanted = np.unique(rng.integers(0, len(text) - 100, 400))
    order = X.suffix_order(padded(text), wanted)
    assert sorted(order.tolist()) == wanted.tolist()
    keys = [text[i : i + 100] for i in order]
    assert keys == sorted(keys)
    same = X.common_prefix(padded(text), order)
    assert same.tolist() == [a == b for a, b in zip(keys[:-1], keys[1:])]


@pytest.mark.parametrize("letters", [1, 3, 26])
def test_every_string_has_an_anchor_that_depends_on_it_alone(letters):
    rng = np.random.default_rng(letters)
    passage = bytes(rng.integers(97, 97 + letters, 160).astype(np.uint8))
    docs = [b"", bytes(rng.integers(97, 123, 300).astype(np.uint8)) + passage, b"x" * 99, passage + b"tail" * 60, b""]
    ends = np.cumsum([len(d) for d in docs])
    starts = ends - [len(d) for d in docs]
    at, h = X.anchors(padded(b"".join(docs)), starts, ends)
    of = dict(zip(at.tolist(), h.tolist()))
    for s, e in zip(starts, ends):
        for p in range(s, e - X.LENGTH + 1):
            assert any(p <= q <= p + X.SPAN for q in of)
    one = {q - (starts[1] + 300) for q in of if starts[1] + 300 + 31 <= q <= ends[1] - 63}
    two = {q - starts[3] for q in of if starts[3] + 31 <= q <= starts[3] + 160 - 63}
    inner = lambda x: {q for q in x if 68 <= q <= 160 - 100}
    assert inner(one) == inner(two)


def test_spans_are_united():
    rid, a, b = (np.array(x) for x in ([2, 1, 1, 1, 2], [5, 0, 90, 300, 4], [9, 100, 200, 400, 6]))
    assert [x.tolist() for x in X.merged(rid, a, b)] == [[1, 1, 2], [0, 300, 4], [200, 400, 9]]
